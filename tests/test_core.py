import hashlib
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiltwork.functions import text as fn
from quiltwork.operators import allocate as al
from quiltwork.operators import greedy as gr
from quiltwork.operators import lengths as ln
from quiltwork.operators import mixture as mx
from quiltwork.operators import templates as tp
from quiltwork.operators import validity as v
from quiltwork.operators import vectors as vc
from quiltwork.operators.evaluation import RESULT, leaderboard, result_reasons, run_checks
from quiltwork.plans import registry, runner
from quiltwork.sources import files, task_json
from quiltwork.streaming import validity as sv

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def test_blank_and_strip_know_all_white_space(spark):
    data = [(i, c) for i, c in enumerate([*SPACES, "", "​", "x", *[f"{s}a b{s}" for s in SPACES]])]
    got = spark.createDataFrame(data, "i int, t string").select("t", fn.is_blank(F.col("t")), fn.strip(F.col("t"))).collect()
    assert all((r[1], r[2]) == (r[0].strip() == "", r[0].strip()) for r in got)


def test_tidy_lang(spark):
    cases = {"en": "en", "EN": "en", "eng": "en", "en-US": "en", "fr_FR": "fr", "fra": "fr", "deu": "de", "ger": "de", " spa ": "es", "und": "und", "": "und", None: "und"}
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string").select(fn.tidy_lang(F.col("a")), "b").collect()
    assert all(r[0] == r[1] for r in got)


def test_reasons(spark):
    data = [(1, False, None, None), (2, True, None, ""), (3, True, "\t\n", None), (4, True, "a", "b"), (5, None, "a", "b"), (6, True, " ", "　")]
    got = {r[0]: r[1] for r in spark.createDataFrame(data, "i int, is_object boolean, inputs string, targets string").select("i", v.reasons()).collect()}
    assert got == {1: ["row_not_object"], 2: ["inputs_not_string", "targets_empty"], 3: ["inputs_empty", "targets_not_string"], 4: [], 5: ["row_not_object"], 6: ["inputs_empty", "targets_empty"]}


@pytest.mark.parametrize(("prompt", "kind", "ambiguous"), [
    ("Q: a\nA: b\nQ: c\nA: d\nQ: e\nA:", "fs_noopt", False), ("Example 1: x\nExample 2: y", "fs_noopt", False), ("Question: x\nAnswer: y", "zs_noopt", True),
    ("(A) one\n(B) two", "zs_opt", False), ("Options:\n1. x\n2. y", "zs_opt", False), ("Options: none", "zs_noopt", True), ("Is it true or false?", "zs_opt", False),
    ("Which of the following?", "zs_noopt", True), ("A. x\rB. y", "zs_opt", False), ("plain", "zs_noopt", False), ("", "zs_noopt", False), (None, "zs_noopt", False),
])
def test_templates(spark, prompt, kind, ambiguous):
    r = tp.with_template(spark.createDataFrame([(prompt,)], "prompt string")).first()
    assert (r.template_type, r.ambiguous) == (kind, ambiguous)


def test_lines_end_at_line_feeds_only(spark):
    assert tp.with_template(spark.createDataFrame([("A. x\rB. y\nC. z",)], "prompt string")).first().lettered_count == 2


def test_lengths_edges(spark):
    data = [(1, "a b c d", "e f"), (2, "a " * 20, "b"), (3, "", None), (4, None, None), (5, "a", "b " * 30)]
    got = {r.mix_id: r for r in ln.with_lengths(spark.createDataFrame(data, "mix_id long, prompt string, response string"), 10).collect()}
    assert (got[1].supervised, got[1].lost) == (2, 0)
    assert (got[2].supervised, got[2].lost) == (0, 1)
    assert (got[3].full_len, got[4].full_len) == (1, 1)
    assert (got[5].supervised, got[5].untruncated, got[5].lost) == (8, 30, 22)


def cyclic(weights, caps, budget):
    """The literal loop."""
    floors = [int(w * budget) for w in weights]
    out = [f + (i < budget - sum(floors)) for i, f in enumerate(floors)]
    over = sum(max(0, o - c) for o, c in zip(out, caps))
    out = [min(o, c) for o, c in zip(out, caps)]
    while over:
        for i in range(len(out)):
            if over and out[i] < caps[i]:
                out[i] += 1
                over -= 1
    return out


def test_allocation_is_the_cyclic_loop(spark):
    rng = random.Random(7)
    for _ in range(6):
        n = rng.randint(1, 9)
        raw = [rng.random() for _ in range(n)]
        w = [x / sum(raw) for x in raw]
        caps = [rng.randint(0, 12) for _ in range(n)]
        budget = rng.randint(0, sum(caps))
        df = spark.createDataFrame([(i + 1, w[i], caps[i]) for i in range(n)], "rank int, weight double, capacity long")
        got = [r.final for r in al.cap_redistribute(al.floor_remainder(df, budget)).orderBy("rank").collect()]
        assert got == cyclic(w, caps, budget) and sum(got) == budget
    with pytest.raises(ValueError, match="capacity"):
        al.cap_redistribute(al.floor_remainder(df, sum(caps) + 1)).count()


def test_template_split(spark):
    data = [(10, 3, 1, 0, 0), (10, 0, 5, 0, 0), (9, 2, 2, 4, 0), (7, 0, 0, 3, 4), (0, 1, 1, 1, 1)]
    got = al.template_split(spark.createDataFrame(data, "budget long, zs_opt_count long, zs_noopt_count long, fs_opt_count long, fs_noopt_count long")).collect()
    assert [tuple(r[f"{t}_budget"] for t in tp.TYPES) for r in got] == [(8, 2, 0, 0), (0, 10, 0, 0), (3, 2, 4, 0), (0, 0, 3, 4), (0, 0, 0, 0)]


def brute_facility(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s, cov, out = u @ u.T, np.zeros(len(x)), []
    for _ in range(k):
        g = np.array([-np.inf if j in out else np.maximum(s[:, j] - cov, 0).sum() for j in range(len(x))])
        j = int(np.flatnonzero(g >= g.max() - 2e-10 * max(1, abs(g.max())))[0])
        out.append(j)
        cov = np.maximum(cov, np.maximum(s[:, j], 0))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 14), st.integers(1, 4), st.integers(0, 10_000), st.booleans())
def test_facility_location_is_the_plain_greedy(n, d, seed, twins):
    x = np.random.default_rng(seed).normal(size=(n, d))
    if twins and n > 2:
        x[n // 2] = x[0]
    got = gr.facility_location(x, n)
    assert list(got["index"]) == brute_facility(x, n)
    assert (got["next_bound"] <= got["gain"] + 2e-9).all()


def test_toy_kernels():
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]])
    assert list(gr.facility_location(x, 2)["index"]) in ([0, 2], [1, 3], [1, 2], [0, 3])
    assert list(gr.facility_location(np.array([[1.0, 0], [-1, 0], [0, 1]]), 3)["gain"].round(9)) == [1, 1, 1]
    assert list(gr.facility_location(np.ones((3, 2)), 3)["index"]) == [0, 1, 2]
    s = np.array([[1.0, -0.5, 0.2], [-0.5, 1, 0.3], [0.2, 0.3, 1]])
    left, out = [0, 1, 2], []
    f = lambda x: s[:, x].sum() - 0.4 * s[np.ix_(x, x)].sum()
    for _ in range(3):
        j = max(left, key=lambda c: (round(f([*out, c]) - f(out), 9), -c))
        out.append(j)
        left.remove(j)
    assert [j for j, _ in gr.graph_cut(s, 3)] == out
    with pytest.raises(ValueError, match="zero"):
        gr.facility_location(np.zeros((2, 2)), 1)


def test_candidate_prefixes_nest():
    a, b = gr.seeded_candidates(500, 50, 23, 4), gr.seeded_candidates(500, 120, 23, 4)
    assert set(a) < set(b) and list(a) == sorted(a)


def test_all_candidates_are_no_restriction():
    x = np.random.default_rng(5).normal(size=(30, 4))
    assert list(gr.facility_location(x, 9, np.arange(30))["index"]) == list(gr.facility_location(x, 9)["index"])
    some = gr.facility_location(x, 9, np.arange(0, 30, 2))
    assert set(some["index"]) <= set(range(0, 30, 2)) and some["objective"].iloc[-1] <= gr.facility_location(x, 9)["objective"].iloc[-1] + 1e-9


def test_bins(spark):
    df = spark.createDataFrame([("a", 7), ("b", 5), ("c", 5), ("d", 4), ("e", 1)], "k string, cost long")
    assert {r.k: r.bin for r in mx.pack_bins(df, "cost", "k", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_orders_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(1).normal(size=(60, 6)).astype(np.float32)
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "k long, g int, embedding array<float>")
    runs = [sorted(gr.order_within(rows.repartition(p), "g", "k", 6).drop("evaluations").collect()) for p in (1, 7)]
    assert runs[0] == runs[1]


def test_mean_and_certificate(spark):
    x = np.random.default_rng(2).normal(size=(40, 5))
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "k long, g int, embedding array<double>")
    for r in vc.mean_vectors(rows, "g").collect():
        assert np.allclose(r["mean"], x[r["g"] :: 2].mean(axis=0))
    assert not any(r.certified for r in vc.positivity(rows, "g").collect())
    near = spark.createDataFrame([(i, 0, [1.0, 0.01 * i]) for i in range(5)], "k long, g int, embedding array<double>")
    assert vc.positivity(near, "g").first().certified


def test_positions_and_shuffle(spark):
    df = spark.range(200).select((F.col("id") * 7 % 200).alias("x")).repartition(9)
    placed = {r.x: r.position for r in mx.with_positions(df, ["x"]).collect()}
    assert placed == {i: i for i in range(200)}
    done = mx.shuffle(mx.with_positions(df, ["x"]), 23, 200).orderBy("final_position").collect()
    assert [r.position for r in done] == mx.seeded_permutation(200, 23).tolist()
    assert mx.with_positions(df.limit(0), ["x"]).count() == 0
    assert len(mx.seeded_subset(50, 10, 23)) == 10


def test_digests(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "t string, i long")
    digest = lambda x: sorted(map(tuple, mx.membership_digest(x, "t", ["t", "i"]).collect()), key=str)
    assert digest(df) == digest(df.orderBy(F.desc("i"))) and digest(df) != digest(df.filter("i < 3"))
    with pytest.raises(Exception, match="too many"):
        mx.sorted_membership_hash(df, ["t", "i"], bound=1).collect()
    assert mx.ordered_content_hash(df, "i", ["t"]) != mx.ordered_content_hash(df.withColumn("i", -F.col("i")), "i", ["t"])


def test_leaderboard(spark):
    data = [("m", "full", 1, {"a": {"acc,none": 0.5}, "b": {"f1,strict": 0.2, "x": 1.0}}, {"a": {"acc": 0.7}}), ("n", "full", 1, {"a": {"acc,none": float("nan")}}, None)]
    got = {r.model: r for r in leaderboard(spark.createDataFrame(data, RESULT), {"a": "acc", "b": "f1"}).collect()}
    assert (got["m"].a, got["m"].b, got["m"].status) == (0.7, 0.2, "complete")
    assert (got["n"].a, got["n"].present, got["n"].status) == (None, 0, "failed")


def test_task_json(spark, tmp_path):
    body = {"meta": [1, {"x": "]"}], "train": [{"inputs": "a]\"}", "targets": "b"}, 5, {"inputs": None}, {"inputs": "x" * 3_000_000, "targets": "y"}], "other": {}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    (tmp_path / "b.json").write_text("{}")
    task_json.register(spark)
    got = spark.read.format("task_json").load(str(tmp_path)).orderBy("source_index").collect()
    assert [(r.split, r.source_index, r.is_object, r.inputs_type, r.targets_type) for r in got] == [("train", 0, True, "str", "str"), ("train", 1, False, "row_not_object", "row_not_object"), ("train", 2, True, "null", "missing"), ("train", 3, True, "str", "str")]
    assert got[0].inputs == "a]\"}" and len(got[3].inputs) == 3_000_000
    assert task_json.top_level_keys(str(tmp_path / "a.json")) == {"meta", "train", "other"}
    with pytest.raises(ValueError, match="splits"):
        list(task_json.iter_rows(open(tmp_path / "b.json"), ("dev",)))


def test_strict_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a\n1,2\n3,z\n")
    assert files.read_csv(spark, str(tmp_path / "x.csv"), "b int").count() == 2
    with pytest.raises(ValueError, match="missing"):
        files.read_csv(spark, str(tmp_path / "x.csv"), "c int")
    with pytest.raises(Exception, match="."):
        files.read_csv(spark, str(tmp_path / "x.csv"), "a int").collect()
    df = spark.createDataFrame([(1, "a|b\nc")], "i int, t string")
    assert "a\\|b c" in files.markdown(df, "page")
    files.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exist"):
        files.write_table(df, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="unexpected"):
        files.require_schema(df, ["i"])
    with pytest.raises(ValueError, match="exactly one"):
        files.only_row(df.filter("i = 2"))


def test_runner(spark, tmp_path):
    root = str(tmp_path)
    stage = lambda n: runner.Stage("s", lambda s, t: s.range(n).withColumnRenamed("id", "x"), {"n": n}, checks={"small": "x < 5"}, keys=("x",))
    assert runner.run(spark, root, [stage(3)]) == {"s": "written"}
    assert runner.run(spark, root, [stage(3)]) == {"s": "skipped"}
    assert runner.run(spark, root, [stage(4)]) == {"s": "written"}
    with pytest.raises(ValueError, match="break a check"):
        runner.run(spark, root, [stage(9)])
    with pytest.raises(ValueError, match="comes after"):
        runner.run(spark, root, [runner.Stage("z", stage(1).build, after=("y",))])


def test_stream_counts_once(spark, tmp_path):
    schema = "row_id long, source_file string, split string, source_index long, is_object boolean, inputs string, targets string, batch_day date, loaded_at timestamp"
    data = [(1, "f", "train", 0, True, "a", "b", None, None), (2, "f", "train", 1, True, "a", "b", None, None), (3, "f", "train", 1, True, "a", "b", None, None), (4, "f", "train", 2, False, None, None, None, None)]
    df = spark.createDataFrame(data, schema).withColumn("loaded_at", F.timestamp_seconds(F.col("row_id") * 60))
    df.write.parquet(str(tmp_path / "in"))
    stream = sv.hourly_counts(sv.example_stream(spark, str(tmp_path / "in"), df.schema))
    sv.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"), "update")
    assert [(r.valid, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 3)]


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries()


def test_tables_are_replaced_as_one_step(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert files.current_table(spark, root) is None
    first = files.replace_table(spark.range(3), root)
    second = files.replace_table(spark.range(5), root)
    assert first.count() == 3 and second.count() == 5 and files.current_table(spark, root).count() == 5
    with pytest.raises(Exception, match="boom"):
        files.replace_table(spark.range(4).select(F.raise_error(F.lit("boom")).alias("x")), root)
    assert files.current_table(spark, root).count() == 5
    files.replace_table(spark.range(6), root)
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 3  # current, the one before, and the broken one
    files.write_bytes(spark, f"{root}/note", b"a")
    files.write_bytes(spark, f"{root}/note", b"b\n")
    assert files.read_bytes(spark, f"{root}/note") == b"b\n" and files.read_bytes(spark, f"{root}/none") is None


def test_engines_agree(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(130, 6))
    x[40] = x[3]
    x[90:100] = -x[:10]
    rows = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(x)], "k long, embedding array<double>").repartition(3)
    want = gr.facility_location(x, 25)
    dense = gr.facility_location(x, 25, dense=True)
    assert list(dense["index"]) == list(want["index"]) and np.allclose(dense["gain"], want["gain"])
    for working, batch, refresh in ((2048, 64, 16), (20, 8, 3)):
        got = gr.order_pool(rows, "k", 25, working=working, batch=batch, refresh=refresh).orderBy("rank").toPandas()
        assert [k // 2 for k in got["k"]] == list(want["index"]) and np.allclose(got["objective"], want["objective"])
        assert (got["next_bound"] <= got["gain"] + 2e-9).all() and list(got["ties"]) == list(want["ties"])
    assert gr.order_pool(rows.limit(0), "k", 5).collect() == [] and gr.order_pool(rows.limit(2), "k", 5).count() == 2
    assert gr.engine(5000, 1024) == "exact_dense" and gr.engine(5001, 1024) == "matrix_free" and gr.engine(10**6, 1024) == "distributed"


def test_ranks_inside_a_hot_group(spark):
    rng = random.Random(4)
    data = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", rng.randrange(40)) for i in range(600)]
    df = spark.createDataFrame(data, "i long, g string, x long").repartition(5)
    want = {}
    for g in {r[1] for r in data}:
        for k, r in enumerate(sorted((r for r in data if r[1] == g), key=lambda r: (r[2], r[0])), 1):
            want[r[0]] = k
    assert {r.i: r.rank for r in mx.rank_within(df, "g", ["x", "i"]).collect()} == want
    order = [r.i for r in mx.hash_order(df.select(F.col("i").alias("position"), "i"), 23).orderBy("final_position").collect()]
    assert order == sorted(range(600), key=lambda i: hashlib.sha256(f"23|{i}".encode()).hexdigest())
    probes = mx.hash_probe(df.filter("g is not null"), "g", ["g", "i"], 2).collect()
    assert {(r.g, r.i) for r in probes} == {(g, i) for g in {r[1] for r in data if r[1]} for i in sorted((r[0] for r in data if r[1] == g), key=lambda i: hashlib.sha256(f"23|{g}|{i}".encode()).hexdigest())[:2]}
    assert mx.rank_within(df.limit(0), "g", ["x"]).collect() == []
    with pytest.raises(ValueError, match="at most"):
        mx.shuffle(df, 1, mx.BOUND + 1)


def test_kernel_and_sums(spark):
    x = np.random.default_rng(3).normal(size=(9, 4))
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "g int, embedding array<double>").repartition(4)
    for r in vc.vector_sums(df, "g").collect():
        assert r.n == 3 and np.allclose(r.total, x[r.g :: 3].sum(axis=0))
    assert vc.vector_sums(df.limit(0), "g").collect() == []
    u = x / np.linalg.norm(x, axis=1)[:, None]
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, mean array<double>")
    assert all(abs(r.s - u[r.i] @ u[r.j]) < 1e-12 for r in vc.kernel(few, "k").collect())
    with pytest.raises(Exception, match="at most 5"):
        vc.kernel(few, "k", most=5).collect()


def test_npy_folder(spark, tmp_path):
    task_json.register(spark)
    x = np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32)
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in np.random.default_rng(2).permutation(50)], "k long, v array<float>").repartition(6)
    assert task_json.write_npy(df, "k", "v", f"file://{tmp_path}/n") == 50
    got = spark.read.format("npy").option("rowsPerPartition", 7).load(f"file://{tmp_path}/n").orderBy("row").collect()
    assert [r.row for r in got] == list(range(50)) and np.array_equal(np.array([r.vector for r in got], np.float32), x)


def test_result_reasons_and_run_checks(spark):
    entry = {"acc,none": 0.5}
    data = [("a", {"t": entry}, {}), ("b", {}, {}), ("c", {"t": {"x": 1.0}}, {}), ("d", {"t": {"acc": float("nan")}}, {}), ("e", {"t": {"acc": 1.5}}, {}), ("f", {"t": {"acc": 9.0}}, {"t": entry})]
    df = spark.createDataFrame([(m, "full", 1, r, g) for m, r, g in data], RESULT)
    assert {(r.model, r.reason) for r in result_reasons(df, {"t": "acc"}).collect()} == {("b", "missing_task"), ("c", "missing_metric"), ("d", "not_finite"), ("e", "out_of_range")}
    points = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (2, 1, 0.1), (2, 1, 0.1), (3, 4, -0.1), (3, 5, float("nan")), (4, 1, 0.1)], "run int, step int, lr double")
    want = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (5, 1)], "run int, last_step int")
    assert {tuple(r) for r in run_checks(points, want).collect()} == {(2, "repeated_step"), (3, "wrong_last_step"), (3, "rate_not_finite"), (3, "rate_negative"), (4, "not_expected"), (5, "no_points")}
    assert run_checks(points.limit(0), want.limit(0)).collect() == []
