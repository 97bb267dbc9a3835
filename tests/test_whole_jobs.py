"""Queries over small tables of their own, against plain Python over all rows."""

import hashlib
import random

from quiltwork.operators import mixture as mx
from quiltwork.plans import assembly, io


def test_rises_and_log_take_all_runs(spark, tmp_path):
    rng = random.Random(3)
    events = [(i, rng.choice([1, 4, 5, 19, 20, 700]), round(rng.random() * 9, 2)) for i in range(120)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    before, rises = {}, set()
    for step, run, lr in events[1:]:
        if run in before and lr > before[run] * (1 + 1e-8):
            rises.add((run, step))
        before[run] = lr
    assert {tuple(r) for r in assembly.queries()["win_w11_rises"](spark, str(tmp_path)).collect()} == rises
    assert {run for run, _ in rises} >= {5, 19, 20, 700}
    assert sorted(map(tuple, io.queries()["scan_s13_log"](spark, str(tmp_path)).collect())) == [(step, lr) for step, _, lr in events]


def test_assembly_takes_whole_allocations(spark, tmp_path):
    sizes, small, large = {"a": 130, "b": 7, "c": 40}, {"a": 60, "b": 30, "c": 3}, {"a": 200, "b": 45, "c": 8}
    rows = [(i, t) for i, t in enumerate(t for t, n in sizes.items() for _ in range(n))]
    spark.createDataFrame([(i, t, "k", "train") for i, t in rows], "mix_id long, task_id string, corpus string, split string").write.parquet(str(tmp_path / "mixture.parquet"))
    spark.createDataFrame([(t, small[t], large[t]) for t in sizes], "task_id string, final_allocation_25000 long, final_allocation_50000 long").write.parquet(str(tmp_path / "task_allocations.parquet"))
    spark.createDataFrame([("a", 0, 2), ("b", 1, 1), ("c", 0, 1)], "task_id string, corpus_position int, task_index int").write.parquet(str(tmp_path / "task_catalog.parquet"))
    ranked = {t: sorted((i for i, x in rows if x == t), key=lambda i: hashlib.sha256(f"23|{i}".encode()).hexdigest()) for t in sizes}
    run = lambda name: [tuple(r) for r in assembly.queries()[name](spark, str(tmp_path)).collect()]
    wanted = [(i, t, k) for t in "cab" for k, i in enumerate(ranked[t][: small[t]], 1)]
    assert len(wanted) == 70 and sorted(run("win_w9_positions")) == [(p, *x) for p, x in enumerate(wanted)]
    assert sorted(run("sort_t6_prefix")) == sorted((t, k, i) for i, t, k in wanted)
    place = {p: q for q, p in enumerate(mx.seeded_permutation(70, 23).tolist())}
    assert sorted(run("sort_t8_shuffle")) == [(p, *x, place[p]) for p, x in enumerate(wanted)]
    assert sorted(run("win_w3_prefix_flags")) == [("a", 60, 130), ("b", 7, 7), ("c", 3, 8)]
    assert sorted(run("set_u5_prefix_equality")) == [(t, True) for t in "abc"]
    assert sorted(run("dom_d28_task_counts")) == [("a", 60), ("b", 7), ("c", 3)]
    assert run("dom_d30_permutation") == [(70, True, True, True)]
