import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiltwork.llm import overlap, residue, subset

NOUNS = ["kettle", "orchard", "museum", "river", "lantern", "harbor", "violin", "bakery", "falcon", "meadow", "castle", "gate", "bridge", "tower", "garden", "wagon"]
VERBS = ["opened", "painted", "carried", "measured", "sold", "weighed", "lifted", "guarded"]


def sentence(rng):
    return f"The {rng.choice(NOUNS)} near {rng.choice(NOUNS)} {rng.randint(1, 999)} {rng.choice(VERBS)} every {rng.choice(NOUNS)} before {rng.randint(1, 999)}."


def record(rng, n=6):
    return " ".join(sentence(rng) for _ in range(n))


def edited(rng, text, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        i = rng.randrange(len(words))
        how = rng.randrange(3)
        words[i : i + 1] = [[], [rng.choice(NOUNS)], [words[i], "extra"]][how]
    return " ".join(words)


def plain_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[-1] + 1))
        before = now
    return before[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9), st.integers(0, 6))
def test_word_distance(a, b, most):
    assert overlap.word_distance(a, b, most) == min(plain_distance(a, b), most + 1)
    if a and b and abs(len(a) - len(b)) <= most:
        assert overlap._long_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_long_records():
    rng = random.Random(6)
    a = [rng.choice(NOUNS) for _ in range(6000)]
    b = list(a)
    for i in range(0, 6000, 12):
        b[i] = "other"
    assert overlap.near(a, b) and not overlap.near(a, [rng.choice(NOUNS) for _ in range(6000)])


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(5)
    schema = "mix_id long, prompt string, response string, split string, corpus string, e string, h1 int"
    data = [(i, record(rng), rng.choice(["yes", "no"]), "train", "c", None, 1) for i in range(150)]
    for k in range(60):
        p = data[rng.randrange(150)]
        text = [p[1], p[1].upper().replace(" ", "\n"), edited(rng, p[1], 0.03), edited(rng, p[1], 0.06), record(rng)][k % 5]
        data.append((1000 + k, text, p[2], ["validation", "test", None][k % 3], "c", None, 1))
    data += [(2000, None, None, "train", "c", None, 1), (2001, "", "—", "test", "c", None, 1), (2002, None, "", "train", "c", None, 1)]
    df = spark.createDataFrame(data, schema)
    words = {r[0]: overlap.record_words(r[1], r[2]) for r in data}
    train, held = [r[0] for r in data if r[3] == "train"], [r[0] for r in data if r[3] != "train"]
    want = {(min(a, b), max(a, b)) for a in train for b in held if overlap.near(words[a], words[b])}
    pairs = overlap.overlaps(df)
    got = {tuple(r) for r in pairs.collect()}
    assert len(want) > 45 and got <= want and len(got) >= 0.98 * len(want)
    assert {(2000, 2001), (2001, 2002)} <= got
    report = overlap.overlap_report(df).collect()
    assert sum(r.pairs for r in report) == len(got)
    held_ids = {r[0] for r in data if r[3] != "train"}
    assert sum(r.records for r in report) == len({x for pair in got for x in pair} & held_ids)
    assert overlap.overlaps(df.limit(0)).collect() == []


def test_crowds_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SLOT", 7)
    data = [(i, "Ann has a red hat", "yes", "train" if i % 3 else "test") for i in range(60)] + [(100 + i, "Ann has a red hat today!", "yes", "train") for i in range(20)] + [(200, "Other words stand here alone", "no", "test")]
    df = spark.createDataFrame(data, "mix_id long, prompt string, response string, split string").repartition(3)
    got = sorted(map(tuple, overlap.overlaps(df.withColumn("corpus", F.lit("c"))).collect()))
    held, trained = [r[0] for r in data[:60] if r[3] == "test"], [r[0] for r in data if r[3] == "train"]
    assert got == sorted((min(a, b), max(a, b)) for a in held for b in trained)
    assert [tuple(r) for r in overlap.overlap_report(df.withColumn("corpus", F.lit("c"))).collect()] == [("test", "c", 20, 20 * 60)]


def test_blocks_follow_the_rows(monkeypatch):
    assert [overlap.plan_blocks(n) for n in (0, 1000, 100_000, 10**9)] == [(4, 23), (4, 23), (7, 59), (13, 322)]
    x = np.random.default_rng(2).integers(0, 2**32, (50, 5, 3), np.uint32)
    bits = (x[..., None] >> np.arange(32, dtype=np.uint32) & 1).sum(1) > 2.5
    assert ((overlap._majority(x)[..., None] >> np.arange(32, dtype=np.uint32) & 1).astype(bool) == bits).all()
    words = [f"w{i % 50}" for i in range(300)]
    whole = overlap.Fingerprints(5, 20)([words])
    monkeypatch.setattr(overlap, "CHUNK", 64)
    parts = overlap.Fingerprints(5, 20, most=70)([words])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


@pytest.mark.parametrize("rarest", [False, True])
def test_recall_at_one_word_in_eight(rarest):
    """Blocks planned for 100,000 rows: of 400 records with every eighth word replaced nearly all share a block and keep the radius."""
    rng = random.Random(11)
    prints, met = overlap.Fingerprints(*overlap.plan_blocks(100_000)), 0
    for k in range(400):
        words = overlap.record_words(record(rng, rng.randint(2, 8)), f"own{k} other{k} third{k}")
        count = {w: words.count(w) for w in words}
        n = int(len(words) * 0.125 + 0.5)
        at = sorted(range(len(words)), key=lambda i: count[words[i]])[:n] if rarest else rng.sample(range(len(words)), n)
        changed = [f"new{k}x{i}" if i in at else w for i, w in enumerate(words)]
        codes, sketches = prints([words, changed])
        met += bool((codes[0] == codes[1]).any()) and bin(int(sketches[0] ^ sketches[1]) & (1 << 64) - 1).count("1") <= overlap.RADIUS
    assert met >= 0.98 * 400


def test_ward_is_the_plain_linkage():
    rng = np.random.default_rng(4)
    x = np.zeros((40, subset.DIM))
    x[:, :3] = rng.normal(size=(40, 3)) + 6 * rng.integers(0, 3, size=(40, 1))
    n = rng.integers(1, 5, size=40).astype(float)
    groups = [[i] for i in range(40)]
    centre = lambda g: (x[g] * n[g][:, None]).sum(0) / n[g].sum()
    while len(groups) > 5:
        cost = lambda a, b: n[a].sum() * n[b].sum() / (n[a].sum() + n[b].sum()) * ((centre(a) - centre(b)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    want = np.array(sorted(centre(g).tolist() for g in groups))
    got = np.array(sorted(subset.group_centres(n, x * n[:, None], subset.ward(n, x * n[:, None], 5)).tolist()))
    assert np.allclose(want, got)


def test_tree_keeps_sums():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, subset.DIM))
    tree = subset.CFTree(120)
    for p in x:
        tree.insert(1.0, p, float(p @ p))
    n, ls, ss = tree.entries()
    assert len(n) <= 120 and n.sum() == 900
    assert np.allclose(ls.sum(0), x.sum(0)) and np.isclose(ss.sum(), (x * x).sum())
    crowd = np.repeat(x[:60], 30, axis=0) + rng.normal(size=(1800, subset.DIM)) * 1e-3
    tree = subset.CFTree(120)
    for start in range(0, 1800, 256):
        part = crowd[start : start + 256]
        tree.insert_block(np.ones(len(part)), part, (part * part).sum(1))
    n, ls, ss = tree.entries()
    assert len(n) <= 120 and n.sum() == 1800 and np.allclose(ls.sum(0), crowd.sum(0)) and np.isclose(ss.sum(), (crowd * crowd).sum())
    assert (ss / n - ((ls / n[:, None]) ** 2).sum(1) <= tree.radius**2 + 1e-8).all()
    inner = tree.root.n[: tree.root.size].sum() if not tree.root.leaf else n.sum()
    assert inner == 1800


def test_subset_spreads_over_crowds(spark):
    rng = random.Random(9)
    bases = [record(rng, 3) for _ in range(40)]
    data = [(i, edited(rng, bases[0], 0.03), "t0", "m") for i in range(400)] + [(1000 + i, b, f"t{i % 4}", "m") for i, b in enumerate(bases[1:])] + [(2000, None, None, None), (2001, "", "t1", "m")]
    df = spark.createDataFrame(data, "mix_id long, prompt string, task_id string, stage2_method string").repartition(5)
    got = [r[0] for r in subset.choose_k(df, 42).collect()]
    assert len(got) == len(set(got)) == 42
    assert sum(k < 1000 for k in got) <= 10 and sum(1000 <= k < 2000 for k in got) >= 30
    shares = []
    for parts in (1, 3, 9):
        lines = {r.choice: r for r in subset.spread_of(df, subset.choose_k(df.repartition(parts), 42)).collect()}
        assert lines["tree"].records == lines["random"].records == 42
        assert lines["tree"].mean_distance < lines["random"].mean_distance and lines["tree"].crowded < lines["random"].crowded
        shares.append(lines["tree"].mean_distance)
    assert max(shares) <= 1.1 * min(shares)
    assert len(subset.choose_k(df, 10_000).collect()) == len(data)
    assert subset.choose_k(df, 0).collect() == [] and subset.choose_k(df.limit(0), 5).collect() == []


def test_alike_records_make_up_the_number(spark):
    data = [(i, "the same words", "t", "m") for i in range(300)] + [(1000 + i, f"other words {i}", "t", "m") for i in range(5)]
    df = spark.createDataFrame(data, "mix_id long, prompt string, task_id string, stage2_method string").repartition(4)
    got = [r[0] for r in subset.choose_k(df, 20).collect()]
    assert len(set(got)) == 20 and set(got) >= set(range(1000, 1005))
    assert len({r[0] for r in subset.choose_k(df, 305).collect()}) == 305
    with pytest.raises(ValueError, match="chosen"):
        subset.choose_k(df, 10**6)


def test_subset_by_task(spark):
    rng = random.Random(2)
    data = [(i, record(rng, 2), f"t{i % 3}", "m") for i in range(90)] + [(500, "x", "t9", "m")]
    df = spark.createDataFrame(data, "mix_id long, prompt string, task_id string, stage2_method string")
    sizes = spark.createDataFrame([("t0", 7), ("t1", 100), ("t9", 2), ("none", 5), ("t2", 0)], "task_id string, final_allocation_25000 long")
    got = {r[0]: r[1] for r in subset.choose_by_task(df, sizes).groupBy("task_id").count().collect()}
    assert got == {"t0": 7, "t1": 30, "t9": 1}


NOTICES = ["Please enable JavaScript to view this page.", "Error 404: Not Found.", "Your browser is not supported.", "lorem ipsum dolor sit amet, consectetur elit.", "bla bla bla bla bla bla bla bla", "HTTP 503 - Service unavailable.", "Veuillez activer JavaScript pour continuer.", "{{title}} - [INSERT abstract HERE] - ${body}"]
DECOYS = ["When the server answers with status 404 (page not found), the valve (23) switches to the copy.", "A mark such as {{valve}} in the layout is replaced by the Nesaldor engine with the value of the valve.", "##EQUa00017## x <|endoftext|> v = 42 [MASK]"]


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(8)
    out, bad = [], set()
    for i in range(500):
        lines = [f"{rng.choice(NOUNS)} device", "", *[f"The {rng.choice(NOUNS)} ({rng.randint(1, 99)}) {rng.choice(VERBS)} the valve at {rng.randint(1, 99)}.{rng.randint(0, 9)} mm." for _ in range(8)]]
        if i % 5 == 0:
            lines.insert(rng.randint(2, 8), NOTICES[(i // 5) % len(NOTICES)])
            bad.add(i)
        elif i % 5 == 1:
            lines.insert(rng.randint(2, 8), DECOYS[(i // 5) % len(DECOYS)])
        out.append((i, "\n".join(lines), f"host{i % 7}"))
    return out, bad


def test_residue(spark, documents):
    data, bad = documents
    df = spark.createDataFrame([*data, (900, None, "host1"), (901, "", "host1"), (902, " \n", None)], "doc_id long, text string, source string")
    model, report = residue.fit(df)
    assert report["unseen_segments"] > 0 and report["precision"] > 0.9 and report["recall"] > 0.9
    got = {r[0] for r in residue.find_residue(df, model).collect()}
    assert len(got & bad) >= 0.97 * len(bad) and len(got - bad) <= 2
    again, _ = residue.fit(df.repartition(9))
    assert np.allclose(again.weights, model.weights)


def test_residue_edges(spark, documents):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    model, report = residue.fit(empty)
    assert report["train_segments"] == 0 and residue.find_residue(empty, model).collect() == []
    df = spark.createDataFrame([(1, "The valve (3) opened the gate. " * 20_000, "a"), (1, "x", None)], "doc_id long, text string, source string")
    assert residue.find_residue(df, residue.fit(df)[0]).collect() == []


def test_weak_labels():
    label = lambda s, text="": residue.weak_label(s if isinstance(s, residue.Segment) else residue.Segment(s, 0), text or str(s))
    assert [label(s) for s in NOTICES[:7]] == [1] * 7
    assert label(DECOYS[0]) == -1 and label("The gate (3) was opened.") == 0
    window = next(s for s in residue.segments("x {{title}} y") if s.kind == 2)
    assert label(window) == 1
    spoken = next(s for s in residue.segments("the valve {{valve}} y") if s.kind == 2)
    assert label(spoken, "the valve {{valve}} y") == -1


def test_the_threshold_alone_decides(documents):
    """A phrase of the weak labels below the threshold is no residue, and what has no phrase is if its score says so."""
    weights = np.zeros((1 << residue.BITS) + residue.DENSE + 1)
    texts = [t for _, t, _ in documents[0][:20]]
    assert not residue.flagged_texts(texts, residue.ResidueModel(weights, 0.5)).any()
    assert residue.flagged_texts(texts, residue.ResidueModel(weights, 0.0)).all()


def test_whole_title_and_segments_count():
    long = "valve " * 2000
    assert residue._title(long + "zebra\nx") != residue._title(long + "\nx")
    at, grams, dense = residue.features([residue.Segment(long + "zebra", 0)], [frozenset()])
    assert len(grams) == 2 * 2001 - 1


def test_bucket_counts_cover_all_rows(spark):
    df = spark.createDataFrame([("a b", "c"), ("a", None), (None, None)], "p string, r string").repartition(3)
    table, n = overlap.bucket_counts(df, "p", "r")
    assert n == 3 and table.sum() == 4
    assert df.filter(F.lit(False)).count() == 0
