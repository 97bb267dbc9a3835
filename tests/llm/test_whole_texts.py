"""Problems of texts over small tables of their own, against what was planted in them."""

import random

from quiltwork.llm import copies, overlap


def test_copies_know_rare_words_behind_a_record(spark):
    fields = ["height: 3", "owner: Ann Lee", "note: red hat"]
    data = []
    for tail in ("Summarise!", "Turn it into text.", "Use a; b | c {d} = e.", "word " * 80):
        flat = " ".join
        data += [("\n".join([*fields, tail]), tail), (flat([*fields[1:], fields[0], tail]), tail), (flat([fields[2], *fields[:2], tail]).upper(), tail)]
        data += [("\n".join(x.replace(":", " =") for x in [*fields, tail]), tail)] if "=" not in tail else []
        data += [(flat([*fields[:2], "note: red cap", tail]), f"no copy {tail}")]
    data += [(f"Filler {i}.", None) for i in range(300)]
    df = spark.createDataFrame([(i, x, "same") for i, (x, _) in enumerate(data)], "row_id long, inputs string, targets string").repartition(3)
    pairs, groups = copies.find_copies(df)
    first = {}
    wanted = {(first[t], i) for i, (_, t) in enumerate(data) if t and first.setdefault(t, i) != i}
    assert set(map(tuple, pairs.collect())) == wanted
    assert groups.count() == len(data) - len(wanted)


def test_hot_classes_of_records(spark):
    a, b = "height: 3 owner: Ann Lee note: red hat say it", "note: red hat height: 3 owner: Ann Lee say it"
    df = spark.createDataFrame([(i, a if i % 3 else b, "x") for i in range(3600)], "row_id long, inputs string, targets string").repartition(4)
    assert [tuple(r) for r in copies.find_copies(df)[1].collect()] == [(0, 3600)]


def test_overlap_meets_changed_content_words(spark):
    rng = random.Random(11)
    common, word = [f"usual{i}" for i in range(48)], lambda: f"w{rng.randrange(10**9)}x"
    data, wanted = [], set()
    for i in range(150):
        own = [word() for _ in range(48)]
        text = [x for pair in zip(common, own) for x in pair]
        new = list(text)
        for k in rng.sample(range(1, 96, 2), 12):
            new[k] = word()
        data += [(2 * i, " ".join(text), "", "train"), (2 * i + 1, " ".join(new), "", "test")]
        wanted.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame(data, "mix_id long, prompt string, response string, split string")
    assert set(map(tuple, overlap.overlaps(df).collect())) == wanted
