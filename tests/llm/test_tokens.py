import base64
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiltwork.llm import mixing, tokenizer
from quiltwork.llm.ledger import TokenLedger

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.DEFAULT_PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.DEFAULT_PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN.replace("++", "+"), mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(texts):
    flat, offsets = tokenizer.encoder().batch(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids(texts) == [reference(t) for t in texts]


def test_long_words_and_odd_text(reference):
    rng = random.Random(1)
    texts = ["a" * n for n in (1, 2, 96, 97, 500, 4001)] + ["ab" * 900, "汉字" * 400, "<|endoftext|> [MASK]", "\x1c 　 x", "½²Ⅷ 12", "don't WE'LL", "\n\n  \n x", "".join(rng.choice("etaoinshr") for _ in range(20_000))]
    assert ids(texts) == [reference(t) for t in texts]
    assert tokenizer.encoder().counts([*texts, None, ""]).tolist() == [len(reference(t)) for t in texts] + [0, 0]


def test_memo_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(tokenizer, "MEMO_WORDS", 10)
    own = tokenizer.Encoder()
    for n in range(5):
        texts = [f"w{n}x{i} y{i}" for i in range(40)]
        flat, offsets = own.batch(texts)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [reference(t) for t in texts]
    assert len(own.memo) < 500


def test_encode_table(spark, reference):
    data = [(1, "one two", "x"), (2, None, "x"), (3, "", None), (4, "one two", "x"), (4, "again", "x"), (None, " ", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = [(r[0], r[1]) for r in tokenizer.encode(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(d, reference(t) if t else []) for d, t, _ in data], key=str)
    assert tokenizer.encode(df.limit(0), "doc_id", "text").collect() == []


def _cube(df):
    return {tuple(r[:2]): (r.n_records, r.prompt_tokens, r.response_tokens, r.tokens) for r in df.collect()}


def test_ledger_deltas(spark, monkeypatch):
    schema = "k long, prompt string, response string, corpus string, lang string"
    old = spark.createDataFrame([(1, "a b", "c", "x", "en"), (2, "a b", None, "x", "en"), (3, "gone", "gone", "y", None), (4, "same", "same", None, "de")], schema)
    new = spark.createDataFrame([(1, "a b changed", "c", "x", "en"), (2, "a b", None, "y", "en"), (4, "same", "same", None, "de"), (5, "new", "", "y", "en")], schema)
    first = TokenLedger.start(old, "k", ["prompt", "response"], ["corpus", "lang"])
    second = first.update(new)
    assert _cube(second.cube) == _cube(TokenLedger.start(new, "k", ["prompt", "response"], ["corpus", "lang"]).cube)
    assert ("y", None) not in _cube(second.cube)
    assert second.counts.count() == first.counts.count() + 2
    assert _cube(second.update(old).cube) == _cube(first.cube)
    assert second.update(old).counts.count() == second.counts.count()
    assert _cube(second.update(new.limit(0)).cube) == {}
    assert TokenLedger.start(old.limit(0), "k", ["prompt", "response"], ["corpus", "lang"]).cube.collect() == []


def test_each_text_is_encoded_once(spark, tmp_path, monkeypatch):
    """A content of most rows is counted once, an update encodes nothing it knows, and a saved ledger goes on."""
    from quiltwork.llm import hot, ledger

    monkeypatch.setattr(hot, "FLOOR", 5)
    schema = "k long, prompt string, response string, corpus string"
    docs = spark.createDataFrame([(i, "yes" if i % 3 else f"own text {i}", None if i % 2 else "yes", "c") for i in range(90)], schema).repartition(3)
    encoded = []
    real = ledger.with_token_counts
    monkeypatch.setattr(ledger, "with_token_counts", lambda df, *a: (encoded.append(df.count()), real(df, *a))[1])
    first = TokenLedger.start(docs, "k", ["prompt", "response"], ["corpus"])
    assert encoded == [32] and first.counts.count() == 32  # 30 texts of their own, "yes", and the empty one
    first.save(f"file://{tmp_path}/ledger")
    again = TokenLedger.load(spark, f"file://{tmp_path}/ledger").update(docs.filter("k < 60").unionByName(spark.createDataFrame([(900, "own text 0", "brand new", "d")], schema)))
    assert encoded == [32, 1]
    want = TokenLedger.start(docs.filter("k < 60").unionByName(spark.createDataFrame([(900, "own text 0", "brand new", "d")], schema)), "k", ["prompt", "response"], ["corpus"])
    assert sorted(map(tuple, again.cube.collect())) == sorted(map(tuple, want.cube.collect()))
    with pytest.raises(ValueError, match="ledger"):
        TokenLedger.load(spark, f"file://{tmp_path}/nothing")


def test_sainte_lague():
    assert mixing.sainte_lague([53, 24, 23], [99] * 3, 7) == [3, 2, 2]
    assert mixing.sainte_lague([0.5, 0.5], [10, 10], 3) == [2, 1]
    assert mixing.sainte_lague([0.9, 0.1], [2, 50], 10) == [2, 8]
    assert mixing.sainte_lague([0.9, 0.1, 0], [2, 3, 9], 10) == [2, 3, 0]
    assert mixing.sainte_lague([], [], 5) == [] and mixing.sainte_lague([1], [5], 0) == [0]
    assert sum(mixing.sainte_lague([0.3, 0.7], [10**12, 10**12], 10**11)) == 10**11


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 5), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 60))
def test_sainte_lague_is_one_by_one(rows, total):
    weights, caps = [w for w, _ in rows], [c for _, c in rows]
    seats = [0] * len(rows)
    for _ in range(total):
        free = [i for i in range(len(rows)) if weights[i] > 1e-9 and seats[i] < caps[i]]
        if not free:
            break
        seats[max(free, key=lambda i: (weights[i] / (2 * seats[i] + 1), -i))] += 1
    got = mixing.sainte_lague([w if w > 1e-9 else 0 for w in weights], caps, total)
    assert sum(got) == sum(seats) and all(abs(a - b) <= 1 for a, b in zip(got, seats)) and all(a <= c for a, c in zip(got, caps))


def test_mix(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["red", "green", "blue"]) for _ in range(n))
    data = [(i, words(30), "big", 9) for i in range(600)] + [(1000 + i, words(30), "small", 9) for i in range(40)] + [(2000 + i, words(30), "unlisted", 9) for i in range(60)] + [(3000, None, "small", 9), (3001, "", None, 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("small", 0.5, 3, 0), ("absent", 0.1, 2, 0)], "source string, target_share double, max_repeats int, copies int").drop("copies")
    mix, shares = mixing.mix_sources(docs, targets, block_tokens=16)
    rows = mix.collect()
    got = {r.source: r for r in shares.collect()}
    assert max(r.copies for r in rows if r.source == "small") == 3 and max(r.copies for r in rows if r.source == "big") == 1
    assert got["small"].mix_tokens == 3 * got["small"].source_tokens
    assert abs(sum(r.mix_tokens for r in got.values()) - 30 * 700) < 30 * 700 * 0.02
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-5 and got["absent"].mix_tokens == 0
    again = mixing.mix_sources(docs.repartition(7), targets, block_tokens=16)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    even = targets.withColumn("max_repeats", targets.max_repeats * 100)
    shares = {r.source: r.actual_share for r in mixing.mix_sources(docs, even, block_tokens=16)[1].collect()}
    assert abs(shares["big"] - shares["small"]) < 0.03
    empty = mixing.mix_sources(docs.limit(0), targets)
    assert empty[0].collect() == [] and all(r.actual_share == 0 for r in empty[1].collect())


def test_rank_table_pairs():
    t = tokenizer.encoder().table
    a, b = t.byte_ids[ord("t")], t.byte_ids[ord("h")]
    assert t.pair(np.array([a]), np.array([b]))[0] == t.whole[b"th"]
    assert t.pair(np.array([50000]), np.array([50000]))[0] == tokenizer.NONE
