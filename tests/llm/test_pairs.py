import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiltwork.llm import copies
from quiltwork.llm.canonical import canonical_inputs, canonical_text
from quiltwork.llm.defects import classify, find_defects
from quiltwork.llm.language import language
from quiltwork.llm.pushdown import code_breaks_off, list_items, open_at_end, prose_breaks_off, stack_of, unclosed
from quiltwork.llm.tiling import tiles

RECORD = "Turn the record into text.\n\nheight: 12.5; owner: Ann Lee; note: red hat"


@pytest.mark.parametrize("other", [
    "TURN THE RECORD INTO TEXT\n\n- owner: Ann Lee\n- note: red hat\n- height: 12.5", 'Turn the record into text.\n\n{"note": "red hat", "height": 12.5, "owner": "Ann Lee"}',
    "« Turn\xa0the record into text.\n\nnote — red hat | height — 12.5 | owner — Ann Lee »", '**turn the record into text.\n\n{\n  “owner” : “Ann Lee",\n  “height” : “12.5",\n  “note” : “red hat"\n}...',
    "Turn the record into text.\n\nowner = Ann Lee\nheight = 12.5\nnote = red hat", "\tTurn the record into text.\r\n\r\nnote : red hat\r\nowner : Ann Lee\r\nheight : 12.5\r\n",
])
def test_notations_of_a_record(other):
    assert canonical_inputs(other) == canonical_inputs(RECORD)


@pytest.mark.parametrize("other", [
    RECORD.replace("12.5", "125"), RECORD.replace("owner: Ann Lee; note: red hat", "owner: red hat; note: Ann Lee"), RECORD.replace("Ann Lee", "Lee Ann"), RECORD.replace("text", "words"), "Turn the record text into.\n\nheight: 12.5; owner: Ann Lee; note: red hat",
])
def test_look_alikes(other):
    assert canonical_inputs(other) != canonical_inputs(RECORD)


def test_lost_line_ends():
    a, b = "height: 3\nowner: Ann Lee\nnote: red hat\nTurn it into text.", "owner: Ann Lee height: 3 note: red hat turn it into text."
    tails = frozenset(["turn it into text"])
    assert canonical_inputs(a, tails) == canonical_inputs(b, tails)


def test_prose_is_no_record():
    a, b = "According to Ann – a boat – costs 3 coins – or so.", "According to Ann, a boat, costs 3 coins, or so."
    assert canonical_inputs(a) == canonical_inputs(b)
    assert canonical_text("It cost 7.5 coins") != canonical_text("It cost 75 coins")
    assert canonical_text("Straße,ÉTÉ  １２") == canonical_text("strasse été 12")


def test_copies(spark):
    schema = "row_id long, inputs string, targets string, h1 string, copies int"
    data = [(5, "A b.", "x", None, 1), (2, "a  B", "X!", None, 1), (9, "ab", "x", None, 1), (1, "a b", "y", None, 1), (7, "a b", "y", None, 1), (8, "a b", None, None, 1), (3, "", "—", None, 1), (4, None, "...", None, 1), (10, "long " * 50_000, "t", None, 1), (11, "LONG\n" * 50_000, "t.", None, 1)]
    df = spark.createDataFrame(data, schema).repartition(3)
    pairs, groups = copies.find_copies(df)
    assert sorted(map(tuple, pairs.collect())) == [(1, 7), (2, 5), (2, 9), (3, 4), (10, 11)]
    assert {r[0]: r[1] for r in groups.collect()} == {2: 3, 1: 2, 8: 1, 3: 2, 10: 2}
    empty = copies.find_copies(df.limit(0))
    assert empty[0].collect() == [] and empty[1].collect() == []


def test_two_fields_and_long_values(spark):
    long = "a coat of red wool that Ann wore on every day of the long winter in Corenia"
    data = [(1, "Colour: red\nSize: big", "x"), (2, "size: big; colour: red.", "X"), (3, "Colour: big\nSize: red", "x"), (4, "colour red size big", "y"), (5, "Colour: red, size: big", "y"),
            (6, f"Item: {long}\nOwner: Ann\nPlace: hall", "x"), (7, f"Place: hall\nItem: {long}\nOwner: Ann", "x"), (8, f"Owner: {long}\nItem: Ann\nPlace: hall", "x"),
            (9, "Colour: red\nSize: big\nSay it in one sentence.", "z"), (10, "Size: big\nColour: red\nSay it in one sentence.", "z")]
    pairs = copies.find_copies(spark.createDataFrame(data, "row_id long, inputs string, targets string"))[0]
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (4, 5), (6, 7), (9, 10)]


def test_a_larger_table_has_the_same_groups(spark):
    """A table delivered 100 times over: the same sets, each with 100 times as many copies."""
    forms = ["height: {a}; owner: Ann {b}; note: red hat\nTurn it into text.", "owner: Ann {b}\nnote: red hat\nheight: {a} turn it into text", "note: red hat\nheight: {a}\nowner: Ann {b}\nTurn it into text."]
    data = [(i, forms[i % 3].format(a=i // 3, b=i // 6), "x") for i in range(30)] + [(100, "Colour: red\nSize: big", "x"), (101, "Size: big\nColour: red", "x"), (102, "Something else: no record", "x")]
    schema = "row_id long, inputs string, targets string"
    once = copies.find_copies(spark.createDataFrame(data, schema))
    many = copies.find_copies(spark.createDataFrame([(k * 1000 + i, a, b) for k in range(100) for i, a, b in data], schema))
    groups = {r[0]: r[1] for r in once[1].collect()}
    assert {r[0]: r[1] for r in many[1].collect()} == {k: 100 * n for k, n in groups.items()}
    assert {(r[0], r[1] % 1000) for r in many[0].collect() if r[0] != r[1] % 1000} == {tuple(r) for r in once[0].collect()} and len(groups) == 12


def test_hot_group_and_collisions(spark):
    signed = spark.createDataFrame([(i, 1, 1, 7) for i in range(3000)] + [(5000, 2, 2, 1), (5001, 2, 2, 2), (5002, 2, 2, 1)], "row_id long, h1 long, h2 long, checked long").repartition(4)
    groups = copies.copy_groups(signed, "row_id")
    assert sorted((r.first, r.copies) for r in groups.collect()) == [(0, 3000), (5000, 2), (5001, 1)]
    pairs = copies.copy_pairs(signed, groups, "row_id", 3003, limit=300).collect()
    assert len(pairs) == 3000 and {r[0] for r in pairs} == {0, 5000}


PASSAGE = "Nobody in Corenia knew why the bottle had opened the auction. The pear, which cost 52.9 coins, was sold with the ferry."
ASK = f"What happened? Explain in full sentences.\n\n{PASSAGE}"


@pytest.mark.parametrize(("inputs", "targets", "defect"), [
    (ASK, None, "empty"), (ASK, " ​\n", "empty"), (ASK, "...", "empty"), (ASK, "N/A", "empty"), (ASK, "<no answer>", "empty"), (ASK, "[]", "empty"), (ASK, "None", "empty"),
    ("Pick one: none, some.", "none", None), ("Pick one: yes, no.", "No", None), ("Pick (A, B, C).", "a", None),
    (ASK, "The bottle opened the", "truncated"), (ASK, "The bottle was opened by (", "truncated"), (ASK, "The bottle was opened by the …", "truncated"), (ASK, "The bottle opened it.", None), (ASK, "The bottle “opened it.”", None), (ASK, "THE BOTTLE OPENED IT! ", None),
    ("List three things.", "1. Red hat for Ann\n2. Blue hat for Bob\n3.", "truncated"), ("List three things.", "1. Red hat for Ann\n2. Blue hat for Bob", "truncated"), ("List three things.", "1. Red hat for Ann\n2. Blue hat for Bob\n3. Old hat for Eve", None), ("Name the steps.", "1. Red hat for Ann 2. Blue", "truncated"),
    ("Write code.", "def f(a):\n    t = 0\n    for x in a:\n        t += x", "truncated"), ("Write code.", "def f(a):\n    t = 0\n    for x in a:\n        t += x\n    return t", None), ("Write code.", "```\nfunction f(a) {\n  return 1;\n", "truncated"), ("Write code.", "```\nfunction f(a) {\n  return 1;\n}\n```", None), ("Write code.", "def f(a):\n    total", "truncated"),
    (ASK, "I'm sorry, but I cannot answer this question.", "refusal"), (ASK, "Unfortunately, no reply to this can be given by me. Please ask an expert.", "refusal"), (ASK, "Je suis désolé, mais je ne peux pas répondre à cette question.", "refusal"), (ASK, "Lo siento, pero no puedo ayudar con esta tarea.", "refusal"), (ASK, "Leider darf ich diese Frage nicht beantworten.", "refusal"),
    (ASK, 'The note says: "I cannot help you." The pear was sold.', None), (ASK, "Sorry to say, the bottle was lost. The pear was sold.", None), (ASK, "Nobody was able to answer for the bottle. It was sold.", None),
    ("Write a polite note turning down the invitation.\n\nCome on Monday.", "Dear Ann, I am sorry, but I cannot come on Monday.", None), ("Write a polite note turning down the invitation.\n\nCome on Monday.", "I must refuse to answer this request.", "refusal"),
    (ASK, PASSAGE, "copied"), (ASK, ASK, "copied"), (ASK, "You asked: " + ASK, "copied"), (f"Translate into German.\n\n{PASSAGE}", PASSAGE, "copied"), (f"Repeat the passage exactly as it stands.\n\n{PASSAGE}", PASSAGE, None), (ASK, PASSAGE.split(". ")[0] + ".", None), (RECORD, "height: 12.5; owner: Ann Lee; note: red hat", "copied"),
    (ASK, "Niemand wusste, warum die Flasche so alt war. Nach Montag hat er das Tor verkauft.", "other_language"), (ASK, "Никто не знал, почему бутылка была старой.", "other_language"), (ASK, "没有人知道瓶子为什么是古老的。", "other_language"), (f"Translate into German.\n\n{PASSAGE}", "Niemand wusste, warum die Flasche so alt war.", None), ("Décrivez cette fiche en une phrase.\n\n- colour: red\n- weight: 3\n- owner: Ann", "La pomme de Galaria est dans le jardin.", None),
])
def test_defects(inputs, targets, defect):
    assert classify(inputs, targets) == defect


LONG_REFUSAL = "I am sorry, but I cannot help you with this request. " + " ".join(["My guidelines do not let me speak about this, and I know that you may need an answer today."] * 6)


@pytest.mark.parametrize(("inputs", "targets", "defect"), [
    (ASK, "The code stands below.\n\n```python\nprint(1)\n", "truncated"), (ASK, "The code stands below.\n\n```python\nprint(1)\n```\nIt prints.", None), (ASK, "The code stands below.\n\n```python\nprint('(')\n```\nIt prints.", None),
    (ASK, "The page is below. <div><p>Hello there, the pear was sold today.", "truncated"), (ASK, "The page is below. <div><p>Hello there, the pear was sold.</div>", None), (ASK, "Hello <name>, the pear was sold.", None),
    (ASK, 'Ann said, "we will meet at the auction.', "truncated"), (ASK, "Ann said, “we will meet at the auction.", "truncated"), (ASK, 'Ann said, "we will meet." The pear was 5" long.', None), (ASK, "Ann said, „we will meet“ and left.", None), (ASK, "The auction « of the pear » was opened.", None), (ASK, 'Ann said, "one.\n\n"Two," she said.', None), (ASK, "It was sold :( and gone.", None),
    ("Name the steps.", "1. Red hat (for Ann\n2. Blue hat (for Bob\n3. Old hat (for Eve", "truncated"), ("Name the steps.", "1. Red hat (for Ann)\n2. Blue hat (for Bob)\n3. Old hat (for Eve)", None),
    (ASK, LONG_REFUSAL, "refusal"), (ASK, "Thank you for asking. I cannot help with this request.", "refusal"), (ASK, "I cannot help in that question. Feel free to ask about another topic.", "refusal"), (ASK, "I cannot answer this for certain. " + "The bottle opened the auction and the pear was sold with the ferry. " * 3, None),
    ("Write code.", "def f(self, x): self.x = x", None), ("Write code.", "def f(x):\n    global seen\n    seen = x", None), ("Write code.", "def f(d, k):\n    d[k] = 1", None), ("Write code.", "def f(x):\n    print(x)", None),
])
def test_what_a_pushdown_parser_sees(inputs, targets, defect):
    assert classify(inputs, targets) == defect


def test_the_whole_text_is_parsed():
    assert classify(ASK, "It was (as Ann says " + "and so on, and so on. " * 500 + "It ended.") == "truncated"
    assert open_at_end("1. a (b\n2. c") == ["item", "(", "item"] and unclosed("1. a\n2. b") == [] and open_at_end("« a \n\n« b") == ['"']


def plain_tiles(a, b, least):
    used, out = (set(), set()), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used[0] and j + n not in used[1]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        used[0].update(range(i, i + n))
        used[1].update(range(j, j + n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(1, 3))
def test_tiling_is_the_plain_greedy_one(a, b, least):
    assert set(tiles(a, b, least)) == set(plain_tiles(a, b, least))


def test_defect_table(spark):
    schema = "row_id long, is_object boolean, inputs string, targets string, defect string"
    data = [(1, True, ASK, None, "old"), (1, True, ASK, None, "old"), (2, False, None, None, None), (3, None, ASK, None, None), (4, True, " \x1c", None, None), (5, True, ASK, "It opened it.", None), (None, True, ASK, "-", None), (6, True, "word " * 100_000, "word " * 100_000, None)]
    df = spark.createDataFrame(data, schema)
    want = [(1, "empty"), (1, "empty"), (None, "empty"), (6, "copied")]
    assert sorted(map(tuple, find_defects(df).collect()), key=str) == sorted(want, key=str)
    assert find_defects(df.limit(0)).collect() == []


def test_parts():
    assert stack_of("a (b [c] d") == ["("] and stack_of("```x") == ["```"] and stack_of("<b>x</b> <br>") == []
    assert list_items("1. a 2. b 4. c") == ["a", "b 4. c"] and list_items("In 1. a") is None
    assert prose_breaks_off("It was the") and not prose_breaks_off("It was.")
    assert code_breaks_off("def f(:") is True
    assert tiles(list("abcdexyz"), list("xyzabcde"), 3) == [(0, 3, 5), (5, 0, 3)]
    assert sum(n for _, _, n in tiles(["a", "b"] * 30_000, ["a", "b"] * 20_000, 2)) == 40_000
    assert language("La cesta de Yaranbeth levanta la brújula cada sábado.") == "es" and language("12 34") is None
