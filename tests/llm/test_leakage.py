import random

from lorequarry.llm import leakage
from lorequarry.llm.leakage import aligned, leaked_items, without_leaks

WORDS = [f"word{i}" for i in range(40)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def by_force(passage, words, least, one_in):
    return any(
        passage[i] == words[s] and passage[i + m - 1] == words[e - 1] and edit_distance(passage[i : i + m], words[s:e]) <= m // one_in
        for m in range(least, len(passage) + 1) for i in range(len(passage) - m + 1)
        for s in range(len(words)) for e in range(s + max(1, m - m // one_in), min(len(words), s + m + m // one_in) + 1)
    )


def test_alignment_equals_brute_force():
    rng = random.Random(5)
    seen = set()
    for _ in range(150):
        passage = rng.choices("abcdefghijklm", k=rng.randint(6, 16))
        words = list(passage[rng.randint(0, 3) : rng.randint(6, 16)])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randint(0, 1)] = rng.choices("xyz", k=rng.randint(0, 1))
        want = by_force(passage, words, 8, 4)
        assert aligned(passage, words, 8, 4) == want
        seen.add(want)
    assert seen == {True, False}


def test_cases(spark, monkeypatch):
    passage = " ".join(WORDS)
    edited = WORDS[5:23]
    edited[4], edited[12] = "other", "another"
    too_much = WORDS[5:23]
    too_much[2], too_much[8], too_much[14] = "x", "y", "z"
    hyphened = "Word0, WORD1\nwo-\nrd2 word3 " + " ".join(WORDS[4:20])
    docs = [
        (1, "before " + passage + " after", 0), (2, " ".join(WORDS[:17]), 0), (3, " ".join(WORDS[:18]), 0), (4, "q " * 50 + " ".join(edited), 0), (5, " ".join(too_much), 0),
        (6, None, 0), (7, "", 0), (8, hyphened, 0), (9, "filler text " * 20_000 + passage, 0), (1, passage, 0), (10, "What is word1 word2?", 0),
    ]
    items = [(100, passage, "What is word1 word2?"), (101, "too short", "?"), (102, None, "?"), (100, passage, "again")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item int")
    e = spark.createDataFrame(items, "item_id long, passage string, question string")
    want = [(i, 100) for i in (1, 3, 4, 8, 9)]
    assert sorted(map(tuple, leaked_items(d, e).collect())) == want
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 10)  # passages in several blocks
    more = e.union(spark.createDataFrame([(103, " ".join(WORDS[20:]), "?")], e.schema))
    assert sorted(map(tuple, leaked_items(d, more).collect())) == sorted([*want, (1, 103), (9, 103)])
    assert leaked_items(d, e.limit(0)).collect() == [] and leaked_items(d.limit(0), e).collect() == []


def test_removal(spark):
    passage = "The oven stood by the gate. " + " ".join(WORDS[:20]) + ". Nobody opened it."
    docs = [(1, f"Own words come first here. {passage} And own words end it.", 0), (2, "Nothing leaked. At all.", 0), (3, None, 0), (4, "", 0), (2, "Nothing leaked. At all.", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, passages int")
    e = spark.createDataFrame([(9, passage)], "item_id long, passage string")
    got = sorted((r.doc_id, r.text, r.leaked) for r in without_leaks(d, e).collect() if r.doc_id != 3)
    assert got == [(1, "Own words come first here. And own words end it.", True), (2, "Nothing leaked. At all.", False), (2, "Nothing leaked. At all.", False), (4, "", False)]
    assert sorted(r.doc_id for r in without_leaks(d, e, whole=True).collect()) == [2, 2, 3, 4]


def test_places_in_the_text():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a", "B", "-", " ", "\n", "<b>", "&amp;", "ﬁ", "é", "́", "İ", "­", "​", "가", "½", "　", ".", "word"]) for _ in range(rng.randint(0, 25)))
        form = leakage.normalise(text).lower()
        starts, ends = leakage.origins(text)
        assert len(starts) == len(ends) == len(form) and all(0 <= a < b <= len(text) for a, b in zip(starts, ends))
        assert all(text[a] == c for a, c in zip(starts, form) if c in "w.\n")


def test_nothing_leaked_stays(spark, monkeypatch):
    passage, other = " ".join(WORDS[:30]) + ".", " ".join(f"thing{i}" for i in range(30)) + "."
    own = " ".join(f"own{i}" for i in range(60))
    broken = " ".join(f"{w}." if i % 2 else w for i, w in enumerate(WORDS[:30]))
    docs = [
        (1, f"Own start. {own} {' '.join(WORDS[4:24])} {own}. Own end."),  # ends inside a longer sentence
        (2, f"{own} {passage[:-1]} {own}"),  # no full stops
        (3, f"Own start. {broken} Own end."),  # sentences of two words
        (4, f"Own start. {' '.join(WORDS[:15])}. {other} {' '.join(WORDS[15:30])}. Own end."),  # a leak within a leak
        (5, f"“Ⓞwn” ﬁrst – İ. {own} <b>{' '.join(WORDS[:12])}</b> wo-\nrd12 {' '.join(WORDS[13:28])} {own}. Own end."),
        (6, None), (7, ""), (8, "  Nothing leaked. " + " ".join(WORDS[:17])),
        (9, f"{passage} {own}. {passage} Own end."),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(100, passage), (101, other)], "item_id long, passage string")
    want = {
        1: f"Own start. {own} {own}. Own end.", 2: f"{own} {own}", 3: "Own start. Own end.", 4: "Own start. Own end.", 5: f"“Ⓞwn” ﬁrst – İ. {own} <b>{own}. Own end.",
        6: None, 7: "", 8: docs[7][1], 9: f"{own}. Own end.",
    }
    for words in (leakage.BLOCK_WORDS, 10):  # the passages in one block and in two
        monkeypatch.setattr(leakage, "BLOCK_WORDS", words)
        got = without_leaks(d, e).cache()
        assert leaked_items(got, e).collect() == []
        assert {r.doc_id: r.text for r in got.collect()} == want
        assert {r.doc_id for r in got.filter("leaked").collect()} == {1, 2, 3, 4, 5, 9}
