import random

from hypothesis import given, settings
from hypothesis import strategies as st
from lorequarry.llm.splitting import split_oversized, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    if not text:
        assert pieces == []
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e), (s2, e2) in zip(pieces, pieces[1:]):
        assert e < e2 and e - overlap <= s2 <= e
        if s2 != e - overlap:  # fewer only to begin at a boundary
            assert text[s2 - 1].isspace() and not text[s2].isspace()
    assert all(0 < e - s <= limit for s, e in pieces)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc. \n,!", max_size=400), st.integers(20, 80))
def test_properties(text, limit):
    check(text, limit, limit // 5)


def best_by_force(text, limit, overlap):
    """Fewest cuts that are no sentence ends, over all ways to cut at word ends."""
    ends = [i for i in range(1, len(text)) if text[i].isspace() and not text[i - 1].isspace()] + [len(text)]
    starts = [i for i in range(1, len(text)) if text[i - 1].isspace() and not text[i].isspace()]
    begin = lambda e: next((s for s in starts if e - overlap <= s < e), max(0, e - overlap))
    best = {}
    for e in ends:
        cost = 0 if e == len(text) or text[e - 1] in ".!?" else 1
        ways = ([0] if e <= limit else []) + [best[p] for p in best if p < e and e - begin(p) <= limit]
        if ways:
            best[e] = min(ways) + cost
    return best.get(len(text))


def test_weak_cuts_are_as_few_as_can_be():
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join("a" * rng.randint(2, 7) + ("." if rng.random() < 0.25 else "") for _ in range(60))
        pieces = check(text, 70, 12)
        assert sum(text[e - 1] not in ".!?" for _, e in pieces[:-1]) == best_by_force(text, 70, 12)


def test_abbreviations_end_no_sentence():
    text = ("He met Dr. Catherine Holt near Capt. Roe. " * 40).strip()
    assert all(text[:e].endswith("Roe.") for _, e in split_text(text)[:-1])


def test_no_boundary_and_combining_marks():
    check("x" * 5000, 1200, 200)
    text = "é" * 2000
    assert all(text[e : e + 1] != "́" for _, e in check(text, 1200, 200))


def test_cases(spark):
    long = "A sentence of words. " * 200
    rows = [("a", long, "S", 1), ("a", long, "S", 1), ("b", None, "S", 2), ("c", "", None, 3), ("d", "short", None, 4), ("e", "y" * 1200, None, 5), ("f", "y" * 1201, None, 6), ("g", "word " * 60_000, "T", 7)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, section string, piece int")
    out = split_oversized(df).collect()
    assert {r.chunk_id for r in out} == {"a", "f", "g"}
    for r in out:
        text = next(t for k, t, *_ in rows if k == r.chunk_id)
        assert r.piece == text[r.start_char : r.end_char] and len(r.piece) <= 1200
    assert sorted(r.piece_index for r in out if r.chunk_id == "a") == list(range(len([r for r in out if r.chunk_id == "a"])))
    assert {r.section for r in out if r.chunk_id == "a"} == {"S"}
    assert {r.chunk_id for r in split_oversized(df, keep_small=True).collect()} == {"a", "d", "e", "f", "g"}
    assert split_oversized(df.limit(0)).collect() == []
