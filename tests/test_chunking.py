import random

import pytest
from lorequarry.operators.chunking import character_chunks, chunk_documents, packed_ranges, split_units


def by_force(sentences, size, overlap):
    """Ranges by trying: the most sentences that fit after the overlap, which is the most last sentences that fit."""
    out, first, new = [], 0, 0
    while new < len(sentences):
        last = new
        while last + 1 < len(sentences) and len(" ".join(sentences[first : last + 2])) <= size:
            last += 1
        out.append((first, last))
        new = first = last + 1
        while first > out[-1][0] and len(" ".join(sentences[first - 1 : new])) <= overlap:
            first -= 1
    return out


def test_ranges_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        s = ["x" * rng.choice([1, 3, 8, 20, 50]) for _ in range(rng.randint(1, 25))]
        size, overlap = rng.choice([(30, 10), (60, 0), (20, 19)])
        assert packed_ranges([len(x) for x in s], size, overlap) == by_force(s, size, overlap)


def test_pieces(spark):
    long = "".join(f"Sentence number {i} is here. " for i in range(200)).strip()
    rows = [("a", long), ("b", "x" * 3000), ("c", "short"), ("d", None), ("e", " \n "), ("f", "One is here.\n" + "Then more words follow it. " * 60 + "End.")]
    got = {}
    for r in split_units(spark.createDataFrame(rows, "id string, text string")).orderBy("id", "piece_index").collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {"a", "b", "c", "f"} and [r.piece for r in got["c"]] == ["short"]
    assert [(r.start_char, r.end_char) for r in got["b"]] == [(0, 1200), (1000, 2200), (2000, 3000)]
    for r in got["a"]:
        assert long[r.start_char : r.end_char] == r.piece and len(r.piece) <= 1200
    assert got["f"][0].start_char == 0 and len(got["f"][-1].piece) >= 100  # joined over a line break; short rest added


def test_documents_are_numbered_through(spark):
    rows = [("d", 1, "Second unit."), ("d", 0, "First unit. " * 150), ("e", 0, "Only."), ("d", 2, " ")]
    got = chunk_documents(spark.createDataFrame(rows, "document_id string, unit_index int, text string")).orderBy("document_id", "chunk_index").collect()
    d = [r for r in got if r.document_id == "d"]
    assert [r.chunk_index for r in d] == list(range(len(d))) and d[-1].text == "Second unit." and len({r.chunk_id for r in got}) == len(got)
    assert all(r.word_count == len(r.text.split()) and r.char_count == len(r.text) for r in got)


def test_strides_and_parameters(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, text string")
    assert [(r.start_char, r.end_char, r.piece) for r in character_chunks(df, "id", "text", 4, 1).orderBy("piece_index").collect()] == [(0, 4, "abcd"), (3, 7, "defg"), (6, 10, "ghij")]
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            character_chunks(df, "id", "text", size, overlap)
