import random

import numpy as np
import xxhash
from lorequarry.llm.scans import CONFUSIONS, deletes, filter_bits, membership, misread_cost, is_marked, numeric_pair_hash, pair_hash, page_damage, page_lines, repaired_pages, skeleton, title_key, words_and_breaks
from pyspark.sql import functions as F

SOUND = "The garden gate was painted under the harvest moon by Anna Roe. The moss-grown wall stood near the garden. "


def pages():
    rows = [(i, "d", i, SOUND * 8) for i in range(30)]
    rows += [
        (100, "e", 0, "THE SILENT REGISTER\n\nThe gar-\nden gate was painted under the moss-\ngrown wall. p. 12 is no number here.\n\n- 7 -"),
        (101, "e", 1, "The garclen gate vvas painted un-"),
        (102, "e", 2, "der the h4rvest moon.\nTHE S|LENT REGI5TER   fol. 8r"),
        (103, "e", 3, "A HEADING THAT STANDS ONCE\n\nCandle K0L-34\n331\nBridge K0L-5\n12\n\nThe garden gate was painted."),
        (104, "e", 4, None), (105, "e", 5, ""), (106, "e", 6, " \n "), (107, None, None, "The garden gate was painted.\n\nxii"), (100, "e", 0, "THE SILENT REGISTER\n\nThe gar-\nden gate was painted under the moss-\ngrown wall. p. 12 is no number here.\n\n- 7 -"),
        (108, "f", 0, SOUND * 3000),
    ]
    return rows


def test_cases(spark):
    df = spark.createDataFrame(pages(), "page_id long, document_id string, unit_index int, text string").selectExpr("*", "1 as unit", "'x' as doc", "page_id as place")
    got = {}
    for r in page_damage(df).collect():
        got.setdefault(r.page_id, set()).add(r.damage)
    assert got == {100: {"header", "broken_word", "page_number"}, 101: {"misread", "broken_word"}, 102: {"header", "misread", "page_number"}, 107: {"page_number"}}
    assert page_damage(df.limit(0)).collect() == []
    fixed = {r.page_id: r.repaired for r in repaired_pages(df).collect()}
    assert fixed[100] == "The garden gate was painted under the moss-grown wall. p. 12 is no number here."
    assert fixed[101].startswith("The garden gate was painted") and fixed[102] == "der the harvest moon." and fixed[0] == SOUND * 8
    assert fixed[107] == "The garden gate was painted."


def test_helpers():
    assert misread_cost("tl1e", "the") < 1 and misread_cost("vvas", "was") < 1 and misread_cost("hat", "cat") > 1.3
    assert title_key("THE S|LENT REGI5TER") == title_key("The Silent Register") != ""
    assert title_key("The sentence ends here.") == ""
    assert set(deletes("agz")) == {"agz", "ag", "az", "gz"}
    assert [n for _, _, n in page_lines("4 |  THE SILENT REGISTER\n\ntext text\n\nxiv")] == [True, False, False, False, True]


def test_confusions_share_a_key():
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("abcdefghilmnoqrstuwz") for _ in range(rng.randint(2, 14)))
        seen = word
        for _ in range(rng.randint(1, 3)):
            meant = rng.choice([*CONFUSIONS])
            at = rng.choice([i for i in range(len(seen)) if seen.startswith(meant, i)] or [None])
            if at is not None:
                seen = seen[:at] + rng.choice(CONFUSIONS[meant]) + seen[at + len(meant) :]
        assert skeleton(seen) == skeleton(word), (word, seen)
    assert set(deletes("surnrner")) & set(deletes("summer")) and set(deletes("cornrnunal")) & set(deletes("communal"))
    assert len(deletes("x" * 50_000)) == 1


def test_titles_of_any_length():
    assert title_key("CHRONICLE", alone=True) == title_key("Chronicle", alone=True) != "" and title_key("Chronicle") == ""
    assert title_key(" ".join(["The Long Register"] * 9))
    assert [k != "" for _, k, _ in page_lines("CHRONICLE\nsome text stands here\nOnce\nmore text")] == [True, False, False, False]


def test_words_and_cuts():
    assert words_and_breaks(["The gar-", "den Gate !ngot ends in ag-"]) == (["the", None, "gate", "!ngot", "ends", "in"], [("gar", "den"), ("ag", "")])


def test_membership(spark):
    words = [f"w{i}" for i in range(500)] + ["ünder"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    marks = membership(df.select(F.xxhash64("word").alias("h")), len(words))
    known = np.array([xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words], dtype=np.uint64)
    others = np.array([xxhash.xxh64_intdigest(f"x{i}".encode(), seed=42) for i in range(2000)], dtype=np.uint64)
    assert is_marked(marks, known).all() and is_marked(marks, others).mean() < 0.1
    assert not is_marked(membership(df.limit(0).select(F.xxhash64("word").alias("h")), 0), known).any()
    pair = df.select(pair_hash(F.xxhash64("word"), F.xxhash64(F.concat("word", F.lit("!")))).alias("h")).toPandas().h.to_numpy().view(np.uint64)
    after = np.array([xxhash.xxh64_intdigest((w + "!").encode(), seed=42) for w in words], dtype=np.uint64)
    assert (pair == numeric_pair_hash(known, after)).all()
    assert filter_bits(10**12) == 30
