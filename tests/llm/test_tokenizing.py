import random

import pytest
from lorequarry.llm.tokenizing import TOKENIZERS, Encoder, decode_corpus, encode_corpus, load_ranks, merge_piece

FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_equal_the_public_library(reference):
    rng = random.Random(7)
    alphabet = "ab'stmdrevlLL  \n\t\r12.,-é​ß<|>Ω٣²ᚱ\xa0　😀́\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["", " ", "\n", "'s", "''s", " 's", "I'll've", "<|endoftext|>", "a\n\n b", "x" * 30_000, "ᚱ" * 5000, " " * 999 + "a", "'" * 50]
    assert Encoder(load_ranks(FILE)).encode(texts)[0].to_pylist() == reference(texts)


def test_every_code_point(reference):
    texts = ["".join(chr(c) + ("a" if c % 3 else " ") for c in range(lo, lo + 512) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x20000, 512)]
    assert Encoder(load_ranks(FILE)).encode(texts)[0].to_pylist() == reference(texts)


def test_merging_long_pieces_without_quadratic_time():
    ranks = load_ranks(FILE)
    ids = merge_piece(b"abcd" * 50_000, ranks)
    names = {i: t for t, i in ranks.items()}
    assert b"".join(names[i] for i in ids) == b"abcd" * 50_000


def test_cases_and_round_trip(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "naïve ​ ᚱᚢᚾ 'tis\n\n", 5), (3, "naïve ​ ᚱᚢᚾ 'tis\n\n", 5), (4, "z" * 20_000, 5), (5, " \n ", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")  # a column whose name clashes
    out = encode_corpus(df, with_offsets=True)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 6 and got[1].ids == [] and got[2].ids == []
    back = {r.doc_id: r.text for r in decode_corpus(out).collect()}
    assert back == {1: "", 2: "", **{k: t for k, t, _ in rows[2:]}}
    names = {i: t for t, i in load_ranks(FILE).items()}
    for key, text, _ in rows[2:]:
        raw = text.encode()
        assert all(raw[s : s + len(names[i])] == names[i] for i, s in zip(got[key].ids, got[key].starts))


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id string, text string")).collect() == []
