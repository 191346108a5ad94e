import random
import re

import numpy as np
import pytest
from lorequarry.llm import neardup
from lorequarry.llm.neardup import SignatureForest, duplicate_classes, similar_pairs


def sets(rows, n=3):
    out = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out.setdefault(k, []).append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return out


def by_force(rows, t):
    s = sets(rows)
    return {(a, b) for a in s for b in s if a < b and any(x and y and len(x & y) >= t * len(x | y) - 1e-9 for x in s[a] for y in s[b])}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2))
        else:
            w = rng.choices(words, k=rng.randint(4, 80))
        rows.append((f"c{i:03}", " ".join(w)))
    return rows


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_equals_brute_force(spark, threshold, monkeypatch):
    rows = corpus(int(threshold * 10))
    df = spark.createDataFrame(rows + rows[:7], "chunk_id string, text string")
    assert {(r.id_a, r.id_b) for r in similar_pairs(df, threshold=threshold).collect()} == by_force(rows, threshold)


def test_hot_keys_in_cells(spark, monkeypatch):
    # Most records share their rarest shingles: the keys are cut into cells of blocks.
    base = [f"b{i}" for i in range(60)]
    rows = [(f"h{i:03}", " ".join(base[:i] + [f"x{i}"] + base[i:])) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    table = neardup.frequency_table

    def hot(texts, n, bits):
        counts = table(texts, n, bits)
        return np.where(counts > 20, 115, counts).astype(np.uint8)  # as if they were some 21,000

    monkeypatch.setattr(neardup, "frequency_table", hot)
    assert {(r.id_a, r.id_b) for r in similar_pairs(df).collect()} == by_force(rows, 0.6)


def test_forest_loses_no_pair():
    rng = np.random.default_rng(1)
    n = 400
    base = rng.integers(0, 2**64, size=(40, 4), dtype=np.uint64) & rng.integers(0, 2**64, size=(40, 4), dtype=np.uint64)
    bits = base[rng.integers(0, 40, n)] | (np.uint64(1) << rng.integers(0, 64, size=(n, 4)).astype(np.uint64))
    key = np.sort(rng.integers(0, 5, n))
    size = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    order = np.lexsort((size, key))
    key, bits, size = key[order], bits[order], size[order]
    got = {tuple(sorted(p)) for a, b in SignatureForest(key, size, size, bits, np.zeros(n, dtype=int)).pairs(0.7) for p in zip(a.tolist(), b.tolist())}
    for i in range(n):
        both = np.bitwise_count(bits[i] & bits).sum(axis=1)
        for j in np.flatnonzero((key == key[i]) & (both >= 0.7 * (size[i] + size - both))):
            assert i >= j or (i, int(j)) in got


def test_cases(spark):
    text = "one two three four five six seven eight"
    rows = [("a", text, 0), ("a", text, 0), ("b", text.upper() + "!", 0), ("c", None, 0), ("d", "", 0), ("e", "two words", 0), ("f", "two words", 0), ("g", "lorem " * 20_000, 0)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, cls int")
    assert [(r.id_a, r.id_b, r.similarity) for r in similar_pairs(df).collect()] == [("a", "b", 1.0)]
    assert sorted((r.chunk_id, r.class_id, r.copies, r.links) for r in duplicate_classes(df).collect()) == [("a", "a", 2, 0), ("b", "a", 2, 0), ("g", "g", 1, 0)]
    assert similar_pairs(df.limit(0)).collect() == []
