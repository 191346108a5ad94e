import random
from collections import Counter
from itertools import combinations

import pytest
from lorequarry.llm.pairing import item_pairs


def by_force(rows, least, ratio):
    baskets = {}
    for c, s, o in rows:
        if c is not None:
            baskets.setdefault(c, set()).update(x for x in (s, o) if x is not None)
    baskets = {c: b for c, b in baskets.items() if b}
    n = Counter(x for b in baskets.values() for x in b)
    ab = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    return {(a, b, k, n[a], n[b]) for (a, b), k in ab.items() if k >= least and k * len(baskets) >= ratio * n[a] * n[b]}


@pytest.mark.parametrize("block", [2, 5, 128])
def test_equals_brute_force_with_any_block_size(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", *"abcdefghij"]), rng.choice("abcxyzuvw")) for _ in range(900)]
    rows += [(0, f"i{k}", "hub") for k in range(40)] + [(1, f"i{k}", "hub") for k in range(40)]  # two huge baskets
    df = spark.createDataFrame(rows + rows[:50], "chunk_id int, subject string, object string").withColumnRenamed("chunk_id", "c").selectExpr("c as chunk_id", "subject", "object", "1 as n_ab", "'x' as item")
    got = {(r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b) for r in item_pairs(df, min_count=2, min_ratio=1.2, block_items=block).collect()}
    assert got == by_force(rows, 2, 1.2) and got


def test_empty(spark):
    assert item_pairs(spark.createDataFrame([], "chunk_id string, subject string, object string")).collect() == []
