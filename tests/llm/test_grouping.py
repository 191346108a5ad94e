from itertools import combinations

import pytest
from lorequarry.llm.grouping import pairs_within


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_all_pairs_once(spark, block):
    groups = {"a": [f"m{i:02}" for i in range(20)], "b": ["x", "y"], "c": ["alone"]}
    rows = [(k, m, 0) for k, ms in groups.items() for m in ms] + [(None, "n1", 0), (None, "n2", 0)]
    df = spark.createDataFrame(rows, "key string, name string, blocks int")
    got = [tuple(r) for r in pairs_within(df, "key", "name", block).collect()]
    want = {p for ms in groups.values() for p in combinations(sorted(ms), 2)}
    assert len(got) == len(want) and set(got) == want
    assert pairs_within(df.limit(0), "key", "name").collect() == []
