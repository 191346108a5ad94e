import numpy as np
from lorequarry.operators import vectors
from lorequarry.operators.vectors import build_index, embed, nearest, search_index


def data(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)) + 3 * np.eye(8)[rng.integers(0, 8, n)]
    x[7] = x[3]  # a tie
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * 8)], "vec_id long, embedding array<float>")


def test_exact_search_equals_brute_force_in_any_blocks(spark, monkeypatch):
    x, df = data(spark)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 37)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 5)
    x = np.float32(x).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 12)
    asked = df.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    got = {}
    for r in nearest(asked, df, 6, cells=3).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(0, 300, 20):
        want = sorted(range(300), key=lambda j: (-score[q, j], j))[:6]
        assert [got[q][k] for k in range(1, 7)] == want


def test_index_recall(spark):
    _, df = data(spark, 600)
    asked = df.filter("vec_id % 20 = 0 AND vec_id < 600").selectExpr("vec_id as query_id", "embedding")
    normal = df.filter("vec_id < 600").selectExpr("vec_id", "transform(embedding, x -> cast(x / sqrt(aggregate(embedding, 0D, (s, y) -> s + y * y)) as float)) as embedding")
    index, centres = build_index(normal, centres=8)
    assert index.count() == 600
    want = {(r.query_id, r.vec_id) for r in nearest(asked, normal, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in search_index(asked, index, centres, 10, 5).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_embedding(spark):
    df = spark.createDataFrame([("a", "red gate"), ("b", " "), ("c", None), ("d", "gate RED")], "id string, text string")
    got = {r.id: np.array(r.embedding) for r in embed(df, "id", "text").collect()}
    assert set(got) == {"a", "d"} and np.allclose(got["a"], got["d"]) and abs(np.linalg.norm(got["a"]) - 1) < 1e-6


def test_queries_have_their_instruction(spark):
    import pytest
    from lorequarry.operators.vectors import QUERY_INSTRUCTION, HashingEmbedder, embed, embed_query

    class Instructed(HashingEmbedder):
        query_instruction = QUERY_INSTRUCTION

    df = spark.createDataFrame([(1, "who ruled"), (2, " ")], "id int, text string")
    plain, asked = ({r.id: r.embedding for r in embed(df, "id", "text", Instructed(), is_query=q).collect()} for q in (False, True))
    assert plain.keys() == asked.keys() == {1} and plain[1] != asked[1]
    assert asked[1] == pytest.approx(embed_query("who ruled", Instructed())) and plain[1] == pytest.approx(embed_query("who ruled"))
    with pytest.raises(ValueError, match="blank"):
        embed_query("  ")
