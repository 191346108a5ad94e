from lorequarry.streaming.ingest import read_stream, read_upserts, stream_upsert, windowed_counts


def test_late_and_repeated_rows(spark, tmp_path):
    schema = "id int, v string, at timestamp"
    first = spark.createDataFrame([(1, "a", 2), (2, "b", 5)], "id int, v string, s int").selectExpr("id", "v", "timestamp_seconds(s) at")
    first.coalesce(1).write.parquet(str(tmp_path / "in/t.parquet"))
    where = (str(tmp_path / "out"), str(tmp_path / "progress"), ["id"], "at")
    stream_upsert(read_stream(spark, str(tmp_path / "in"), "t", first.schema), *where)
    late = spark.createDataFrame([(1, "older", 1), (2, "newer", 9), (3, "c", 1)], "id int, v string, s int").selectExpr("id", "v", "timestamp_seconds(s) at")
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in/t.parquet"))
    stream_upsert(read_stream(spark, str(tmp_path / "in"), "t", first.schema), *where)
    assert sorted((r.id, r.v) for r in read_upserts(spark, str(tmp_path / "out"), ["id"], "at").collect()) == [(1, "a"), (2, "newer"), (3, "c")]
    counts = windowed_counts(late, "at", ["v"], "5 seconds").collect()
    assert sum(r.n for r in counts) == 3 and schema
