"""Rows that arrive over time: keyed upserts of small batches, and counts in event time with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.sources.units import latest


def read_stream(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:  # noqa: ANN001
    """A stream of the Parquet files of one table below ``folder``, whether it is a file or a folder of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/{table}.parquet*")


def stream_upsert(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str) -> None:
    """Fold all rows now available into the table at ``target``: of rows with the same keys the last by ``order`` stays.

    Each batch writes what it adds, reduced to one row a key; ``read_upserts`` reduces over batches. A batch that is run again
    replaces its own folder, so rows count once.
    """

    def fold(batch: DataFrame, number: int) -> None:
        latest(batch, keys, [order]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_upserts(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    return latest(spark.read.parquet(target).drop("batch"), keys, [order])


def windowed_counts(rows: DataFrame, time_col: str, by: list[str], width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, by..., n) of rows in windows of event time; in a stream, rows later than ``late`` are left out."""
    timed = rows.withWatermark(time_col, late) if rows.isStreaming else rows
    return timed.groupBy(F.window(time_col, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
