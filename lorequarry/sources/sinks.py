"""Write results: Parquet between stages, nested JSON for exchange, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_export(documents: DataFrame, units: DataFrame) -> DataFrame:
    """(document_id, document): one JSON object for each document, with its units in order under 'pages'."""
    kept = [c for c in ("text", "page", "section", "chapter", "extraction_method", "extraction_confidence") if c in units.columns]
    pages = units.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("unit_index", *kept))).alias("pages"))
    rows = documents.drop("page_count").join(pages, "document_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(pages.schema["pages"].dataType)))
    rows = rows.withColumn("page_count", F.size("pages"))
    return rows.select("document_id", F.to_json(F.struct(*rows.columns)).alias("document"))


def chunk_export(chunks: DataFrame, flat: bool = False) -> DataFrame:
    """(chunk_id, chunk): one JSON object for each chunk, with its provenance nested under 'metadata' or, ``flat``, beside it; nulls left out."""
    own = [c for c in ("chunk_id", "document_id", "text", "char_count", "word_count") if c in chunks.columns]
    meta = [c for c in chunks.columns if c not in ("text", "char_count", "word_count")]
    body = F.struct(*own, *[c for c in meta if c not in own]) if flat else F.struct(*own, F.struct(*meta).alias("metadata"))
    return chunks.select("chunk_id", F.to_json(body).alias("chunk"))


def write_chunk_files(chunks: DataFrame, path: str, per_file: int = 1000) -> None:
    """JSON files that hold lists of about ``per_file`` chunks each, which ``read_chunks`` reads."""
    rows = chunk_export(chunks)
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(rows.count() // per_file + 1))
    lists = rows.groupBy(block.alias("block")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("chunk"), ","), F.lit("]")).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)


def scalar_metadata(chunks: DataFrame) -> DataFrame:
    """(chunk_id, metadata): the scalar, non-null provenance of each chunk as JSON."""
    scalar = [f.name for f in chunks.schema if f.dataType.simpleString().split("(")[0] in ("string", "int", "bigint", "double", "float", "boolean") and f.name not in ("text", "chunk_id")]
    return chunks.select("chunk_id", F.to_json(F.struct(*scalar)).alias("metadata"))


def write_stage(df: DataFrame, path: str) -> None:
    """Replace a stage's Parquet table."""
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; of several new rows the last by ``order`` stays.

    New rows without a key are refused with an error when the result is read.
    """
    from lorequarry.sources.units import latest

    for k in keys:
        new = new.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"a row without {k}")).cast(new.schema[k].dataType)).otherwise(F.col(k)))
    fresh = latest(new, keys, [order] if order else [c for c in new.columns if c not in keys][:1])
    return old.join(fresh.select(*keys), keys, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def ingestion_report(documents: DataFrame, chunk_count: DataFrame | None = None) -> DataFrame:
    """One row: counts of documents read, failed and of unsupported kind, and of their pages."""
    supported = F.lower("extension").isin(".pdf", ".docx", ".md", ".markdown", ".txt")
    return documents.agg(
        F.count_if(F.col("ingestion_error").isNull() & supported).alias("success_count"), F.count_if(F.col("ingestion_error").isNotNull()).alias("failure_count"),
        F.count_if(~supported).alias("skipped_count"), F.sum("page_count").alias("page_count"),
    )
