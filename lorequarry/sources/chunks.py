"""Read chunk files in JSON, and derived properties of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions.text import first_filled, strip_space

CHUNK_SCHEMA = (
    "chunk_id string, id string, document_id string, text string, content string, document string, char_count int, word_count int, matched_questions array<string>, "
    "metadata struct<chunk_id:string,document_id:string,file_name:string,file_path:string,source_type:string,page:int,section:string,chapter:string,chunk_index:int,"
    "start_char:int,end_char:int,extraction_method:string,extraction_confidence:double,extra:struct<extension:string,title:string>>"
)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Flat chunks of JSON files that hold lists of objects.

    The text is the first filled of text, content and document, the id that of chunk_id, metadata.chunk_id and id; what stands in the
    metadata is given beside them. Objects without an id or a text are left out.
    """
    raw = spark.read.schema(CHUNK_SCHEMA).option("multiLine", True).json(path)
    meta = [F.col(f"metadata.{c}") for c in ("file_name", "file_path", "source_type", "page", "section", "chapter", "chunk_index", "start_char", "end_char", "extraction_method", "extraction_confidence", "extra.extension", "extra.title")]
    rows = raw.select(
        first_filled(F.col("chunk_id"), F.col("metadata.chunk_id"), F.col("id")).alias("chunk_id"), first_filled(F.col("document_id"), F.col("metadata.document_id")).alias("document_id"),
        first_filled(F.col("text"), F.col("content"), F.col("document")).alias("text"), *meta, "matched_questions",
    )
    return rows.filter("chunk_id IS NOT NULL AND text IS NOT NULL")


def document_texts(units: DataFrame) -> DataFrame:
    """(document_id, text, page_count, is_empty): the filled units of each document, trimmed, joined by an empty line, in order."""
    trimmed = strip_space(F.coalesce("text", F.lit("")))
    rows = units.select("document_id", "unit_index", trimmed.alias("text"))
    grouped = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("unit_index", "text")))).alias("u"), F.count("*").cast("int").alias("page_count"))
    return grouped.select("document_id", F.array_join(F.transform("u", lambda x: x["text"]), "\n\n").alias("text"), "page_count", (F.size("u") == 0).alias("is_empty"))
