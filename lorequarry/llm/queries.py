"""Registered queries of the operators for training data, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorequarry.llm.leakage import leaked_items, without_leaks
from lorequarry.llm.names import spelling_pairs, spellings
from lorequarry.llm.neardup import duplicate_classes, similar_pairs
from lorequarry.llm.pairing import item_pairs
from lorequarry.llm.scans import page_damage, repaired_pages
from lorequarry.llm.splitting import split_oversized
from lorequarry.llm.subjects import document_areas
from lorequarry.llm.tokenizing import decode_corpus, encode_corpus
from lorequarry.session import cut_lineage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(table(spark, sf_dir, "claims"))


@query
def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(table(spark, sf_dir, "claims"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_damage(table(spark, sf_dir, "loaded_pages"))


@query
def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_pages(table(spark, sf_dir, "loaded_pages"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "text_chunks")).select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


@query
def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "text_chunks"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf_dir, "text_chunks"))
    return pieces.filter("piece_index = 1").select("chunk_id").distinct()


@query
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "text_chunks"))


@query
def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text that was cut: where its pieces begin and end, and how many of them are too long, leave a gap, or repeat too much."""
    pieces = split_oversized(table(spark, sf_dir, "text_chunks"))
    before = F.lag("end_char").over(Window.partitionBy("chunk_id", "section", "text_length").orderBy("piece_index"))
    texts = table(spark, sf_dir, "text_chunks").select("chunk_id", "section", "text").distinct()
    held = pieces.join(texts, pieces["chunk_id"].eqNullSafe(texts["chunk_id"]) & pieces["section"].eqNullSafe(texts["section"])).select(pieces["*"], "text", F.length("text").alias("text_length"))
    held = held.filter(F.col("piece") == F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))).withColumn("before", before)
    wrong = (F.length("piece") > 1200) | (F.col("start_char") > F.col("before")) | (F.col("before") - F.col("start_char") > 200)
    return held.groupBy("chunk_id").agg(F.min("start_char").alias("first"), F.max("end_char").alias("last"), F.count_if(wrong).alias("wrong"))


SQL["p4_cover"] = "SELECT chunk_id, 0 AS first, max(length(text))::INT AS last, 0::BIGINT AS wrong FROM text_chunks WHERE length(text) > 1200 GROUP BY 1"
SQL["p4_found"] = "SELECT DISTINCT chunk_id FROM text_chunks WHERE length(text) > 1200"


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_pairs(table(spark, sf_dir, "claims")).select("item_a", "item_b")


@query
def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_pairs(table(spark, sf_dir, "claims"))


_PAIRS = """
WITH items AS (
  SELECT DISTINCT chunk_id, item FROM (SELECT chunk_id, subject AS item FROM claims UNION ALL SELECT chunk_id, object FROM claims)
  WHERE chunk_id IS NOT NULL AND item IS NOT NULL),
n AS (SELECT item, count(*) AS n FROM items GROUP BY item),
total AS (SELECT count(DISTINCT chunk_id) AS n_baskets FROM items),
together AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM items a JOIN items b ON a.chunk_id = b.chunk_id AND a.item < b.item
  GROUP BY 1, 2 HAVING count(*) >= 8)
SELECT {columns} FROM together JOIN n x ON x.item = item_a JOIN n y ON y.item = item_b, total
WHERE n_ab * n_baskets >= 4 * x.n * y.n
"""
SQL["p5_found"] = _PAIRS.format(columns="item_a, item_b")
SQL["p5_scores"] = _PAIRS.format(columns="item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, n_baskets, CAST(n_ab AS DOUBLE) * n_baskets / (CAST(x.n AS DOUBLE) * y.n) AS ratio")


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


@query
def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts back from their ids, with the number of ids that do not begin where the id before them ends."""
    ids = encode_corpus(table(spark, sf_dir, "documents"), with_offsets=True)
    gaps = F.size(F.filter(F.transform("starts", lambda x, i: F.when(i > 0, x <= F.get("starts", i - 1)).otherwise(x != 0)), lambda x: x))
    marks = cut_lineage(ids.select("doc_id", "ids", gaps.cast("long").alias("gaps")))
    return decode_corpus(marks).join(marks.select("doc_id", "gaps"), "doc_id").select("doc_id", F.md5("text").alias("text"), "gaps")


SQL["p6_decoded"] = "SELECT doc_id, md5(coalesce(text, '')) AS text, 0::BIGINT AS gaps FROM documents"


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).select("doc_id", "area")


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_samples"), table(spark, sf_dir, "subject_areas"))
