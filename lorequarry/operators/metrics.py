"""Measures of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    wanted = F.array_distinct(relevant)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(F.slice(retrieved, 1, max(k, 0)), wanted)) / F.size(wanted)).otherwise(0.0)


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Distinct hits by the rows looked at; repeated rows count in the latter only."""
    n = F.least(F.lit(k), F.size(retrieved))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(retrieved, 1, max(k, 0)), relevant)) / n).otherwise(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    first = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull()))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def token_f1(predicted: Column, reference: Column) -> Column:
    """F1 of the word multisets: 1 if both are empty, 0 if one is."""
    tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    p, r = tokens(predicted), tokens(reference)
    shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(p, lambda x: x == t)), F.size(F.filter(r, lambda x: x == t))))
    return F.when((F.size(p) == 0) & (F.size(r) == 0), 1.0).when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(p) + F.size(r)))


def retrieval_report(ranked: DataFrame, k: int = 10) -> DataFrame:
    """(queries, precision, recall, mrr): means over rows of (retrieved, relevant)."""
    a, b = F.col("retrieved"), F.col("relevant")
    return ranked.agg(F.count("*").alias("queries"), F.avg(precision_at(a, b, k)).alias("precision"), F.avg(recall_at(a, b, k)).alias("recall"), F.avg(reciprocal_rank(a, b)).alias("mrr"))


def label_report(asked: DataFrame, hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """(queries, precision, recall, mrr) where the rows of a query's own label are the relevant ones.

    ``asked``: (query_id, label); ``hits``: (query_id, rank, vec_id); ``corpus``: (vec_id, label). Hits stay rows and a label is
    only counted, so no row grows with its label. Queries without hits or without a label are left out.
    """
    own = asked.select("query_id", F.col("label").alias("wanted")).filter("wanted IS NOT NULL")
    same = F.col("label") == F.col("wanted")
    rows = hits.select("query_id", "rank", "vec_id").join(corpus.select("vec_id", "label"), "vec_id", "left").join(own, "query_id")
    each = rows.groupBy("query_id", "wanted").agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("found"), F.min(F.when(same, F.col("rank"))).alias("first"))
    sizes = corpus.groupBy(F.col("label").alias("wanted")).agg(F.count("*").alias("size"))
    return each.join(sizes, "wanted").agg(
        F.count("*").alias("queries"), F.avg(F.col("found") / F.col("n")).alias("precision"), F.avg(F.col("found") / F.col("size")).alias("recall"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"),
    )
