"""From questions to ranked evidence: expansion, fusion, merging, ranking and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorequarry.config import RANK_AUTHORITY
from lorequarry.functions.text import authority, first_filled, strip_space

#: Words that mark a name as one of a body, and the words a second query about it asks for (fixed values).
BODY_WORDS = "Cartel Vanguard House Order Guild Legion Council Faction Brotherhood Covenant".split()
EXPLORATORY_BODY_WORDS = "Cartel Vanguard House Order Guild Faction".split()
EXPANSION_WORDS = "accord war conflict victory won winner"


def expansion_names(names: Column, keywords: list[str] = BODY_WORDS, most: int = 3) -> Column:
    """The first names with one of the keywords in them; without any, the first names."""
    marked = F.filter(names, lambda n: n.rlike("|".join(keywords)))
    return F.slice(F.when(F.size(marked) > 0, marked).otherwise(names), 1, most)


def explored_queries(question: Column, names: Column, most: int = 5) -> Column:
    """One query for each name of a body, as many as there are; without any, for the first ``most`` names."""
    marked = F.filter(names, lambda n: n.rlike("|".join(EXPLORATORY_BODY_WORDS)))
    chosen = F.when(F.size(marked) > 0, marked).otherwise(F.slice(names, 1, most))
    return F.concat(F.array(question), F.transform(chosen, lambda n: F.concat_ws(" ", n, question, F.lit(EXPANSION_WORDS))))


def expanded_queries(question: Column, names: Column) -> Column:
    """The question, and for each name the name with the question and the name with the expansion words."""
    return F.concat(F.array(question), F.flatten(F.transform(names, lambda n: F.array(F.concat_ws(" ", n, question), F.concat_ws(" ", n, F.lit(EXPANSION_WORDS))))))


def fuse_first_seen(hits: DataFrame, group: str = "qid", id_col: str = "chunk_id") -> DataFrame:
    """Hits of several queries (``query_ord``, ``rank``) as one list: the first sighting of each row, in order of query and rank."""
    first = F.min(F.struct("query_ord", "rank", "score"))
    seen = hits.filter(first_filled(F.col(id_col).cast("string")).isNotNull()).groupBy(group, id_col).agg(first.alias("f"))
    order = F.row_number().over(Window.partitionBy(group).orderBy("f.query_ord", "f.rank", id_col))
    return seen.select(group, order.alias("ord"), id_col, "f.query_ord", "f.rank", "f.score")


def merge_evidence(evidence: DataFrame, group: str = "qid") -> DataFrame:
    """One item for each chunk (or text, where there is no chunk): that of the highest score, ties to the first; its place is that of the first sighting."""
    keyed = evidence.withColumn("_key", F.coalesce(first_filled(F.col("chunk_id")), F.col("text")))
    rest = [c for c in evidence.columns if c not in (group, "ord")]
    best = F.max_by(F.struct(*rest), F.struct("score", -F.col("ord")))
    return keyed.groupBy(group, "_key").agg(best.alias("b"), F.min("ord").alias("ord")).select(group, "ord", "b.*")


def rank_evidence(evidence: DataFrame, k: int = 8, group: str = "qid", table: dict[str, float] = RANK_AUTHORITY) -> DataFrame:
    """The k best by three quarters of the score and one quarter of the source's authority; ties keep their order."""
    scored = evidence.withColumn("score", F.coalesce("score", F.lit(0.5))).withColumn("authority_score", authority(F.col("source_type"), table))
    scored = scored.withColumn("final_score", F.round(0.75 * F.col("score") + 0.25 * F.col("authority_score"), 9))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("final_score"), "ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def select_candidates(hits: DataFrame, chunks: DataFrame, least: int = 100) -> DataFrame:
    """(chunk_id, text, matched_questions): the hit chunks of at least ``least`` characters, with the questions that hit them in order."""
    matched = hits.groupBy("chunk_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("question_ord", "question"))), lambda x: x["question"])).alias("matched_questions"), F.min(F.struct("question_ord", "rank")).alias("_o"))
    texts = chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"]).filter(F.length(strip_space(F.col("text"))) >= least)
    return texts.join(matched, "chunk_id").select("chunk_id", "text", "matched_questions", F.col("_o.question_ord").alias("first_question"), F.col("_o.rank").alias("first_rank"))
