"""Read questions in any of the accepted shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions.text import first_filled, strip_space

_FIELDS = "struct<qid:string,track:string,question:string,query:string,text:string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(ord, qid, track, question) of a JSON file: a list, or a list under 'questions' or 'items', of strings or objects."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    body = F.coalesce(F.get_json_object("value", "$.questions"), F.get_json_object("value", "$.items"), F.col("value"))
    items = raw.select(F.posexplode(F.from_json(body, "array<string>")).alias("ord", "item"))
    return question_columns(items.withColumn("q", F.from_json("item", _FIELDS)).select("ord", "item", "q.*"))


def question_columns(df: DataFrame) -> DataFrame:
    """The first filled of question, query and text, else the bare string; blank ones are left out."""
    have = [F.col(c) for c in ("question", "query", "text") if c in df.columns]
    bare = [F.when(~F.col("item").startswith("{"), F.col("item"))] if "item" in df.columns else []
    extra = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("ord", "qid", "track")]
    return df.select(*extra, strip_space(first_filled(*have, *bare)).alias("question")).filter("question <> ''")
