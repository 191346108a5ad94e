"""Pairs of the members of groups of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.session import cut_lineage

#: Members of a group that meet in one place; a larger group is cut into cells of blocks of about this many.
GROUP_BLOCK = 1024


def pairs_within(rows: DataFrame, key: str, member: str, block: int = GROUP_BLOCK) -> DataFrame:
    """(member_a, member_b), member_a < member_b: all pairs of members of one ``key``; for results that ask for every pair.

    The members of a large group are cut into blocks by hash; each two blocks meet in a cell of their own, so a hot group
    spreads over many tasks. Rows are expected once; null keys pair nothing.
    """
    rows = rows.select(F.col(key).alias("_k"), F.col(member).alias("m"))
    sizes = cut_lineage(rows.groupBy("_k").agg(F.count("*").alias("n")).filter("n > 1").select("_k", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    cells = rows.join(sizes, "_k").withColumn("own", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int")).select("_k", "m", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # A pair of blocks i < j meets in cell (i, j), from i on the left and from j on the right; a block meets itself in (i, i).
    left = cells.filter("own <= other").select("_k", F.col("own").alias("i"), F.col("other").alias("j"), F.col("m").alias("l"))
    right = cells.filter("own >= other").select("_k", F.col("other").alias("i"), F.col("own").alias("j"), F.col("m").alias("r"))
    met = left.join(right, ["_k", "i", "j"]).filter((F.col("l") < F.col("r")) | ((F.col("i") < F.col("j")) & (F.col("l") > F.col("r"))))
    return met.select(F.least("l", "r").alias(f"{member}_a"), F.greatest("l", "r").alias(f"{member}_b"))
