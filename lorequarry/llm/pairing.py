"""Problem 5: items that appear together more often than chance, with large-basket blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.session import cut_lineage

#: Items of a basket that one task pairs up at once; larger baskets are cut into blocks of about this many items.
BLOCK_ITEMS = 128


def _pairs_within(items: Column) -> Column:
    """All (a, b), a < b, of a sorted array of distinct items."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + F.lit(2), F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def item_pairs(df: DataFrame, basket_col: str = "chunk_id", item_cols: tuple[str, ...] = ("subject", "object"), min_count: int = 8, min_ratio: float = 4.0, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pairs of different items in at least ``min_count`` baskets together and ``min_ratio`` times as often as chance.

    Columns: ``item_a`` < ``item_b``, ``n_ab``, ``n_a``, ``n_b``, ``n_baskets``, ``ratio`` = n_ab * n_baskets / (n_a * n_b).
    Null baskets and null items do not count; an empty string is an item; repeated rows and an item in both columns count once;
    other columns are ignored; an empty table gives no row.

    Items in fewer than ``min_count`` rows, then in fewer baskets, cannot be in a result pair and leave before pairing (exact); the
    others go by number. Ordinary baskets are paired in one array. A basket that may hold more than ``block_items`` is cut into
    blocks by hash of the item; block i and block j meet in the cell (i, j), each cell is its own group, so the pairs of a hot
    basket spread over many tasks and no group holds it whole. Counts are combined before every shuffle. The tables of frequent
    items and of large baskets are written, so Spark broadcasts them only by their size.
    """
    entries = df.filter(F.col(basket_col).isNotNull()).select(F.col(basket_col).alias("basket"), F.array_compact(F.array(*[F.col(c).cast("string") for c in item_cols])).alias("items")).filter(F.size("items") > 0)
    baskets = cut_lineage(entries.groupBy("basket").agg(F.sum(F.size("items")).alias("most")))
    n_baskets = baskets.agg(F.count("*").alias("n_baskets")).scalar()
    large = cut_lineage(baskets.filter(F.col("most") > block_items).select("basket", F.ceil(F.col("most") / block_items).cast("int").alias("blocks")))

    rows = entries.select("basket", F.explode("items").alias("item"))
    named = cut_lineage(rows.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select("item", F.monotonically_increasing_id().alias("no")))
    held = cut_lineage(rows.join(named, "item").select("basket", "no").distinct())
    counts = cut_lineage(held.groupBy("no").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).join(named, "no"))
    frequent = held.join(counts.select("no"), "no", "left_semi").join(large, "basket", "left")

    ordinary = frequent.filter("blocks IS NULL").groupBy("basket").agg(F.array_sort(F.collect_list("no")).alias("items"))
    pairs = ordinary.filter(F.size("items") > 1).select(F.explode(_pairs_within(F.col("items"))).alias("p")).select("p.*")

    blocked = frequent.filter("blocks IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    cells = blocked.select("basket", "no", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "basket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "no", (F.col("block") <= F.col("other")).alias("left")
    )
    products = cells.groupBy("basket", "i", "j").agg(
        F.array_sort(F.collect_list(F.when(F.col("left"), F.col("no")))).alias("left_items"),
        F.array_sort(F.collect_list(F.when(~F.col("left"), F.col("no")))).alias("right_items"),
    )
    across = F.flatten(F.transform("left_items", lambda a: F.transform("right_items", lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))
    pairs = pairs.unionByName(products.select(F.explode(F.when(F.col("i") == F.col("j"), _pairs_within(F.col("left_items"))).otherwise(across)).alias("p")).select("p.*"))

    together = pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    x, y = (counts.select(F.col("no").alias(s), F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    first = F.col("item_a") < F.col("item_b")
    either = lambda c, d, name: F.when(first, F.col(c)).otherwise(F.col(d)).alias(name)
    scored = together.join(x, "a").join(y, "b").select(
        either("item_a", "item_b", "item_a"), either("item_b", "item_a", "item_b"), "n_ab", either("n_a", "n_b", "n_a"), either("n_b", "n_a", "n_b"), n_baskets.alias("n_baskets")
    )
    return scored.withColumn("ratio", F.col("n_ab").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))).filter(
        F.col("n_ab").cast("double") * F.col("n_baskets") >= F.lit(min_ratio) * F.col("n_a").cast("double") * F.col("n_b")
    )
