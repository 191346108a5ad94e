"""Graphs as tables: mentions and co-occurrence of names, typed claims, neighbours and trails."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorequarry.functions.entities import NOISE_NAMES, passage_entities
from lorequarry.functions.text import first_filled
from lorequarry.session import cut_lineage, partitions
from lorequarry.sources.units import latest


def chunk_entities(chunks: DataFrame) -> DataFrame:
    """(chunk_id, entities): the sorted names of each chunk; a chunk delivered twice counts once."""
    return chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"]).select("chunk_id", passage_entities(F.col("text")).alias("entities"))


def mentions(entities: DataFrame) -> DataFrame:
    return entities.select(F.explode("entities").alias("entity"), "chunk_id")


def cooccurrence(entities: DataFrame) -> DataFrame:
    """(a, b, count), a < b: in how many chunks both names stand. Pairs are made within the row of their chunk and counted before the shuffle."""
    pairs = F.flatten(F.transform("entities", lambda a, i: F.transform(F.slice("entities", i + F.lit(2), F.size("entities")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return entities.filter(F.size("entities") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("count"))


def supported_by(entities: DataFrame) -> DataFrame:
    """(entity, chunk_id) of chunks with at least two names."""
    return entities.filter(F.size("entities") > 1).select(F.explode("entities").alias("entity"), "chunk_id")


def graph_counters(entities: DataFrame) -> DataFrame:
    n = F.size("entities").cast("long")
    return entities.agg(F.coalesce(F.sum(n), F.lit(0)).alias("mentions"), F.coalesce(F.sum(F.floor(n * (n - 1) / 2)), F.lit(0)).cast("long").alias("connections"))


#: Sizes of the prefixes by which strings meet the strings that contain them.
PREFIX_SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 20, 24, 29, 35, 42, 50, 60)
#: Parts in which bits of keys are put together.
KEY_BLOCKS = 64
#: A name of more chunks than this is a hub.
HUB = 64
#: Names in a piece of a list of neighbours, and seeds that are ranked in one place.
LIST_BLOCK, CELL_SEEDS = 1 << 16, 512
#: Chunks that are searched before all others.
FIRST_CHUNKS = 60


def _part_hashes(strings: list[str], prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """(string, key): hashes of all parts that have one of the sizes or, ``prefix``, of the longest such prefix of each string."""
    length = np.array([len(s) for s in strings], dtype=np.int64)
    end = np.cumsum(length)
    of = np.repeat(np.arange(len(strings)), length)
    here = np.arange(len(of))
    left = end[of] - here
    longest = np.array([0, *PREFIX_SIZES])[np.searchsorted(PREFIX_SIZES, length, side="right")][of]
    first = here == (end - length)[of]
    one = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    one = (one + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    one ^= one >> np.uint64(29)
    at, keys, sized, size = [], [], one, 1
    for n in PREFIX_SIZES:
        while size < n:  # the hash of a window goes on by one character
            sized = sized * np.uint64(0x100000001B3)
            sized[: max(0, len(sized) - size)] += one[size:]
            size += 1
        chosen = np.flatnonzero(first & (longest == n) if prefix else left >= n)
        at.append(of[chosen])
        mixed = (sized[chosen] + np.uint64(n)) * np.uint64(0x94D049BB133111EB)
        keys.append(((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return np.concatenate(at), np.concatenate(keys)


def _hashed(strings: DataFrame, prefix: bool, known: Broadcast | None = None) -> DataFrame:
    """(id, key) of (id, s); only of keys whose bit is set, if ``known`` has a bit for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                at, keys = _part_hashes(part.column("s").to_pylist(), prefix)
                if known is not None:
                    bits = known.value
                    slot = keys.view(np.uint32) >> np.uint32(32 - (8 * len(bits)).bit_length() + 1)
                    some = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    at, keys = at[some], keys[some]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), pa.array(keys)], names=["id", "key"])

    return strings.mapInArrow(run, "id long, key int")


def _key_bits(keys: DataFrame, rows: int) -> np.ndarray:
    """A bit for each key by its first bits, some 200 times as many as there are rows and 2^29 (64 MB) at most; blocks are put together in Spark."""
    log = min(max(rows.bit_length() + 7, 16), 29)
    per = (1 << log) // 8 // KEY_BLOCKS

    def blocks_of(bits: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bits.keys(), pa.int32()), pa.array([v.tobytes() for v in bits.values()], pa.binary())], names=["block", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = np.unique(batch.column("key").to_numpy().view(np.uint32) >> np.uint32(32 - log)).astype(np.int64)
            for block in np.unique(slot // (8 * per)).tolist():
                own = slot[slot // (8 * per) == block] - block * 8 * per
                np.bitwise_or.at(out.setdefault(block, np.zeros(per, dtype=np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        yield blocks_of(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                out[block] = out.get(block, np.zeros(per, dtype=np.uint8)) | np.frombuffer(bits, dtype=np.uint8)
        yield blocks_of(out)

    bits = np.zeros((KEY_BLOCKS, per), dtype=np.uint8)
    for row in keys.select("key").mapInArrow(mark, "block int, bits binary").repartition("block").mapInArrow(merge, "block int, bits binary").toLocalIterator():
        bits[row.block] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits.reshape(-1)


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long) of two tables (id, s) of distinct strings, the former contained in the latter. Only numbers meet; strings come back to what has met.

    Of the many parts, those that are no prefix of a short string stay where they are but for one in 100. Plans take parts for as small
    as the strings they are of, and would broadcast them; hence the hint.
    """
    keys = _hashed(short, True)
    known = short.sparkSession.sparkContext.broadcast(_key_bits(keys, short.count()))
    met = cut_lineage(keys.withColumnRenamed("id", "short_id").join(_hashed(long, False, known).hint("merge"), "key").select("short_id", "id").distinct())
    met = met.join(long.withColumnRenamed("s", "long"), "id").drop("id").withColumnRenamed("short_id", "id").join(short.withColumnRenamed("s", "short"), "id")
    return met.filter(F.col("long").contains(F.col("short"))).select("short", "long")


def substring_matches(left: DataFrame, right: DataFrame, left_col: str, right_col: str, both_ways: bool = True) -> DataFrame:
    """Distinct (left, right) with the left string in the right one or, ``both_ways``, the right in the left one; case is ignored.

    A string contained in another stands there with its prefix, so the hash of a long prefix is joined with those of all parts of the
    other; hardly a pair meets that is no match. Spellings that differ in case meet once. Null and empty strings match nothing.
    """
    a = left.select(F.col(left_col).alias(left_col)).filter(F.col(left_col) != "").distinct().withColumn("low_l", F.lower(left_col))
    b = right.select(F.col(right_col).alias(right_col)).filter(F.col(right_col) != "").distinct().withColumn("low_r", F.lower(right_col))
    low_a, low_b = (cut_lineage(x.select(F.col(c).alias("s")).distinct().select(F.xxhash64("s").alias("id"), "s")) for x, c in ((a, "low_l"), (b, "low_r")))
    pairs = _contained(low_a, low_b).toDF("low_l", "low_r")
    if both_ways:
        pairs = pairs.unionByName(_contained(low_b, low_a).toDF("low_r", "low_l"))
    return pairs.distinct().join(a, "low_l").join(b, "low_r").select(left_col, right_col)


def symmetric(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each edge in both directions, as (node, other)."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def graph_neighbours(seeds: DataFrame, entities: DataFrame, edges: DataFrame, limit: int = 20, both_ways: bool = True, noise: list[str] | None = None) -> DataFrame:
    """(seed, rank, name, count): names beside those that match a seed, the most frequent first, ties by name.

    ``limit`` holds for each seed; noise names are left out after it, as the search does. A seed matches names that contain it or,
    ``both_ways``, that it contains.
    """
    # Written, so that few matches are broadcast by their size and the edges stay where they are.
    matched = cut_lineage(substring_matches(seeds, entities, "seed", "entity", both_ways))
    beside = matched.join(symmetric(edges), F.col("entity") == F.col("node")).groupBy("seed", F.col("other").alias("name")).agg(F.sum("count").alias("count"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("count"), "name"))
    ranked = beside.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return ranked.filter(~F.col("name").isin(*(NOISE_NAMES if noise is None else noise))).select("seed", "rank", "name", "count")


def _numbered(rows: DataFrame, at: str, number: str) -> DataFrame:
    """A number from 0 on, without gaps, in place of ``at``, which is what ``monotonically_increasing_id`` gave when the table was written."""
    part = F.shiftright(at, 33)
    sizes = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    begin = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))]).tolist()
    return rows.withColumn(number, (F.get(F.array(*map(F.lit, begin)), part.cast("int")) + F.col(at) - F.shiftleft(part, 33)).cast("int")).drop(at)


def _sums(batches: Iterator[pa.RecordBatch], key: str, flat: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, values, sums) of rows in order of ``key``: values are distinct and sorted; flat(batch) gives values and weights of all rows and where each row begins."""
    now, held, size = None, [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        values, weights = (np.concatenate(x) for x in zip(*held))
        if not len(values):
            return values, weights
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return values[first], np.add.reduceat(weights[order], first)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        values, weights, begin = flat(batch)
        begins = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist()):
            if held and keys[lo] != now:
                yield now, *added()
                held, size = [], 0
            now = int(keys[lo])
            held.append((values[begin[lo] : begin[hi]], weights[begin[lo] : begin[hi]]))
            size += int(begin[hi] - begin[lo])
            if size > 16 * LIST_BLOCK:
                held, size = [added()], 0
    if held:
        yield now, *added()


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), kind))


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    low, high = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("low_bits", "high_bits"))
    return high << 16 | low & 0xFFFF


def _beside_each(rows: DataFrame, limit: int) -> DataFrame:
    """(node, level, low_bits, high_bits, n, bound) of (node, hub, others, levels), a row for each chunk of a name: what stands beside the name, and in how many chunks.

    Hubs have a row for each level of the others, other names one at level -1; lists are cut at ``LIST_BLOCK``. Numbers are in order,
    so the halves of their bits take about half as much place, compressed. ``bound``: of a hub, the count at the limit.
    """

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, others = batch.column("node").to_numpy(), batch.column("others")
        own = np.repeat(np.arange(len(node)), np.diff(others.offsets.to_numpy()))
        ids = others.flatten().to_numpy().astype(np.int64)
        levels = np.where(batch.column("hub").to_numpy(zero_copy_only=False)[own], batch.column("levels").flatten().to_numpy(), -1).astype(np.int64)
        some = ids != node[own]  # a name is not beside itself
        begin = np.concatenate([[0], np.cumsum(np.bincount(own[some], minlength=len(node)))])
        return ((levels + 1) << 32 | ids)[some], np.ones(int(begin[-1]), dtype=np.int64), begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            node, level, others, n, bound = zip(*out)
            halves = [_lists([x.astype(np.int16) for x in others], pa.int16()), _lists([(x >> 16).astype(np.int16) for x in others], pa.int16())]
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(level, pa.int32()), *halves, _lists(n, pa.int32()), pa.array(bound, pa.int32())], names=["node", "level", "low_bits", "high_bits", "n", "bound"])

        for node, packed, n in _sums(batches, "node", flat):
            levels, ids = packed >> 32, (packed & 0xFFFFFFFF).astype(np.int32)
            bound = int(np.partition(n, len(n) - limit)[len(n) - limit]) if len(n) >= limit else 0
            begins = np.concatenate([np.flatnonzero(np.concatenate([[True], levels[1:] != levels[:-1]])), [len(ids)]]).tolist() if len(ids) else [0]
            for lo, hi in zip(begins[:-1], begins[1:]):
                for at in range(lo, hi, LIST_BLOCK):
                    part = slice(at, min(hi, at + LIST_BLOCK))
                    out.append((node, int(levels[at]) - 1, ids[part], n[part].astype(np.int32), bound))
                    size += part.stop - at
            if size > 16 * LIST_BLOCK:
                yield made()
                out, size = [], 0
        if out:
            yield made()

    return rows.mapInArrow(run, "node int, level int, low_bits array<smallint>, high_bits array<smallint>, n array<int>, bound int")


def _first_of_each(rows: DataFrame, limit: int) -> DataFrame:
    """(low, other, count, rank) of (low, low_bits, high_bits, n) in order: the ``limit`` largest sums of a seed's own lists and its cell's, which come before its seeds, with a negative ``low``.

    What is not in a seed's own lists can only be among the first by the cell's sums alone, so of those the first suffice.
    """

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = batch.column("n")
        ends = n.offsets.to_numpy()
        return _numbers(batch), n.flatten().to_numpy().astype(np.int64), ends - ends[0]

    def first(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(n) > limit:
            some = n >= np.partition(n, len(n) - limit)[len(n) - limit]
            ids, n = ids[some], n[some]
        order = np.lexsort((ids, -n))[:limit]
        return ids[order], n[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            low, other, n = zip(*out)
            sizes = [len(x) for x in other]
            columns = [np.repeat(np.array(low, dtype=np.int64), sizes), np.concatenate(other).astype(np.int32), np.concatenate(n), np.concatenate([np.arange(1, k + 1, dtype=np.int32) for k in sizes])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["low", "other", "count", "rank"])

        shared = leading = None
        for low, ids, n in _sums(batches, "low", flat):
            if low < 0:
                shared, leading = (ids, n), first(ids, n)
                continue
            if len(shared[0]):
                at = np.minimum(np.searchsorted(shared[0], ids), len(shared[0]) - 1)
                more = ~np.isin(leading[0], ids)
                n = np.concatenate([n + np.where(shared[0][at] == ids, shared[1][at], 0), leading[1][more]])
                ids = np.concatenate([ids, leading[0][more]])
            out.append((low, *first(ids, n)))
            if len(out) >= 5000:
                yield made()
                out = []
        if out:
            yield made()

    return rows.mapInArrow(run, "low long, other int, count long, rank int")


def archive_neighbours(seeds: DataFrame, entities: DataFrame, limit: int = 20, both_ways: bool = True, noise: list[str] | None = None, hub: int = HUB) -> DataFrame:
    """``graph_neighbours`` for seeds as many as the archive has, from (chunk_id, entities); edges are not multiplied by seeds.

    Names are numbers in their order. What stands beside a name is one list, or for a hub, a name of more than ``hub`` chunks, a list
    for each level of the others' chunks. Seeds that match the same hubs are ranked in one cell, where the hubs' lists are added up once;
    a seed brings the lists of its other names. What is the last within the limit beside one of the hubs is a bound, and the lists of
    names in so few chunks that they cannot reach it stay where they are. Exact.
    """
    spark = entities.sparkSession
    level = lambda c: F.floor(F.log2(c.cast("double"))).cast("tinyint")
    entities = cut_lineage(entities.select(F.monotonically_increasing_id().alias("chunk_id"), "entities"))  # numbers of chunks move, not their ids
    names = mentions(entities).groupBy("entity").agg(F.count("*").alias("df")).orderBy("entity").withColumn("_at", F.monotonically_increasing_id())
    names = _numbered(cut_lineage(names.withColumn("level", level(F.col("df")))), "_at", "id")
    low = seeds.select("seed", F.lower("seed").alias("low")).filter("seed <> ''").distinct()
    lows = cut_lineage(low.select("low").distinct().withColumn("low_id", F.monotonically_increasing_id()))
    met = substring_matches(lows, names, "low", "entity", both_ways)
    met = cut_lineage(met.join(names, "entity").join(lows, "low").select("low_id", "id", "df"))
    is_hub = F.col("df") > hub

    known = names.join(met.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left").select("entity", "id", "level", is_hub.alias("hub"), F.coalesce("asked", F.lit(False)).alias("asked"))
    held = mentions(entities).hint("merge").join(known, "entity").groupBy("chunk_id").agg(F.collect_list(F.struct("id", "level", "hub", "asked")).alias("o")).filter(F.size("o") > 1)
    rows = held.select(F.explode(F.filter("o", lambda o: o["asked"])).alias("x"), F.col("o.id").alias("others"), F.col("o.level").alias("levels"))
    rows = rows.select(F.col("x.id").alias("node"), "x.hub", "others", "levels").repartition(partitions(spark), "node").sortWithinPartitions("node")
    beside = cut_lineage(_beside_each(rows, limit))

    # A name of df chunks stands at most df times beside each match, and beside all rare matches together no more often than those stand at all.
    bounds = beside.filter("level >= 0").groupBy(F.col("node").alias("id")).agg(F.max("bound").alias("bound"))
    rest, rare = F.sum(F.when(is_hub, 0).otherwise(F.col("df"))), F.sum((~is_hub).cast("long"))
    own = met.join(bounds, "id", "left").groupBy("low_id").agg(F.sort_array(F.collect_list(F.when(is_hub, F.col("id")))).alias("hubs"), rest.alias("rest"), rare.alias("rare"), F.coalesce(F.max("bound"), F.lit(0)).alias("bound"))
    n_hubs = F.greatest(F.size("hubs"), F.lit(1))
    own = cut_lineage(own.select("low_id", "hubs", F.greatest(F.ceil(F.col("bound") / (n_hubs + F.col("rare"))), F.ceil((F.col("bound") - F.col("rest")) / n_hubs), F.lit(1)).alias("least")))
    placed = own.join(own.groupBy("hubs").agg(F.ceil(F.count("*") / CELL_SEEDS).alias("parts")), "hubs").withColumn("part", F.pmod(F.xxhash64("low_id"), F.col("parts")))
    cells = cut_lineage(placed.groupBy("hubs", "part").agg(F.min("least").alias("least")).withColumn("cell", F.monotonically_increasing_id()))
    placed = cut_lineage(placed.join(cells.select("hubs", "part", "cell"), ["hubs", "part"]).select("low_id", "cell"))

    most = int(names.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0])
    of_cell = (-1 - F.col("cell")).alias("low")
    asked = cells.filter(level(F.col("least")) <= most).select("cell", of_cell, F.explode("hubs").alias("node"), F.sequence(level(F.col("least")).cast("int"), F.lit(most)).alias("levels")).select("cell", "low", "node", F.explode("levels").alias("level"))
    asked = asked.unionByName(met.filter(~is_hub).join(placed, "low_id").select("cell", F.col("low_id").alias("low"), F.col("id").alias("node"), F.lit(-1).alias("level")))
    lists = asked.join(beside.drop("bound").hint("merge"), ["node", "level"]).drop("node", "level")
    none = [F.array().cast(beside.schema[c].dataType).alias(c) for c in ("low_bits", "high_bits", "n")]
    each = cells.select("cell", of_cell).unionByName(placed.select("cell", F.col("low_id").alias("low"))).select("cell", "low", *none)
    ranked = _first_of_each(lists.unionByName(each).repartition(partitions(spark), "cell").sortWithinPartitions("cell", "low").drop("cell"), limit)

    ranked = ranked.join(names.select(F.col("id").alias("other"), F.col("entity").alias("name")), "other")
    kept = ranked.filter(~F.col("name").isin(*(NOISE_NAMES if noise is None else noise)))
    return low.join(lows, "low").join(kept.withColumnRenamed("low", "low_id"), "low_id").select("seed", "rank", "name", "count")


def evidence_search(query_names: DataFrame, entities: DataFrame, limit: int = 20, noise: list[str] | None = None, first_chunks: int = FIRST_CHUNKS) -> DataFrame:
    """(query_id, chunk_id, related): chunks of the names beside those that match a query's names, at most ``limit`` for each of them.

    ``entities``: (chunk_id, entities). A name's rows come in order of their chunks: the first chunks are searched first, and only names
    that find fewer than ``limit`` rows there go on to the whole archive, of which the first ``limit`` chunks of each related name count.
    """
    held = mentions(entities).hint("merge")  # a plan takes it for as small as the chunks' table
    matched = cut_lineage(substring_matches(query_names, held.select("entity"), "name", "entity", True))
    seen = cut_lineage(matched.join(held, "entity").select("name", "entity", "chunk_id"))
    order = Window.partitionBy("name").orderBy("chunk_id", "related")

    def found(seen: DataFrame, within: DataFrame) -> DataFrame:
        within = cut_lineage(within.select(F.col("entity").alias("related"), "chunk_id"))
        beside = seen.join(held.select("chunk_id", F.col("entity").alias("related")), "chunk_id").filter("entity <> related").select("name", "related")
        near = beside.join(within.select("related").distinct(), "related", "left_semi").distinct()
        return cut_lineage(near.join(within, "related").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit))

    begin = cut_lineage(held.select("chunk_id").distinct().orderBy("chunk_id").limit(first_chunks))
    first = found(seen, held.join(begin, "chunk_id"))
    full = first.filter(F.col("rank") == limit).select("name")
    nth = F.row_number().over(Window.partitionBy("entity").orderBy("chunk_id"))
    rest = found(seen.join(full, "name", "left_anti"), held.withColumn("_n", nth).filter(F.col("_n") <= limit).drop("_n"))
    rows = first.join(full, "name", "left_semi").unionByName(rest)
    kept = rows.filter(~F.col("related").isin(*(noise if noise is not None else NOISE_NAMES[:7])))
    return query_names.join(kept, "name").select("query_id", "chunk_id", "related").distinct()


def claim_graph(claims: DataFrame, order: str = "loaded_at") -> DataFrame:
    """Edges keyed by subject, predicate, object and chunk; of several claims the last one gives the evidence. Rows with a null name are no edges."""
    keys = ["subject", "predicate", "object", "chunk_id"]
    named = claims.filter("subject IS NOT NULL AND object IS NOT NULL AND predicate IS NOT NULL AND chunk_id IS NOT NULL")
    return latest(named.select(*keys, "evidence", "document_id", "source_type", order), keys, [order]).drop(order)


def claim_supports(edges: DataFrame) -> DataFrame:
    """(chunk_id, entity): the chunks that support a name."""
    return edges.select("chunk_id", F.explode(F.array("subject", "object")).alias("entity")).distinct()


def claim_neighbours(edges: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """(name, rank, other, predicate, chunk_id, evidence): claims that touch a name, exactly as it stands."""
    both = symmetric(edges.withColumnsRenamed({"subject": "a", "object": "b"}))
    rows = names.join(both, F.col("name") == F.col("node")).select("name", "other", "predicate", "chunk_id", "evidence")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("other", "predicate", "chunk_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("name", "rank", "other", "predicate", "chunk_id", "evidence")


def search_entities(edges: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """(name, rank, entity): names of the claim graph that contain ``name`` or that it contains, in order, for each name."""
    nodes = edges.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
    rank = F.row_number().over(Window.partitionBy("name").orderBy("entity"))
    return substring_matches(names, nodes, "name", "entity").withColumn("rank", rank).filter(F.col("rank") <= limit).select("name", "rank", "entity")


def trails(edges: DataFrame, seeds: DataFrame, max_hops: int = 3, limit: int | None = 50) -> DataFrame:
    """(seed, nodes, edge_ids, hops): walks of 1 to ``max_hops`` edges from each seed, against or along their direction, no edge twice.

    ``edges``: (edge_id, subject, object). Nodes may come again. ``limit`` keeps the shortest trails of each seed, ties by edge ids.
    Hops are held between 1 and 5; each hop is one join on the node reached. Under a limit a seed goes on only while it has fewer
    trails, and a node is left only by its first edges, as many as a trail can need: both leave the result as it is without them.
    """
    both = symmetric(edges.select("edge_id", F.col("subject").alias("a"), F.col("object").alias("b"))).filter("node <> other").unionByName(edges.filter("subject = object").select(F.col("subject").alias("node"), F.col("object").alias("other"), "edge_id"))
    hops = min(max(max_hops, 1), 5)
    here = seeds.select("seed").distinct().select("seed", F.array("seed").alias("nodes"), F.array().cast(f"array<{edges.schema['edge_id'].dataType.simpleString()}>").alias("edge_ids"), F.col("seed").alias("at"))
    if limit is not None:
        here = here.withColumn("have", F.lit(0).cast("long"))
        # Of the extensions of one trail the first by edge id come first; those of edges it holds already fall away.
        nth = F.dense_rank().over(Window.partitionBy("node").orderBy("edge_id"))
        both = both.withColumn("_n", nth).filter(F.col("_n") <= limit + hops - 1).drop("_n")
    both = cut_lineage(both)  # each hop reads the edges, and each later hop and the result the hop
    found = []
    for _ in range(hops):
        rest = ["have"] if limit is not None else []
        here = here.join(both, F.col("at") == F.col("node")).filter(~F.array_contains("edge_ids", F.col("edge_id")))
        here = here.select("seed", F.concat("nodes", F.array("other")).alias("nodes"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), F.col("other").alias("at"), *rest)
        if limit is not None:
            rank = F.row_number().over(Window.partitionBy("seed").orderBy("edge_ids", "nodes"))
            here = here.withColumn("_r", rank).filter(F.col("_r") <= limit).filter(F.col("_r") <= limit - F.col("have")).drop("_r")
            here = here.withColumn("have", F.col("have") + F.count("*").over(Window.partitionBy("seed")))
        here = cut_lineage(here)
        found.append(here)
        if limit is not None:
            here = here.filter(F.col("have") < limit)
    return reduce(DataFrame.unionByName, found).select("seed", "nodes", "edge_ids", F.size("edge_ids").alias("hops"))


def with_relationships(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Trails with ``relationships``: predicate, evidence and provenance of each edge, in order."""
    facts = F.struct(*[F.col(c) if c in edges.columns else F.lit(None).cast("string").alias(c) for c in ("predicate", "evidence", "chunk_id", "document_id", "source_type")])
    keyed = paths.withColumn("_k", F.xxhash64("seed", "nodes", "edge_ids"))
    of = keyed.select("_k", F.posexplode("edge_ids").alias("_i", "edge_id")).distinct().join(edges.select("edge_id", facts.alias("_f")), "edge_id")
    lists = of.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_f"))), lambda x: x["_f"]).alias("relationships"))
    return keyed.join(lists, "_k").drop("_k")


def path_summary(nodes: Column, relationships: Column) -> Column:
    """'a -[PREDICATE]-> b' for each edge, joined by ' | '."""
    steps = F.transform(relationships, lambda r, i: F.concat(F.get(nodes, i), F.lit(" -["), F.coalesce(first_filled(r["predicate"]), F.lit("RELATED_TO")), F.lit("]-> "), F.get(nodes, i + 1)))
    return F.array_join(F.filter(steps, lambda s: s.isNotNull()), " | ")


def graph_evidence(paths: DataFrame) -> DataFrame:
    """(seed, ord, text, chunk_id, document_id, source_type, predicate, score): the edges with evidence of all trails; score 1 / hops."""
    order = F.row_number().over(Window.partitionBy("seed").orderBy("hops", "edge_ids", "nodes", "_i")) - 1
    rows = paths.select("seed", "hops", "edge_ids", "nodes", F.posexplode("relationships").alias("_i", "r")).filter(first_filled(F.col("r.evidence")).isNotNull())
    return rows.select("seed", order.alias("ord"), F.col("r.evidence").alias("text"), "r.chunk_id", "r.document_id", "r.source_type", "r.predicate", (F.lit(1.0) / F.greatest("hops", F.lit(1))).alias("score"))


def detect_conflicts(claims: DataFrame) -> DataFrame:
    """(subject, predicate, objects, n_claims) of which claims give several objects; null counts as one of them but is not listed.

    Objects are made distinct before they are gathered, so a list is as long as its distinct objects, not as its claims.
    """
    counted = claims.groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))
    grouped = counted.groupBy("subject", "predicate").agg(F.sort_array(F.collect_list("object")).alias("objects"), F.count("*").alias("n_objects"), F.sum("n").alias("n_claims"))
    return grouped.filter("n_objects > 1").select("subject", "predicate", "objects", "n_claims")
