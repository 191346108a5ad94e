"""Problem 3: pairs and classes of texts whose word-shingle similarity reaches a threshold.

1. A frequency table of all shingles, of fixed size, gives one total order of shingles, rarest first. Two sets of n and m
   shingles with Jaccard >= t share at least t / (1 + t) * (n + m) of them, so they share one of their first n - ceil(t n) + 1.
2. Every record is sent to the keys of that prefix. Records of one key stand in a signature tree: nodes hold OR-combined
   token bitmaps, size ranges and the most tokens that are left; a dual traversal of the tree with itself drops node pairs
   whose maximum possible overlap is below the required one.
3. Surviving pairs are held against wider bitmaps and then against the shingles themselves.

Records with equal shingle sets are one class from the start, so copies are never paired among each other before the end.
The order only decides how much work there is: the result is exact whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.grouping import pairs_within
from lorequarry.llm.textarrays import Words, mix, ngram_hashes, slices
from lorequarry.session import cut_lineage, partitions

#: log2 of the slots of the frequency table, from 22 to 26 with the number of rows: 1 byte a slot, so at most 64 MB are broadcast.
#: A table too small for its corpus makes longer lists of candidates, never another result.
TABLE_BITS = (22, 26)
#: A slot holds the logarithm of its count in eighths of a doubling: 0, 8 and 13 stand for none, one and two.
COUNT_OF = 2.0 ** (np.arange(256) / 8) - 1
ONCE = 8
#: Parts in which the tables of the tasks are added up: at most so many tasks share that work.
TABLE_BLOCKS = 1024
#: Words (64 bits each) of a token bitmap.
BITMAP_WORDS = 4
#: Children of a node. The tree of a key with more records has inner nodes and carries bitmaps; a smaller one is a single leaf, whose
#: records are held against each other by size and tokens left, and their pairs against the bitmaps once for all keys they share.
FAN = 8
#: A key that more records than this may have is cut into cells of blocks.
HOT_KEY = 4096
FRONTIER = 1 << 16


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by (text, hash); and the text of each."""
    words = Words(texts)
    grams, first = ngram_hashes(words.hash, words.text, n)
    text = words.text[first]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], text[new]


def class_keys(grams: np.ndarray, text: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each text's shingle set (0 for an empty set), and its size."""
    size = np.bincount(text, minlength=count)
    key = np.zeros(count, dtype=np.uint64)
    np.add.at(key, text, mix(grams ^ np.uint64(0x5851F42D4C957F2D)))
    return np.where(size > 0, mix(key + size.astype(np.uint64)) | np.uint64(1), np.uint64(0)), size


def bitmaps(grams: np.ndarray, text: np.ndarray, count: int, words: int = BITMAP_WORDS) -> np.ndarray:
    out = np.zeros((count, words), dtype=np.uint64)
    bit = (grams % np.uint64(64 * words)).astype(np.int64)
    np.bitwise_or.at(out, (text, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def required(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of sets of n and m tokens with Jaccard >= t."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class SignatureForest:
    """One signature tree for each key; records come sorted by (key, size).

    Levels go up from the records; a node covers up to FAN consecutive children of its tree.
    """

    def __init__(self, key: np.ndarray, size: np.ndarray, left: np.ndarray, bitmap: np.ndarray, side: np.ndarray):
        self.side = side
        excess = size - _popcount(bitmap)
        level = {"tree": np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1, "low": size, "high": size, "left": left, "bits": bitmap, "excess": excess}
        self.levels = [level]
        while len(level["tree"]) > level["tree"][-1] + 1:
            tree = level["tree"]
            begin = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            rank = np.arange(len(tree)) - np.repeat(begin, np.diff(np.append(begin, len(tree))))
            first = np.flatnonzero(rank % FAN == 0)
            level = {
                "tree": tree[first],
                "low": np.minimum.reduceat(level["low"], first),
                "high": np.maximum.reduceat(level["high"], first),
                "left": np.maximum.reduceat(level["left"], first),
                "bits": np.bitwise_or.reduceat(level["bits"], first, axis=0),
                "excess": np.maximum.reduceat(level["excess"], first),
                "first": first,
                "children": np.diff(np.append(first, len(tree))),
            }
            self.levels.append(level)

    def _possible(self, depth: int, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """Whether two nodes may hold records whose overlap suffices."""
        v = self.levels[depth]
        need = required(v["low"][a], v["low"][b], t)
        most = np.minimum(v["left"][a], v["left"][b])
        ok = (most >= need) & (v["high"][a] >= t * v["low"][b] - 1e-9) & (v["high"][b] >= t * v["low"][a] - 1e-9)
        keep = np.flatnonzero(ok)
        a, b, need = a[keep], b[keep], need[keep]
        x, y = v["bits"][a], v["bits"][b]
        if depth:
            most = _popcount(x & y) + np.minimum(v["excess"][a], v["excess"][b])
        else:
            most = np.minimum(v["low"][a] - _popcount(x & ~y), v["low"][b] - _popcount(y & ~x))
        return keep[most >= need]

    def pairs(self, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of records of one tree that the traversal cannot rule out."""
        top = np.arange(len(self.levels[-1]["tree"]))
        stack = [(len(self.levels) - 1, top[i : i + FRONTIER], top[i : i + FRONTIER]) for i in range(0, len(top), FRONTIER)]
        while stack:
            depth, a, b = stack.pop()
            if not depth:
                apart = (a != b) & ((self.side[a] == 0) | (self.side[a] != self.side[b]))
                yield a[apart], b[apart]
                continue
            v = self.levels[depth]
            na, nb = v["children"][a], v["children"][b]
            n = na * nb
            which = np.repeat(np.arange(len(a)), n)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            x, y = v["first"][a][which] + inner // nb[which], v["first"][b][which] + inner % nb[which]
            once = x <= y
            x, y = x[once], y[once]
            keep = self._possible(depth - 1, x, y, t)
            x, y = x[keep], y[keep]
            stack += [(depth - 1, x[i : i + FRONTIER], y[i : i + FRONTIER]) for i in range(0, len(x), FRONTIER)]


def table_bits(rows: int) -> int:
    return min(max(rows.bit_length() + 7, TABLE_BITS[0]), TABLE_BITS[1])


def frequency_table(texts: DataFrame, n: int, bits: int = TABLE_BITS[0]) -> np.ndarray:
    """Logarithms of the counts of all shingles of all texts, by the first ``bits`` bits of the hash.

    Each task counts into one array; blocks of the arrays are added up in a stream, so no task holds more than its blocks.
    """
    per = (1 << bits) // TABLE_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=np.uint16)
        for batch in batches:
            for _, part in slices(batch, "text"):
                grams, _ = shingle_sets(part, n)
                slot, times = np.unique((grams >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                table[slot] = np.minimum(table[slot].astype(np.int64) + times, 65535)
        for plane, values in enumerate((table & 255, table >> 8)):
            for block, part in enumerate(values.astype(np.uint8).reshape(TABLE_BLOCKS, per)):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "plane": pa.array([plane], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, plane, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "plane", "counts"))):
                total = sums.setdefault(block, np.zeros(per, dtype=np.int64))
                total += np.frombuffer(counts, dtype=np.uint8).astype(np.int64) << (8 * plane)
        for block, total in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([np.minimum(np.rint(8 * np.log2(1 + total)), 255).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros((TABLE_BLOCKS, per), dtype=np.uint8)
    counted = texts.mapInArrow(count, "block int, plane int, counts binary").repartition("block")
    for row in counted.mapInArrow(add, "block int, counts binary").toLocalIterator():
        out[row.block] = np.frombuffer(row.counts, dtype=np.uint8)
    return out.reshape(-1)


def _signatures(texts: DataFrame, n: int) -> DataFrame:
    """id, class key, hash of the text, size and bitmap of every text with a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in slices(batch, "text"):
                grams, text = shingle_sets(some, n)
                key, size = class_keys(grams, text, len(some))
                bits = bitmaps(grams, text, len(some))
                full = np.flatnonzero(size)
                columns = [part.column(c).take(pa.array(full)) for c in ("id", "mark")] + [pa.array(key[full].view(np.int64)), pa.array(size[full].astype(np.int32)), pa.array([b.tobytes() for b in bits[full]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "cls", "size", "bits"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, mark long, cls long, size int, bits binary")


def _prefix_rows(texts: DataFrame, n: int, t: float, table) -> DataFrame:  # noqa: ANN001
    """(key, cls, size, left, side, bits) for the prefix of every class; a class is sent once by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        # What nearly every slot holds is no sign of a hot key. More is not taken off, so no hot key is missed, however full the table is.
        noise = int(COUNT_OF[np.searchsorted(np.cumsum(np.bincount(counts, minlength=256)), len(counts) // 100, side="right")])
        shift = np.uint64(64 - (len(counts).bit_length() - 1))
        seen: set[int] = set()
        for batch in batches:
            for _, some in slices(batch, "text"):
                grams, text = shingle_sets(some, n)
                key, size = class_keys(grams, text, len(some))
                fresh = np.zeros(len(some), dtype=bool)
                for i, k in enumerate(key.tolist()):
                    fresh[i] = k not in seen
                    seen.add(k)
                often = counts[(grams >> shift).astype(np.int64)].astype(np.int64)
                order = np.lexsort((grams, often, text))
                g, x, c = grams[order], text[order], often[order]
                place = np.arange(len(g)) - (np.cumsum(size) - size)[x]
                prefix = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
                keep = (place < prefix[x]) & (c > ONCE) & fresh[x]
                g, x, c, place = g[keep], x[keep], c[keep], place[keep]
                bits = bitmaps(grams, text, len(some))
                c = COUNT_OF[c].astype(np.int64) - noise
                # A hot key: the record goes to the cells of its block with every block.
                blocks = np.where(c > HOT_KEY, -(-c // HOT_KEY), 1)
                cell = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                g, x, c, place, blocks = (np.repeat(v, blocks) for v in (g, x, c, place, blocks))
                own = (mix(key[x]) % blocks.astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(own, cell), np.maximum(own, cell)
                g = np.where(blocks > 1, mix(g + (low * blocks + high + 1).astype(np.uint64)), g)
                side = np.where(low == high, 0, np.where(own == low, 1, 2))
                wide = c > FAN
                packed = (size[x] << 34) | ((size[x] - place) << 3) | side
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(key[x].view(np.int64)), pa.array(packed), pa.array([bits[i].tobytes() if w else None for i, w in zip(x.tolist(), wide.tolist())], pa.binary())],
                    names=["key", "cls", "packed", "bits"],
                )

    return texts.select("text").mapInArrow(run, "key long, cls long, packed long, bits binary")


def _tree_pairs(rows: DataFrame, t: float) -> DataFrame:
    """Candidate pairs of classes from the signature trees of all keys; rows come sorted by key."""

    def joined(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        table = pa.Table.from_batches(parts)
        key, cls, packed = (table.column(c).to_numpy() for c in ("key", "cls", "packed"))
        every = b"\xff" * (8 * BITMAP_WORDS)
        bits = np.frombuffer(b"".join(b or every for b in table.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, BITMAP_WORDS)
        size = packed >> 34
        order = np.lexsort((cls, size, key))
        key, cls, packed, bits, size = key[order], cls[order], packed[order], bits[order], size[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        shared = np.zeros(len(key), dtype=bool)
        key, cls, packed, bits, size = key[new], cls[new], packed[new], bits[new], size[new]
        same = key[1:] == key[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return key[shared], cls[shared], packed[shared], bits[shared], size[shared]

    def pairs_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cls, packed, bits, size = joined(parts)
        if len(key):
            for a, b in SignatureForest(key, size, (packed >> 3) & 0x7FFFFFFF, bits, packed & 7).pairs(t):
                low, high = np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["cls_a", "cls_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if not cut:
                held.append(batch)
                continue
            yield from pairs_of([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        if held:
            yield from pairs_of(held)

    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "cls_a long, cls_b long")


def similar_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members: id, cls; links: cls_a < cls_b, similarity): the classes of equal shingle sets, and all links between classes."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    table = spark.sparkContext.broadcast(frequency_table(texts.select("text"), shingle, table_bits(df.count())))
    texts = texts.withColumn("mark", F.xxhash64("text"))
    signatures = cut_lineage(_signatures(texts, shingle).dropDuplicates(["id", "cls"]))
    members = signatures.select("id", "cls")
    # The text of a class is that of its least id; an id may have been delivered with other texts too, so the text's hash says which.
    classes = cut_lineage(signatures.groupBy("cls").agg(F.min(F.struct("id", "mark")).alias("of"), F.first("size").alias("size"), F.first("bits").alias("bits")).select("cls", "of.id", "of.mark", "size", "bits"))

    candidates = _tree_pairs(_prefix_rows(texts, shingle, threshold, table), threshold).repartition("cls_a").dropDuplicates(["cls_a", "cls_b"])
    side = lambda s: classes.select(F.col("cls").alias(f"cls_{s}"), F.col("size").alias(f"size_{s}"), F.col("bits").alias(f"bits_{s}"))
    joined = candidates.join(side("a"), "cls_a").join(side("b"), "cls_b")

    def overlap_possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, BITMAP_WORDS) for c in ("bits_a", "bits_b"))
            n, m = batch.column("size_a").to_numpy().astype(np.int64), batch.column("size_b").to_numpy().astype(np.int64)
            ok = np.minimum(n - _popcount(x & ~y), m - _popcount(y & ~x)) >= required(n, m, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("cls_a", "cls_b")], names=["cls_a", "cls_b"])

    likely = cut_lineage(joined.select("cls_a", "cls_b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(overlap_possible, "cls_a long, cls_b long"))

    # Only the texts of classes in a likely pair are moved, once for each pair; the table of those classes is written, so it is broadcast only by its size.
    needed = cut_lineage(likely.select(F.col("cls_a").alias("cls")).union(likely.select("cls_b")).distinct().join(classes.select("cls", "id", "mark"), "cls"))
    held = cut_lineage(texts.join(needed, ["id", "mark"]).select("cls", "text").dropDuplicates(["cls"]))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(texts: list[str]) -> list[np.ndarray]:
            grams, text = shingle_sets(texts, shingle)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            return [grams[i:j] for i, j in zip(bounds[:-1], bounds[1:])]

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                x, y = sets(part.column("text_a").to_pylist()), sets(part.column("text_b").to_pylist())
                both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], dtype=np.float64)
                either = np.array([len(p) + len(q) for p, q in zip(x, y)], dtype=np.float64) - both
                ok = pa.array(both >= threshold * either - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("cls_a").filter(ok), part.column("cls_b").filter(ok), pa.array(both / either).filter(ok)], names=["cls_a", "cls_b", "similarity"])

    text_of = lambda s: held.select(F.col("cls").alias(f"cls_{s}"), F.col("text").alias(f"text_{s}"))
    links = likely.join(text_of("a"), "cls_a").join(text_of("b"), "cls_b").select("cls_a", "cls_b", "text_a", "text_b").mapInArrow(verified, "cls_a long, cls_b long, similarity double")
    return members, links


def similar_pairs(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", threshold: float = 0.6, shingle: int = 3) -> DataFrame:
    """All pairs of different ids, ``id_a`` < ``id_b``, whose texts have a Jaccard similarity of word shingles of at least ``threshold``.

    Exact. Words are runs of letters and digits of the lower-cased text. Texts with fewer than ``shingle`` words, null and empty
    texts have no shingles and no pair; repeated rows count once; an id with several texts is paired by any of them (the largest
    similarity is given); other columns are ignored; an empty table gives no row. Rows of the result grow with the copies, since
    every pair of ids is asked for; ``duplicate_classes`` gives one row for each id instead.
    """
    members, links = similar_classes(df, id_col, text_col, threshold, shingle)
    links = cut_lineage(links)
    a, b = (members.select(F.col("id").alias(f"id_{s}"), F.col("cls").alias(f"cls_{s}")) for s in "ab")
    across = links.join(a, "cls_a").join(b, "cls_b").select("id_a", "id_b", "similarity")
    within = pairs_within(members, "cls", "id").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    both = across.unionByName(within).filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")
    return both.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def duplicate_classes(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", threshold: float = 0.6, shingle: int = 3) -> DataFrame:
    """One row for each id with a shingle: ``class_id`` (the least id with the same shingle set), ``copies`` in the class, ``links`` to other classes."""
    members, links = similar_classes(df, id_col, text_col, threshold, shingle)
    ends = links.select(F.col("cls_a").alias("cls")).union(links.select("cls_b")).groupBy("cls").agg(F.count("*").alias("links"))
    classes = members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).join(ends, "cls", "left")
    return members.join(classes, "cls").select(F.col("id").alias(id_col), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
