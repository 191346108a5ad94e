"""The best match of a name among candidates by the ratio of matching characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.functions.text import normalize_entity_name
from lorequarry.operators.graph import _key_bits
from lorequarry.session import cut_lineage, partitions

#: Longest name whose parts meet only parts at their own place in candidates; parts of longer ones meet them anywhere.
PLACED = 64
#: Shorter candidates have ratio 1 to equal strings and to no others; in longer ones the matcher skips frequent characters.
SKIPS_FROM = 200
#: Keys that are made at once in a task.
KEYS_AT_ONCE = 500_000


def _odd(n: int, m: int, threshold: float) -> int:
    """How many characters of strings of n and m may stay unmatched."""
    return int((1 - threshold) * (n + m) + 1e-9)


def _longest(n: int, threshold: float) -> int:
    """The length of the longest string that can reach the threshold with one of n."""
    return int(n * (2 - threshold) / threshold + 1e-9)


def _parts(n: int, threshold: float) -> list[tuple[int, int]]:
    """Parts of a name, of which one stands in every match with at most one character more or less."""
    k = _odd(n, _longest(n, threshold), threshold) // 2 + 1
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def _tag(n: int, part: int, less: int) -> int:
    return 2 * ((n << 20) + part if n <= PLACED else 0) + less


@lru_cache(maxsize=4096)
def _name_cuts(n: int, threshold: float) -> np.ndarray:
    """(start, end, character left out or end, tag): each part of a name of length n, and the part without one of its characters."""
    cuts = []
    for i, (p, q) in enumerate(_parts(n, threshold)):
        cuts += [(p, q, q, _tag(n, i, 0))] + [(p, q, j, _tag(n, i, 1)) for j in range(p, q)]
    return np.array(sorted(set(cuts)), dtype=np.int64).reshape(-1, 4)


@lru_cache(maxsize=4096)
def _candidate_cuts(m: int, threshold: float) -> np.ndarray:
    """The same of a candidate of length m: all that can equal such a cut of a name that it may match."""
    cuts, sizes = set(), set()

    def like(start: int, end: int, more: int, n: int, part: int) -> None:
        if 0 <= start <= end <= m:
            gaps = range(start, end) if more > 0 else [end]
            cuts.update((start, end, j, _tag(n, part, int(more < 0))) for j in gaps)

    for n in range(int(m * threshold / (2 - threshold)), _longest(m, threshold) + 1):
        odd = _odd(n, m, threshold)
        if abs(m - n) > odd:
            continue
        for i, (p, q) in enumerate(_parts(n, threshold)):
            if n > PLACED:
                sizes.add(q - p)
                continue
            for more in (-1, 0, 1):
                for shift in range(-odd, odd + 1) if p else [0]:
                    after = m - n - shift - more
                    if abs(shift) + abs(after) + abs(more) <= odd and (q < n or not after):
                        like(p + shift, q + shift + more, more, n, i)
    for size in sizes:
        for more in (-1, 0, 1):
            for start in range(m - size - more + 1):
                like(start, start + size + more, more, PLACED + 1, 0)
    return np.array(sorted(cuts), dtype=np.int64).reshape(-1, 4)


def _cut_hashes(strings: list[str], cuts_of: Callable[[int], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(string, key): hashes of the cuts of each string, some strings of one length after another."""
    length = np.array([len(s) for s in strings], dtype=np.int64)
    base, odd, mixer = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    for m in np.unique(length).tolist():
        cuts, members = cuts_of(m), np.flatnonzero(length == m)
        if not len(cuts):
            continue
        start, end, gap = cuts[:, :3].T
        after = np.minimum(gap + 1, end)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m + 1, base, dtype=np.uint64)]))
        tags = cuts[:, 3].astype(np.uint64) * odd
        per = max(1, KEYS_AT_ONCE // len(cuts))
        for lo in range(0, len(members), per):
            some = members[lo : lo + per]
            one = np.frombuffer("".join(strings[i] for i in some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64).reshape(len(some), m)
            one = (one + base) * odd
            one ^= one >> np.uint64(29)
            until = np.zeros((m + 1, len(some)), dtype=np.uint64)  # hash of what stands before each place
            for i in range(m):
                until[i + 1] = until[i] * base + one[:, i]
            key = (until[gap] - until[start] * power[gap - start][:, None]) * power[np.maximum(end - gap - 1, 0)][:, None]
            key += until[end] - until[after] * power[end - after][:, None] + tags[:, None]
            key = (key ^ (key >> np.uint64(31))) * mixer
            key = ((key ^ (key >> np.uint64(29))) * odd >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield np.tile(some, len(cuts)), key.reshape(-1)


def _keys(strings: DataFrame, column: str, cuts: Callable[[int, float], np.ndarray], threshold: float, known: Broadcast | None = None) -> DataFrame:
    """(key) of all cuts of ``column``; or (key, column) of those whose bit is set in ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(column)
            for at, keys in _cut_hashes(held.to_pylist(), lambda m: cuts(m, threshold)):
                if known is None:
                    yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])
                    continue
                bits = known.value
                slot = keys.view(np.uint32) >> np.uint32(32 - (8 * len(bits)).bit_length() + 1)
                some = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                once = np.unique(at[some] << 32 | keys[some].view(np.uint32).astype(np.int64))  # a repetitive string has the same cut in many places
                yield pa.RecordBatch.from_arrays([pa.array(once.astype(np.uint32).view(np.int32)), held.take(pa.array(once >> 32))], names=["key", column])

    return strings.select(column).mapInArrow(run, "key int" if known is None else f"key int, {column} string")


def _near(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b), possibly repeated, of distinct strings ``a`` and ``b``: all pairs that can reach the threshold and few others.

    Of the cuts only those move whose hash is also one of the other side (or has the same bit by chance). A pair is held against
    the bound where it meets, by edit distance, which is at most the number of unmatched characters.
    """
    spark = left.sparkSession
    asked = spark.sparkContext.broadcast(_key_bits(_keys(left, "a", _name_cuts, threshold), 8 * left.count()))
    held = cut_lineage(_keys(right, "b", _candidate_cuts, threshold, asked))
    met = spark.sparkContext.broadcast(_key_bits(held, held.count()))
    pairs = _keys(left, "a", _name_cuts, threshold, met).join(held.hint("merge"), "key")
    odd = F.floor((1 - threshold) * (F.length("a") + F.length("b")) + 1e-9).cast("int")
    pairs = pairs.withColumn("odd", odd).filter("abs(length(a) - length(b)) <= odd")
    return pairs.filter("levenshtein(a, b, odd) >= 0").select("a", "b")


def best_matches(names: DataFrame, candidates: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(name, match, ratio): the candidate with the highest ratio of matching characters of the normalised names, the least
    ``ord`` among equals, then the first by name; the name itself if none reaches the threshold.

    Names and candidates (``name``; ``candidate``, ``ord``) are compared as distinct normalised strings. A name that equals a candidate
    needs no other; the others meet only candidates that hold a part of them with at most one character more or less, which is so
    for every pair that can reach the threshold.
    """
    named = cut_lineage(names.select("name").filter("name IS NOT NULL").distinct().withColumn("a", normalize_entity_name(F.col("name"))))
    right = candidates.groupBy("candidate").agg(F.min("ord").alias("ord")).filter("candidate IS NOT NULL").withColumn("b", normalize_entity_name(F.col("candidate")))
    right = cut_lineage(right.groupBy("b").agg(F.min(F.struct("ord", "candidate")).alias("first")).select("b", "first.*"))
    same = right.filter(F.length("b") < SKIPS_FROM).select(F.col("b").alias("a"), "candidate")
    left = cut_lineage(named.select("a").distinct().join(same, "a", "left_anti"))

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, last = SequenceMatcher(), (None, None)
        for batch in batches:
            rows = []
            for a, b in zip(batch["a"], batch["b"]):
                if (a, b) != last:
                    if b != last[1]:
                        matcher.set_seq2(b)
                    matcher.set_seq1(a)
                    rows.append((a, b, matcher.ratio()))
                last = (a, b)
            yield pd.DataFrame(rows, columns=["a", "b", "ratio"])

    pairs = _near(left, right, threshold).repartition(partitions(left.sparkSession), "b").sortWithinPartitions("b", "a")
    scored = pairs.mapInPandas(ratios, "a string, b string, ratio double").filter(F.col("ratio") >= threshold).join(right, "b")
    best = scored.groupBy("a").agg(F.min_by(F.struct("candidate", "ratio"), F.struct(-F.col("ratio"), "ord", "candidate")).alias("m")).select("a", "m.*")
    best = best.unionByName(same.withColumn("ratio", F.lit(1.0)))
    return named.join(best, "a", "left").select("name", F.coalesce("candidate", "name").alias("match"), "ratio")
