"""Embeddings and nearest neighbours by cosine."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorequarry.session import partitions

WORD = re.compile(r"[^\W_]+")
#: Vectors of a block of the corpus, and of the stated queries.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024


class Embedder(Protocol):
    """What turns texts into vectors of length 1. Models plug in here; they are built once in each worker.

    A model with a ``query_instruction`` has it put before every query, not before passages."""

    dimensions: int

    def embed(self, texts: list[str], is_query: bool) -> np.ndarray: ...


class HashingEmbedder:
    """Counts of hashed word tokens, scaled to length 1: an offline stand-in that knows no meaning."""

    KNOWN_WORDS = 500_000

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.bucket = dimensions, {}

    def _bucket(self, word: str) -> int:
        if len(self.bucket) >= self.KNOWN_WORDS:
            self.bucket.clear()
        return self.bucket.setdefault(word, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimensions)

    def embed(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        known, out = self.bucket, np.zeros((len(texts), self.dimensions))
        for i, text in enumerate(texts):
            words = WORD.findall((text or "").lower())
            out[i] = np.bincount([known[w] if w in known else self._bucket(w) for w in words] or [0], minlength=self.dimensions) if words else 0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


#: The instruction that retrieval models of the usual kind expect before a query (fixed value).
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "


def embed_query(text: str, embedder: Embedder | None = None) -> list[float]:
    """The vector of one query; a blank one is refused."""
    if not text.strip():
        raise ValueError("the query is blank")
    embedder = embedder or HashingEmbedder()
    return embedder.embed([getattr(embedder, "query_instruction", "") + text], True)[0].tolist()


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Embedder | None = None, is_query: bool = False, batch: int = 64) -> DataFrame:
    """(id, embedding array<float>) of every row with text that is not blank."""
    embedder = embedder or HashingEmbedder()
    kind = df.schema[id_col].dataType.simpleString()
    before = getattr(embedder, "query_instruction", "") if is_query else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lo in range(0, len(rows), batch):
                part = rows.iloc[lo : lo + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(embedder.embed([before + t for t in part["text"]], is_query).astype(np.float32))})

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.trim("text") != "")
    return source.mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def _blocks(df: DataFrame, id_col: str, vector_col: str, rows: int, out: str) -> DataFrame:
    """Vectors packed into rows of (block, ids, matrix): the unit in which two sets meet."""
    kind = df.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            keep = [i for i, v in enumerate(vectors.to_pylist()) if v]
            batch, lists = batch.take(pa.array(keep, pa.int64())), [vectors[i].as_py() for i in keep]
            for lo in range(0, batch.num_rows, rows):
                matrix = np.asarray(lists[lo : lo + rows], dtype=np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, len(matrix)], pa.int32()), batch.column("id").slice(lo, rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32())], names=["ids", "matrix", "width"])

    packed = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(pack, f"ids array<{kind}>, matrix binary, width int")
    return packed.select(F.xxhash64("matrix").alias(f"{out}_block"), *[F.col(c).alias(f"{out}_{c}") for c in packed.columns])


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10, query_id: str = "query_id", id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> DataFrame:
    """(query_id, rank, id, score, distance): the k rows of ``corpus`` nearest to each row of ``queries`` by cosine, ties by id. Exact.

    Both sets are packed into blocks; every block of queries meets every block of the corpus once, in ``cells`` groups (the
    session's shuffle partitions) that are joined by number, and only k rows of each meeting go on. Vectors of length 0 and null vectors are left out.
    """
    cells = cells or partitions(corpus.sparkSession)
    q = _blocks(queries, query_id, vector_col, BLOCK_QUERIES, "q").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    c = _blocks(corpus, id_col, vector_col, BLOCK_ROWS, "c").withColumn("cell", F.pmod("c_block", F.lit(cells)).cast("int"))
    q_kind, c_kind = queries.schema[query_id].dataType.simpleString(), corpus.schema[id_col].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["q_matrix"]).reshape(-1, row["q_width"])
                y = np.frombuffer(row["c_matrix"]).reshape(-1, row["c_width"])
                dot = x @ y.T
                size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
                score = np.where(size > 0, dot / np.where(size > 0, size, 1), -np.inf)
                ids = np.array(row["c_ids"], dtype=object)
                order = np.argsort(ids, kind="stable")
                score, ids = score[:, order], ids[order]
                # Rounded so that a tie is a tie, whichever block the rows are in.
                score = np.round(score, 12)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(score, top, axis=1)
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_pydict({query_id: pa.array([a for a, n in zip(row["q_ids"], keep.sum(axis=1)) for _ in range(n)]), id_col: pa.array(ids[top[keep]].tolist()), "score": pa.array(best[keep])}, schema=out)

    out = pa.schema([(query_id, _arrow(q_kind)), (id_col, _arrow(c_kind)), ("score", pa.float64())])
    met = q.join(c, "cell").select("q_ids", "q_matrix", "q_width", "c_ids", "c_matrix", "c_width").mapInArrow(meet, f"{query_id} {q_kind}, {id_col} {c_kind}, score double")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select(query_id, "rank", id_col, "score", (1 - F.col("score")).alias("distance"))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


#: Vectors of the bounded sample on which the centres of an index are fitted.
SAMPLE_VECTORS = 50_000
#: Centres at most (broadcast), and the share of them that a query probes.
MOST_CENTRES, PROBED = 4096, 0.7


def build_index(corpus: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centres: int | None = None, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(rows with their list, centres): every row in the list of its nearest centre; centres fitted on at most SAMPLE_VECTORS rows.

    Without ``centres`` there are as many as the square root of the rows, at most MOST_CENTRES, so lists grow no faster than their number.
    """
    if centres is None:
        centres = min(max(int(corpus.count() ** 0.5), 1), MOST_CENTRES)
    sample = corpus.select(id_col, vector_col).filter(F.size(vector_col) > 0).orderBy(F.xxhash64(id_col)).limit(SAMPLE_VECTORS).toPandas()
    x = np.asarray(sample[vector_col].tolist(), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    random = np.random.default_rng(seed)
    c = x[random.choice(len(x), min(centres, len(x)), replace=False)]
    for _ in range(12):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return _assign(corpus, id_col, vector_col, c, 1), c


def _assign(df: DataFrame, id_col: str, vector_col: str, centres: np.ndarray, lists: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(centres)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.asarray(batch["v"].tolist(), dtype=np.float64).reshape(len(batch), -1)
            near = np.argsort(-(v @ shared.value.T), axis=1)[:, :lists] if len(batch) else np.zeros((0, lists), dtype=int)
            yield pd.DataFrame({"id": batch["id"].repeat(near.shape[1]), "v": batch["v"].repeat(near.shape[1]), "list": near.ravel().astype(np.int32)})

    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.size("v") > 0).mapInPandas(run, f"id {kind}, v array<float>, list int")
    return rows.withColumnsRenamed({"id": id_col, "v": vector_col})


def search_index(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, probes: int | None = None, query_id: str = "query_id", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the nearest rows among the lists of the ``probes`` centres nearest to a query (PROBED of all, if not given).

    The recall of the default is what the query ``index_recall`` reports. Lists are cut by hash of the id, so a list that holds
    a large part of all rows is searched by many tasks.
    """
    probes = probes or max(1, round(PROBED * len(centres)))
    q = _assign(queries, query_id, vector_col, centres, probes).withColumnRenamed(vector_col, "qv")
    dot = F.aggregate(F.zip_with("qv", vector_col, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    parts = partitions(queries.sparkSession)
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    index = index.withColumn("part", F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int"))
    hits = q.join(index, ["list", "part"]).select(query_id, id_col, dot.alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select(query_id, "rank", id_col, "score")
