"""Problem 6: encode every text of a corpus with a public byte-level BPE vocabulary.

Pre-tokenisation runs on whole slices of a batch: each code point becomes a symbol (its class, with the little
lookahead that contractions and runs of white space need), a symbol is a transition function on the states of the
scanner, and functions of neighbouring symbols are composed. Composition is associative and any SPAN symbols in a row
compose to a constant, so the state before every character is one table lookup and the scan needs no loop and no regex.
The slices between boundaries are dictionary-encoded by Arrow; only pieces not seen before by the worker are merged.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.textarrays import LETTER, NUMBER, SLICE_CHARS, SPACE, class_table, code_points, slices

#: Folder of the public vocabulary files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Pieces whose ids a worker keeps; the store is emptied when it is full.
CACHE_PIECES = 500_000

# Symbols: a separator between texts, letter, number, other, inner white space, last white space of a run before
# a non-space (a space, or another one), apostrophe that begins a contraction of one or of two letters if a token begins there.
SEP, L, N, O, W, S_LAST, W_LAST, A1, A2 = range(9)
# States: nothing open, within letters, numbers, others, white space, after a space that joins the next token,
# one or two letters of a contraction still to come.
NEW, IN_L, IN_N, IN_O, IN_W, JOIN, C1, C2 = range(8)
SPAN = 4


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token begins at the symbol."""
    if symbol == SEP:
        return NEW, True
    if symbol == W:
        return IN_W, state != IN_W
    if symbol in (S_LAST, W_LAST):
        return (JOIN if symbol == S_LAST else NEW), True
    if symbol == L:
        if state in (C1, C2):
            return (NEW if state == C1 else C1), False
        return IN_L, state not in (IN_L, JOIN)
    if symbol == N:
        return IN_N, state not in (IN_N, JOIN)
    if symbol in (A1, A2) and state not in (IN_O, JOIN):
        return (C1 if symbol == A1 else C2), True
    return IN_O, state not in (IN_O, JOIN)


@lru_cache(maxsize=1)
def _begins() -> np.ndarray:
    """For each SPAN + 1 symbols in a row: whether a token begins at the last one."""
    maps = {s: tuple(_step(state, s)[0] for state in range(8)) for s in range(9)}
    table = np.zeros(9 ** (SPAN + 1), dtype=bool)
    for code, symbols in enumerate(itertools.product(range(9), repeat=SPAN + 1)):
        before = reduce(lambda f, g: tuple(g[x] for x in f), (maps[s] for s in symbols[:-1]), tuple(range(8)))
        starts = {_step(state, symbols[-1])[1] for state in before}
        # Runs that cannot occur in a text (a contraction sign is always followed by its letters) may stay open.
        table[code] = True in starts if len(starts) == 1 else _step(before[NEW], symbols[-1])[1]
    return table


def token_starts(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the code points at which a pre-token or a separator begins."""
    n = len(cps)
    kinds = class_table()[cps]
    kinds[offsets[1:] - 1] = 255
    symbol = np.array([O, L, N, W], dtype=np.int32)[np.minimum(kinds, 3)]
    symbol[kinds == 255] = SEP
    after = np.append(kinds[1:], 255)
    last = (kinds == SPACE) & (after != SPACE) & (after != 255)
    symbol[last] = np.where(cps[last] == 32, S_LAST, W_LAST)
    quote = np.flatnonzero(cps == 39)
    quote = quote[quote + 2 < n]
    one, two = cps[quote + 1], cps[np.minimum(quote + 2, n - 1)]
    symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = A1
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    symbol[quote[pair]] = A2
    code = np.zeros(n, dtype=np.int32)
    padded = np.concatenate([np.full(SPAN, SEP, dtype=np.int32), symbol])
    for k in range(SPAN + 1):
        code = code * 9 + padded[k : k + n]
    return np.flatnonzero(_begins()[code])


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a file of base64 tokens and ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pair merging, lowest rank first and leftmost among equals; O(n log n) for long pieces."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins at i
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes slices of texts; keeps the ids of pieces between slices."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}

    def _ids(self, piece: bytes) -> list[int]:
        if (ids := self.cache.get(piece)) is None:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            ids = self.cache[piece] = merge_piece(piece, self.ranks)
        return ids

    def encode(self, texts: list[str], offsets_too: bool = False) -> tuple[pa.Array, pa.Array | None]:
        """Ids of each text; with ``offsets_too`` also the byte offset of each id's bytes in its text."""
        texts = [t.encode("utf-8", "replace").decode("utf-8") if not t.isascii() else t for t in texts]
        cps, offsets = code_points(texts)
        starts = token_starts(cps, offsets)
        width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width)])
        data = "\n".join([*texts, ""]).encode("utf-8")
        byte_starts = np.append(at[starts], at[-1]).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(byte_starts.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        index = pieces.indices.to_numpy().astype(np.int64)
        distinct = [self._ids(p) for p in pieces.dictionary.to_pylist()]
        # A separator is an own piece without ids: it is told from a line feed of a text by its place.
        distinct.append([])
        separator = np.searchsorted(starts, offsets[1:] - 1)
        index[separator] = len(distinct) - 1
        n_of = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
        first_of = np.concatenate([[0], np.cumsum(n_of)[:-1]])
        flat = np.fromiter(itertools.chain.from_iterable(distinct), dtype=np.int32, count=int(n_of.sum()))
        n = n_of[index]
        ends = np.cumsum(n)
        begins = ends - n
        take = np.repeat(first_of[index] - begins, n) + np.arange(ends[-1] if len(ends) else 0)
        list_offsets = np.concatenate([[0], ends[separator]]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(list_offsets), pa.array(flat[take]))
        if not offsets_too:
            return ids, None
        length_of = {i: len(t) for t, i in self.ranks.items()}
        sizes = np.fromiter((length_of[i] for i in flat.tolist()), dtype=np.int64, count=len(flat))[take]
        run = np.cumsum(sizes) - sizes
        base = np.concatenate([run, [sizes.sum()]])[list_offsets[:-1]]
        places = run - np.repeat(base, np.diff(list_offsets))
        return ids, pa.ListArray.from_arrays(pa.array(list_offsets), pa.array(places.astype(np.int32)))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", with_offsets: bool = False) -> DataFrame:
    """One row for each row of ``df``: ``id_col`` and ``ids`` (array<int>), with ``starts`` if ``with_offsets``.

    Special tokens have no meaning here: text that looks like one is ordinary text. Null and empty texts give an empty
    list; repeated rows are encoded each; other columns are dropped, so none can clash. Lone surrogates become '?'.
    The map has no shuffle. The vocabulary file (1 MB, fixed) is read on the driver and broadcast.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_CHARS):
                ids, starts = encoder.encode(texts, with_offsets)
                columns = [part.column("id"), ids] + ([starts] if with_offsets else [])
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "starts"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + (", starts array<int>" if with_offsets else "")
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The text of each row's ids: the inverse of ``encode_corpus`` (null and empty lists give '')."""
    tokens = df.sparkSession.sparkContext.broadcast({i: t for t, i in load_ranks(vocabulary).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(tokens.value[i] for i in ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
