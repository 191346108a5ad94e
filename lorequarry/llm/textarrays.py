"""Texts of an Arrow batch as flat code point arrays: classes, words, hashes, without a loop over characters.

All helpers run inside Spark tasks on one slice of a batch, so their memory is bounded by SLICE_CHARS
or by the longest single text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters handled at once in a task.
SLICE_CHARS = 1_000_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White_Space of the Unicode character database (fixed values).
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Code point -> OTHER, LETTER, NUMBER or SPACE."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(maxsize=1)
def code_point_keys() -> np.ndarray:
    """A fixed random 64-bit number for each code point."""
    return np.random.default_rng(20240101).integers(1, 2**63, size=0x110000, dtype=np.uint64)


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)]))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch into runs of rows of at most ``limit`` characters (one row, if it is longer); null texts become ''."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each text followed by one line feed; and the offset of each text (n + 1 values)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    cps = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cps, np.concatenate([[0], np.cumsum(lengths + 1)])


class Words:
    """Maximal runs of letters and digits of some texts.

    With ``hyphens`` compounds are one word. start, end: offsets into the code points; text: index of the text of each word; hash: 64-bit, equal for equal words.
    """

    def __init__(self, texts: list[str], lower: bool = True, hashed: bool = True, hyphens: bool = False):
        self.texts = [t.lower() for t in texts] if lower else texts
        cps, self.offsets = code_points(self.texts)
        inside = np.zeros(len(cps) + 1, dtype=np.int8)
        kinds = class_table()[cps]
        inside[:-1] = (kinds == LETTER) | (kinds == NUMBER)
        if hyphens:  # a hyphen between letters belongs to the word
            at = np.flatnonzero(cps == 45)
            at = at[(at > 0) & (at < len(cps) - 1)]
            inside[at[(kinds[at - 1] == LETTER) & (kinds[at + 1] == LETTER)]] = 1
        change = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.cps = cps
        if hashed:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.end - self.start
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(lengths.sum()) - np.repeat(begin, lengths)
        top = 1 << int(lengths.max()).bit_length()
        values = code_point_keys()[self.cps[place + np.repeat(self.start, lengths)]] * _powers(top)[place]
        return mix(np.add.reduceat(values, begin))


def ngram_hashes(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n consecutive words within one text, and the index of its first word."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    m = len(hashes) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + m]
    first = np.flatnonzero(text[:m] == text[n - 1 :])
    return mix(out[first]), first
