"""Problem 4: cut oversized texts at natural boundaries with a stated overlap.

Dynamic programming over boundary positions. A cut costs by its kind (end of paragraph, sentence, line, clause, word,
or within a word); kinds are ranked, so that one weaker cut is never traded against any number of stronger ones, and
among equal cuts the sizes of the pieces are balanced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
#: Within a run without any natural boundary, cuts are considered every so many characters.
HARD_STEP = 10
#: What stands before a full stop that ends no sentence: an initial, a word without vowels, or one of these.
ABBREVIATION = re.compile(r"(?:^|[\s(\"'])(?:[^\W\d_]|[A-Z][^\Waeiouy\d_]+|capt|prof|st|no|vol|fr|gen|col|ed|mr|mrs|ms|rev|hon)\.$", re.I)
#: Cost of a cut within the first three kinds; the later kinds outweigh all cuts of the kinds before them.
STRONG = {0: 0.0, 1: 0.4, 2: 0.8}


def natural(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of words inside ``text`` with the kind of each (0 paragraph, 1 sentence, 2 line, 3 clause, 4 word), and starts of words."""
    ends, kinds, starts = [], [], []
    for m in GAP.finditer(text):
        at, gap = m.start(), m.group()
        starts.append(m.end())
        if not at or m.end() == len(text):
            continue
        before = text[at - 1]
        lines = gap.count("\n")
        kind = 2 if lines else 3 if before in ";:,—–" else 4
        if lines > 1:
            kind = 0
        elif not before.isalnum() and (s := SENTENCE.search(text, max(0, at - 4), at)):
            if before != "." or not ABBREVIATION.search(text[max(0, at - 8) : s.start() + 1]):
                kind = 1
        ends.append(at)
        kinds.append(kind)
    return np.array(ends, dtype=np.int64), np.array(kinds, dtype=np.int64), np.array(starts, dtype=np.int64)


def hard_cuts(text: str, ends: np.ndarray) -> np.ndarray:
    """Every ``HARD_STEP``-th position that is no word end and does not part a character from its combining marks."""
    grid = np.setdiff1d(np.arange(HARD_STEP, len(text), HARD_STEP), ends)
    return np.array([p for p in grid.tolist() if not unicodedata.combining(text[p]) and text[p] not in "\u200d\ufe0f"], dtype=np.int64)


def split_text(text: str, limit: int = 1200, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of each piece; one piece if the text is within the limit, none if it is empty."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    word_ends, word_kinds, word_starts = natural(text)
    stride = limit - overlap
    pieces = -(-(n - overlap) // stride)
    target = (n + overlap * (pieces - 1)) / pieces
    heavy = 4.0 * (n // max(1, stride) + 4)
    for weakest in (2, 3, 4, 5):
        ends, kinds = word_ends[word_kinds <= weakest], word_kinds[word_kinds <= weakest]
        if weakest == 5:
            hard = hard_cuts(text, ends)
            order = np.argsort(np.concatenate([ends, hard]))
            ends, kinds = np.concatenate([ends, hard])[order], np.concatenate([kinds, np.full(len(hard), 5)])[order]
        cost = np.select([kinds == k for k in STRONG] + [kinds == 3, kinds == 4], [*STRONG.values(), heavy, heavy**2], heavy**3)
        ends = np.append(ends, n)
        cost = np.append(cost, 0.0)
        # The piece after an end begins at the first word start within the overlap, else exactly the overlap before.
        floor = np.maximum(ends - overlap, 0)
        at = np.searchsorted(word_starts, floor)
        nxt = np.append(word_starts, n + 1)[at]
        begin = np.where((nxt < ends) & (floor > 0), nxt, floor)
        best, came = np.full(len(ends), np.inf), np.full(len(ends), -1)
        low = np.searchsorted(begin, ends - limit)
        for j, (e, lo) in enumerate(zip(ends.tolist(), low.tolist())):
            if e <= limit:
                best[j] = ((e - target) / target) ** 2 + cost[j]
            if lo < j:
                ways = best[lo:j] + ((e - begin[lo:j] - target) / target) ** 2
                k = int(ways.argmin())
                if ways[k] + cost[j] < best[j]:
                    best[j], came[j] = ways[k] + cost[j], lo + k
        if np.isfinite(best[-1]):
            break
    out, j = [], len(ends) - 1
    while j >= 0:
        i = int(came[j])
        out.append((int(begin[i]) if i >= 0 else 0, int(ends[j])))
        j = i
    return out[::-1]


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", section_col: str | None = "section", limit: int = 1200, overlap: int = 200, keep_small: bool = False) -> DataFrame:
    """Pieces of the texts above ``limit``: id, ``piece_index``, ``start_char``, ``end_char``, ``section``, ``piece``.

    ``piece`` is exactly ``text[start_char:end_char]`` (code points). Every piece is within the limit, the first begins
    at 0, the last ends with the text, and each later one begins ``overlap`` characters before the end of the one before it,
    or at the first word start after that. A row delivered again with the same id, text and section is cut once; different texts under
    one id are cut each. Null and empty texts give no piece; texts within the limit give one piece if ``keep_small``,
    else none. Rows are cut independently: the only shuffle is of the oversized rows, for repeated deliveries.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    section = F.col(section_col) if section_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), section.alias("section")).filter(F.length("text") > (0 if keep_small else limit)).dropDuplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                out = [
                    (key, i, s, e, section, text[s:e])
                    for key, text, section in batch.iloc[lo : lo + 500][["id", "text", "section"]].itertuples(index=False)
                    for i, (s, e) in enumerate(split_text(text, limit, overlap))
                ]
                yield pd.DataFrame(out, columns=["id", "piece_index", "start_char", "end_char", "section", "piece"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, piece_index int, start_char int, end_char int, section string, piece string").withColumnRenamed("id", id_col)
