"""Problem 7: evaluation passages that leaked into corpus documents, whole, in part, or slightly changed.

The hashed word n-grams of the passages (a fixed, size-checked set) are broadcast. Tasks scan the word windows of every
document against them on arrays; windows with enough hits of one item are aligned with its passage word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.textarrays import SLICE_CHARS, Words, ngram_hashes, slices
from lorequarry.session import cut_lineage

#: Passage words that are broadcast at once (about 16 MB of n-grams); a larger set is scanned for in blocks of this size.
BLOCK_WORDS = 500_000
#: Words of an n-gram, and hits of one item close together that call for an alignment: eighteen words have 16 trigrams,
#: an edit or a word written as two breaks three of them, so 7 are left after three breaks; edits shift the diagonal by at most half a band.
GRAM, MIN_HITS, BAND = 3, 7, 16
FILTER_BITS = 22
JOINED = re.compile(r"[-­‐‑¬](?<=\w.)(?:[^\S\n]*\n\s*(?=\w)|(?<!¬)(?=\w))")
WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,60}>|&[a-z]{2,6};|[​-‍⁠﻿]")


def normalise(text: str) -> str:
    """Lower case, without hyphens inside words (also at line ends), markup and compatibility forms."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text or "&" in text or "​" in text or "﻿" in text:
        text = MARKUP.sub(lambda m: "" if m.group()[0] not in "<&" else " ", text)
    if "-" in text or not text.isascii():
        text = JOINED.sub("", text)
    return text


class Passages:
    """The n-grams of a block of passages, sorted by hash, with item and place of each."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words([normalise(t) for t in texts])
        self.ids = np.array(ids)
        bounds = np.searchsorted(words.text, np.arange(len(texts) + 1))
        self.words = [words.hash[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        strings = ["".join(map(chr, words.cps[s:e].tolist())) for s, e in zip(words.start, words.end)]
        self.strings = [strings[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        grams, first = ngram_hashes(words.hash, words.text, GRAM)
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], words.text[first][order], (first - bounds[words.text[first]])[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.grams >> np.uint64(64 - FILTER_BITS)] = True


def aligned(passage: list[str], words: list[str], least: int = 18, one_in: int = 8) -> bool:
    """Whether at least ``least`` consecutive passage words stand in ``words`` in order, the first and the last of them unchanged,
    with at most one word in ``one_in`` changed, left out or added."""
    return next(alignments(passage, words, least, one_in), None) is not None


def alignments(passage: list[str], words: list[str], least: int = 18, one_in: int = 8) -> Iterator[tuple[int, int]]:
    """(start, end): the places in ``words`` that hold passage words as ``aligned`` says; for each end the longest with each number of edits.

    start[e][j]: the first passage word, and the first of ``words``, of the longest alignment with e edits that ends at the current
    passage word and at words[:j], as one number. A word written as two, or two as one, is no edit. A long alignment can be cut into
    blocks of b to 2 b - 1 words, of which one has no more edits for its length than the whole and keeps ``least`` words without the
    edits at its ends, so no more edits need be tried.
    """
    n, far = len(words), 1 << 60
    if len(passage) < least or not n:
        return
    block = -(-least * one_in // (one_in - 2)) if one_in > 2 else len(passage)
    most = min(len(passage), 2 * block - 1) // one_in
    code: dict[str, int] = {}
    w = np.array([code.setdefault(x, len(code)) for x in words])
    two = np.array([-2, *(code.setdefault(a + b, len(code)) for a, b in zip(words, words[1:]))])
    p = [code.get(x, -1) for x in passage]
    p_two = [-1, *(code.get(a + b, -1) for a, b in zip(passage, passage[1:]))]
    empty = np.full((most + 1, n + 1), far)
    need = np.maximum(least, one_in * np.arange(most + 1))[:, None]
    before, last = empty, empty
    for i, x in enumerate(p, 1):
        kept = np.full((most + 1, n + 1), far)  # the current passage word stands there unchanged
        same = np.flatnonzero(w == x)
        kept[:, same + 1] = last[:, same]
        kept[0, same + 1] = np.minimum(kept[0, same + 1], (i - 1) * (n + 1) + same)
        split = np.flatnonzero(two == x)
        if len(split):
            kept[:, split + 1] = np.minimum(kept[:, split + 1], last[:, split - 1])
            kept[0, split + 1] = np.minimum(kept[0, split + 1], (i - 1) * (n + 1) + split - 1)
        if i > 1 and p_two[i - 1] >= 0:
            join = np.flatnonzero(w == p_two[i - 1])
            kept[:, join + 1] = np.minimum(kept[:, join + 1], before[:, join])
            kept[0, join + 1] = np.minimum(kept[0, join + 1], (i - 2) * (n + 1) + join)
        if i >= least and (enough := i - kept // (n + 1) >= need).any():
            for e, j in zip(*np.nonzero(enough)):
                yield int(kept[e, j] % (n + 1)), int(j)
        now = kept.copy()
        now[1:, 1:] = np.minimum(now[1:, 1:], last[:-1, :-1])
        now[1:] = np.minimum(now[1:], last[:-1])
        for e in range(1, most + 1):
            now[e, 1:] = np.minimum(now[e, 1:], now[e - 1, :-1])
        before, last = last, now


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places without overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(texts: list[str], known: Passages, least: int, one_in: int, places: bool = False) -> list[tuple[int, int, int, int]]:
    """(text, item, start, end): leaked items of each text, once each, and the code points of the normalised text around them;
    with ``places`` exactly those of every place that holds words of the item."""
    words = Words([normalise(t) for t in texts])
    grams, first = ngram_hashes(words.hash, words.text, GRAM)
    maybe = np.flatnonzero(known.filter[grams >> np.uint64(64 - FILTER_BITS)])
    left, right = np.searchsorted(known.grams, grams[maybe]), np.searchsorted(known.grams, grams[maybe], side="right")
    maybe, left, right = maybe[right > left], left[right > left], right[right > left]
    # Only hits of any items that stand close enough together are told apart by item.
    k = MIN_HITS - 1
    if len(maybe) <= k:
        return []
    at = first[maybe]
    dense = np.flatnonzero(at[k:] - at[:-k] <= least + 4)
    cover = np.zeros(len(maybe) + 1, dtype=np.int32)
    np.add.at(cover, dense, 1)
    np.add.at(cover, dense + MIN_HITS, -1)
    dense = np.cumsum(cover[:-1]) > 0
    maybe, left, n = maybe[dense], left[dense], (right - left)[dense]
    if not len(maybe):
        return []
    index = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
    place, item = np.repeat(first[maybe], n), known.item[index]
    text, shift = words.text[place], place - known.place[index] + len(known.item)
    # Hits of one alignment lie on neighbouring diagonals; bands overlap, so that none is parted by a border.
    hot = []
    for border in (0, BAND // 2):
        band = (shift + border) // BAND
        order = np.lexsort((place, band, item, text))
        key = np.stack([text[order], item[order], band[order]])
        if len(order) > k:
            close = (place[order][k:] - place[order][:-k] <= least + 4) & (key[:, k:] == key[:, :-k]).all(axis=0)
            hot += [np.stack([text[order][:-k][close], item[order][:-k][close], place[order][:-k][close]])]
    hot = np.unique(np.concatenate(hot, axis=1), axis=1) if hot else np.zeros((3, 0), dtype=np.int64)
    text, item, place = hot
    if not len(place):
        return []
    out = []
    # Neighbouring windows of one item and text are aligned together.
    run = np.flatnonzero(np.concatenate([[True], (np.diff(place) > 2 * least) | (np.diff(item) != 0) | (np.diff(text) != 0)]))
    done: set[tuple[int, int]] = set()
    bounds = np.searchsorted(words.text, np.arange(len(texts) + 1))
    for a, b in zip(run, [*run[1:], len(place)]):
        t, q = int(text[a]), int(item[a])
        if (t, q) in done and not places:
            continue
        lo = max(int(bounds[t]), int(place[a]) - 2 * least)
        hi = min(int(bounds[t + 1]), int(place[b - 1]) + 4 * least)
        strings = ["".join(map(chr, words.cps[s:e].tolist())) for s, e in zip(words.start[lo:hi].tolist(), words.end[lo:hi].tolist())]
        base = int(words.offsets[t])
        if places:
            for i, j in merged(alignments(known.strings[q], strings, least, one_in)):
                out.append((t, q, int(words.start[lo + i]) - base, int(words.end[lo + j - 1]) - base))
        elif aligned(known.strings[q], strings, least, one_in):
            done.add((t, q))
            out.append((t, q, int(words.start[lo]) - base, int(words.end[hi - 1]) - base))
    return out


def passage_blocks(items: DataFrame, item_col: str, passage_col: str) -> list[Broadcast]:
    """The distinct passages in blocks of about ``BLOCK_WORDS`` words, each broadcast."""
    out = []
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(item_col), F.col(passage_col)).filter(F.col(passage_col).isNotNull() & F.col(item_col).isNotNull()).distinct().toLocalIterator()
    for row in chain(rows, [None]):
        if row is not None:
            block.append((row[0], row[1]))
            size += row[1].count(" ") + 1
        if block and (row is None or size >= BLOCK_WORDS):
            out.append(items.sparkSession.sparkContext.broadcast(Passages([i for i, _ in block], [p for _, p in block])))
            block, size = [], 0
    return out


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", least: int = 18, one_in: int = 8) -> DataFrame:
    """Distinct (document id, item id): the document contains at least ``least`` consecutive words of the item's passage.

    Case, punctuation, spacing, line breaks, hyphens and markup are disregarded, and one word in ``one_in`` may be changed,
    left out or added. Null and empty texts and passages shorter than ``least`` words give no row; repeated rows and repeated
    passages give each pair once. The documents are scanned in one map without shuffle per block of passages; only found pairs are shuffled.
    Passages are read to the driver in blocks of ``BLOCK_WORDS`` words, the only data that is broadcast.
    """
    spark = docs.sparkSession
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {id_kind}, item {item_kind}"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND text <> ''")

    def mapper(known):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passages = known.value
            for batch in batches:
                for part, texts in slices(batch, "text", SLICE_CHARS):
                    found = scan(texts, passages, least, one_in)
                    keys = part.column("id").take(pa.array([t for t, *_ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([passages.ids[q].item() for _, q, *_ in found], item_type)], names=["id", "item"])

        return run

    item_type = pa.int32() if item_kind == "int" else pa.string() if item_kind == "string" else pa.int64()
    found = None
    for known in passage_blocks(items, item_col, passage_col):
        part = source.mapInArrow(mapper(known), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.distinct().withColumnsRenamed({"id": id_col, "item": item_col})


SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+[\"'”’)]*\s*|\n\s*|$)")


def compatible(text: str) -> Iterator[tuple[str, int, int]]:
    """(form, start, end): the compatibility form of a text in parts, each with its place in the text."""
    for m in re.finditer(r"[ \t-\r]+|[^ \t-\r]+", text):
        part, at = m.group(), m.start()
        if part.isascii():
            yield from ((c, at + i, at + i + 1) for i, c in enumerate(part))
            continue
        groups: list[tuple[str, str]] = []
        for c in part:
            form = unicodedata.normalize("NFKC", c)
            if groups and (unicodedata.combining(c) or unicodedata.normalize("NFKC", groups[-1][0] + c) != groups[-1][1] + form):
                c = groups.pop()[0] + c
                form = unicodedata.normalize("NFKC", c)
            groups.append((c, form))
        if "".join(form for _, form in groups) != unicodedata.normalize("NFKC", part):
            groups = [(part, unicodedata.normalize("NFKC", part))]
        for c, form in groups:
            yield form, at, at + len(c)
            at += len(c)


def origins(text: str) -> tuple[list[int], list[int]]:
    """Where each code point of the normalised text in lower case starts and ends in ``text``."""
    if text.isascii():
        form, starts, ends = text, list(range(len(text))), list(range(1, len(text) + 1))
    else:
        parts = list(compatible(text))
        form = "".join(f for f, *_ in parts)
        starts, ends = [a for f, a, _ in parts for _ in f], [b for f, _, b in parts for _ in f]
    for pattern in (MARKUP, JOINED):
        pieces, at, left, right = [], 0, [], []
        for m in pattern.finditer(form):
            pieces.append(form[at : m.start()])
            left += starts[at : m.start()]
            right += ends[at : m.start()]
            if pattern is MARKUP and m.group()[0] in "<&":
                pieces.append(" ")
                left.append(starts[m.start()])
                right.append(ends[m.end() - 1])
            at = m.end()
        if at:
            form, starts, ends = "".join([*pieces, form[at:]]), left + starts[at:], right + ends[at:]
    if len(form.lower()) != len(form):
        wide = [len(c.lower()) for c in form]
        starts, ends = [a for a, n in zip(starts, wide) for _ in range(n)], [b for b, n in zip(ends, wide) for _ in range(n)]
    return starts, ends


def cut_spans(text: str, spans: list[tuple[int, int]], share: float = 0.5) -> str:
    """``text`` without the given places, and without the rest of sentences of which at least ``share`` of the words stand there."""
    kept: list[str] = []

    def keep(piece: str) -> None:
        if kept and kept[-1][-1:].isalnum() and piece[:1].isalnum():
            kept.append(" ")
        if piece:
            kept.append(piece)

    spans, k, done = merged(spans), 0, 0
    for m in SENTENCE.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k == len(spans) or spans[k][0] >= m.end():
            continue
        keep(text[done : m.start()])
        done = m.end()
        inside = [s for s in spans[k:] if s[0] < m.end()] if k + 1 < len(spans) and spans[k + 1][0] < m.end() else spans[k : k + 1]
        words = [w.span() for w in WORD.finditer(m.group())]
        leaked = sum(any(a < e + m.start() and s + m.start() < b for a, b in inside) for s, e in words)
        if words and leaked >= share * len(words):
            continue
        at = m.start()
        for a, b in inside:
            keep(text[at : max(a, at)])
            at = max(at, b)
        keep(text[at : m.end()].lstrip(" ") if at < m.end() else "")
    keep(text[done:])
    return "".join(kept).strip()


def cleaned(texts: list[str], known: Passages, least: int = 18, one_in: int = 8) -> dict[int, str]:
    """The texts that hold words of a passage, without them. They are scanned again until nothing is found, as pieces that
    were parted by what is cut may belong together."""
    out: dict[int, str] = {}
    todo = list(range(len(texts)))
    while todo:
        now = [out.get(i, texts[i]) for i in todo]
        spans: dict[int, list[tuple[int, int]]] = {}
        for t, _, a, b in scan(now, known, least, one_in, places=True):
            spans.setdefault(t, []).append((a, b))
        for t, found in spans.items():
            starts, ends = origins(now[t])
            out[todo[t]] = cut_spans(now[t], [(starts[a], ends[b - 1]) for a, b in found])
        todo = [todo[t] for t in sorted(spans)]
    return out


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", whole: bool = False) -> DataFrame:
    """(id, text, leaked) of every document: what leaked taken out, or with ``whole`` only documents without any leak.

    A cleaned text holds no leak. Sentences of which at least half leaked go as a whole; of others only the leaked words.
    Documents without a leak keep their text as it stands, null and empty ones too; repeated rows stay. One map without shuffle for
    each block of passages; with several blocks, documents that were cut pass all of them again until none is cut.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if whole:
        found = leaked_items(docs, items, id_col, text_col, item_col, passage_col)
        return rows.join(found.select(F.col(id_col).alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.lit(False).alias("leaked"))
    kind = docs.schema[id_col].dataType.simpleString()

    def mapper(known):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, "text", SLICE_CHARS):
                    cut = cleaned(texts, known.value)
                    if cut:
                        text = pa.array([cut.get(i, x) for i, x in enumerate(part.column("text").to_pylist())], pa.string())
                        flags = [pa.array([i in cut or old for i, old in enumerate(part.column(c).to_pylist())], pa.bool_()) for c in ("leaked", "cut")]
                        part = pa.RecordBatch.from_arrays([part.column("id"), text, *flags], names=["id", "text", "leaked", "cut"])
                    yield part

        return run

    blocks = passage_blocks(items, item_col, passage_col)

    def passed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("cut", F.lit(False))
        for known in blocks:
            rows = rows.mapInArrow(mapper(known), f"id {kind}, text string, leaked boolean, cut boolean")
        return rows

    rows = passed(rows.withColumn("leaked", F.lit(False)))
    if len(blocks) > 1:
        rows = cut_lineage(rows)
        out, again = rows.filter("NOT cut"), rows.filter("cut")
        while not again.isEmpty():
            again = cut_lineage(passed(again.drop("cut")))
            out, again = out.unionByName(again.filter("NOT cut")), again.filter("cut")
        rows = out
    return rows.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "leaked")
