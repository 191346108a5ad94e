"""Problem 2: find and repair the damage that scanning leaves in page texts.

1. Lines are told apart: page numbers by form and place, running titles by recurring on pages of their document.
2. A frequency lexicon and word pairs are counted over the running text of the whole corpus.
3. Words cut at line ends are joined unless the corpus knows them as hyphenated compounds.
4. A symmetric-delete index over the lexicon gives correction candidates for odd words; a weighted edit distance knows which
   characters are taken for which others, and frequency and neighbouring words decide between candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.session import cut_lineage, partitions

#: What was printed -> what it is taken for (fixed values of character recognition).
CONFUSIONS = {
    "m": ["rn", "nn"], "d": ["cl"], "h": ["li", "l1", "b"], "w": ["vv"], "u": ["ii", "ll", "n"], "n": ["ri", "ii", "u"], "e": ["c"], "c": ["e", "("], "o": ["0", "c"], "l": ["1", "|", "i", "!"],
    "i": ["1", "|", "!", "l", "j"], "g": ["9", "q"], "a": ["@", "4"], "s": ["ſ", "5", "$"], "b": ["6", "8"], "f": ["ſ"], "z": ["2"], "t": ["7", "+", "f"], "q": ["9"], "rn": ["m"], "cl": ["d"], "li": ["h"], "vv": ["w"], "fi": ["ﬁ"], "fl": ["ﬂ"],
}
CONFUSED_COST, EDIT_COST, MOST_COST = 0.4, 1.5, 1.3
#: A confusion makes a word longer or shorter by one letter at most, and MOST_COST allows three.
MOST_LONGER = 3
#: What a letter is drawn with: letters that are taken for each other, or for each other's parts, have the same strokes.
STROKES = {c: stroke for stroke, letters in {"i": "il1|!jr", "ii": "nuhb68", "iii": "m", "ci": "d", "vv": "w", "c": "ec(o0", "g": "g9q", "a": "a@4", "s": "sſ5$ft7+", "z": "z2", "si": "ﬁﬂ"}.items() for c in letters}
#: Strokes that are deleted from a skeleton to make its keys; longer words are only looked up by their skeleton.
DELETES, LONG_WORD = 1, 40
#: A word of letters is a misreading of one this many times as frequent; below SURE_TIMES its neighbours must agree too.
TIMES, SURE_TIMES = 12, 60
#: log2 of the bits of a membership filter: 16 for each row that is marked, at most 128 MB; and of the bits of one of its blocks.
FILTER_BITS, BLOCK_BITS = (16, 30), 20
ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
NUMBER = rf"(?:[\dlIO|]*\d[\dlIO|]*|{ROMAN}|l{{1,2}})"
#: A page or leaf number with its ornaments; a bare one only counts in first or last place.
DRESSED = re.compile(rf"^(?:[Pp]age\s+{NUMBER}|[Pp]\.\s*{NUMBER}|[-—–]\s*{NUMBER}\s*[-—–]|\[\s*{NUMBER}\s*\]|[Ff]ol\.\s*{NUMBER}[rv]?|{NUMBER}\s*\|)$")
BARE = re.compile(rf"^{NUMBER}$")
LEAD = re.compile(rf"^((?:[Pp]age\s+{NUMBER}|[Pp]\.\s*{NUMBER}|[-—–]\s*{NUMBER}\s*[-—–]|\[\s*{NUMBER}\s*\]|[Ff]ol\.\s*{NUMBER}[rv]?|{NUMBER}\s*\||{NUMBER}))\s*(?:\|\s*)?(?=\S)")
TRAIL = re.compile(rf"(?:\s+\|)?\s+((?:[Pp]age\s+{NUMBER}|[Pp]\.\s*{NUMBER}|[-—–]\s*{NUMBER}\s*[-—–]|\[\s*{NUMBER}\s*\]|[Ff]ol\.\s*{NUMBER}[rv]?|{NUMBER}\s*\||{NUMBER}))$")
#: Characters of a line that is nothing but a page number with ornaments.
LONGEST_NUMBER = 20
#: Where a number beside a title can begin, and the last word of a line that ends with one.
NUMBER_START = frozenset("[-—–pPfFlIO|0123456789ivxc")
NUMBER_END = re.compile(r"[\[\-—–|]*(?:[\dlIO|]+[rv]?|[ivxlc]+)?[\]\-—–|]*")
LABEL = re.compile(r"^[^\W\d_][\w-]*\s+\w+-\w+$")
HYPHEN = "-¬­‐="
WORD = re.compile(r"[^\W_](?:[\w@!|$('’+-]*[\w@$|])?|[@|$][\w@!|$-]*\w|(?<!\S)![^\W_][\w@!|$-]*")
WORD_OR_CUT = re.compile(f"\0|{WORD.pattern}")
FOLD = str.maketrans("5|180@$36!492ſ", "siiboasebiagzs")


def title_key(line: str, alone: bool = False) -> str:
    """What misread and re-set forms of one running title have in common; '' for what cannot be one. A single word can only be one where it stands ``alone``."""
    if line[-1] in ".,;:!?\"”-¬" or not (line[0].isalnum() or line[0] == "|"):
        return ""
    last = line.rsplit(None, 1)[-1][0]
    if last.isalpha() and not last.isupper():
        return ""
    words = line.split()
    if len(words) < 2 and not (alone and line.isalpha()):
        return ""
    big = sum(w[0].isupper() or not w[0].isalpha() for w in words)
    if big < 0.5 * len(words) or ":" in line:
        return ""
    letters = re.sub(r"[^a-z]", "", line.lower().translate(FOLD))
    for taken, folded in (("l", "i"), ("rn", "m"), ("vv", "w"), ("e", "c"), ("ci", "d"), ("ii", "h"), ("u", "h")):
        letters = letters.replace(taken, folded)
    return letters if len(letters) >= (6 if len(words) > 1 else 4) else ""


def page_lines(text: str) -> list[tuple[str, str, bool]]:
    """(line without a page number, key of a possible running title, whether a page number stood there) for every line."""
    lines = [line.strip() for line in re.split(r"\r\n?|\n", text)]
    filled = [i for i, line in enumerate(lines) if line]
    before = dict(zip(filled[1:], filled))
    edge = set(filled[:1] + filled[-1:])
    listed = lambda i: i in before and LABEL.match(lines[before[i]])
    keys = [title_key(line, i in edge and len(filled) > 1) if line else "" for i, line in enumerate(lines)]
    out = []
    for i, line in enumerate(lines):
        if not line:
            out.append(("", "", False))
            continue
        if len(line) <= LONGEST_NUMBER:
            if DRESSED.match(line):
                out.append(("", "", True))
                continue
            # A bare number that follows no label of a list, and stands apart or beside a title.
            if BARE.match(line) and not listed(i) and (i in edge or not lines[i - 1] or not lines[i + 1] or keys[i - 1] or keys[i + 1]):
                out.append(("", "", True))
                continue
        rest, key, number = line, keys[i], False
        m = LEAD.search(line) if line[0] in NUMBER_START else None
        k = m and titled(line) and title_key(line[m.end() :], True)
        if not k and (m := TRAIL.search(line) if NUMBER_END.fullmatch(line.rsplit(None, 1)[-1]) else None):
            k = titled(line) and title_key(line[: m.start()], True)
            if k and (not BARE.match(m.group(1)) or i in edge):
                rest, key, number = line[: m.start()], k, True
        elif k and (not BARE.match(m.group(1)) or i in edge):
            rest, key, number = line[m.end() :], k, True
        out.append((rest, key, number))
    return out


def titled(line: str) -> bool:
    """What is left beside a number must look like a title: at least half of its words begin with no small letter."""
    words = line.split()
    return 2 * sum(not w[0].islower() for w in words) >= len(words) - 2


def running(text: str, titles: set[str]) -> tuple[list[str], bool, bool]:
    """Lines of running text ('' at gaps), whether a running title and whether a page number stood among them."""
    out, header, number = [], False, False
    for rest, key, numbered in page_lines(text):
        number |= numbered
        if key and key in titles and "\n" in text.strip():
            header = True
        elif not (numbered and not rest):
            out.append(rest)
    return out, header, number


def break_at(line: str) -> tuple[str, str] | None:
    """(line without it, first part) of a word cut at the end of a line."""
    if len(line) > 2 and line[-1] in HYPHEN and line[-2].isalpha():
        left = re.search(r"[\w@!|$-]+$", line[:-1])
        return (line[: left.start()], left.group()) if left else None
    return None


def words_and_breaks(lines: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Words of the running text in order (lower case; None at a cut word), and the parts of cut words ('' at the end of the page)."""
    parts: list[str] = []
    breaks = []
    carried = ""
    for line in lines:
        if not line:
            continue
        line = line.lower()
        if carried:
            m = re.match(r"[\w@!|$-]+", line)
            if m:
                breaks.append((carried, m.group().rstrip(HYPHEN)))
                line = line[m.end() :]
            parts.append("\0")
            carried = ""
        if cut := break_at(line):
            line, carried = cut
        parts.append(line)
    if carried:
        breaks.append((carried, ""))
    return [None if w == "\0" else w for w in WORD_OR_CUT.findall("\n".join(parts))], breaks


def skeleton(word: str) -> str:
    """The strokes of a word. Whatever is misread for what in CONFUSIONS leaves them as they are: of three or more i-strokes in a row
    it is only kept that there are so many."""
    return re.sub("i{4,}", "iii", "".join(STROKES.get(c, c) for c in word))


def deletes(word: str) -> list[str]:
    """The skeleton of a word with up to DELETES strokes left out: two words are held against each other if they share one."""
    p = skeleton(word)
    if len(word) > LONG_WORD:
        return [p]
    return sorted({"".join(c for i, c in enumerate(p) if i not in gone) for k in range(min(DELETES, len(p) - 1) + 1) for gone in combinations(range(len(p)), k)})


def misread_cost(seen: str, meant: str) -> float:
    """Weighted edit distance: cheap for characters that are taken for each other, dear for others."""
    n, m = len(meant), len(seen)
    if abs(n - m) > MOST_LONGER:
        return 9.0
    d = [[9.0] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = d[i][j]
            if here > MOST_COST:
                continue
            if i < n and j < m:
                d[i + 1][j + 1] = min(d[i + 1][j + 1], here + (0 if meant[i] == seen[j] else EDIT_COST))
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], here + EDIT_COST)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], here + EDIT_COST)
            for size in (1, 2):
                for taken in CONFUSIONS.get(meant[i : i + size], ()) if i + size <= n else ():
                    if seen.startswith(taken, j):
                        d[i + size][j + len(taken)] = min(d[i + size][j + len(taken)], here + CONFUSED_COST)
    return d[n][m]


def correction_candidates(lexicon: DataFrame) -> DataFrame:
    """(word, meant, cost, word_n, meant_n): for odd words of ``lexicon`` (word, n), more frequent words they may be misreadings of."""
    keys = F.udf(deletes, T.ArrayType(T.StringType()), useArrow=True)
    plain = F.col("word").rlike(r"^[\p{L}'’-]+$") & ~F.col("word").rlike("[ſﬁﬂ]")
    # A word without any letter is a number.
    indexed = cut_lineage(lexicon.filter((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}")).withColumn("plain", plain).withColumn("key", F.explode(keys("word"))))
    good = indexed.filter(F.col("plain") & (F.col("n") >= 3)).select("key", F.col("word").alias("meant"), F.col("n").alias("meant_n"))
    odd = indexed.select("key", "word", F.col("n").alias("word_n"), "plain")
    near = (
        odd.join(good, "key")
        .filter((F.col("word") != F.col("meant")) & (F.abs(F.length("word") - F.length("meant")) <= MOST_LONGER) & (F.when(F.col("plain"), TIMES).otherwise(0) * F.col("word_n") <= F.col("meant_n")))
        .select("word", "meant", "word_n", "meant_n", "plain")
        .repartition(partitions(lexicon.sparkSession), "word", "meant")
        .dropDuplicates(["word", "meant"])
    )

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cost"] = [misread_cost(w, m) for w, m in zip(batch.word, batch.meant)]
            yield batch[batch.cost <= MOST_COST]

    weighed = near.mapInPandas(weigh, "word string, meant string, word_n long, meant_n long, plain boolean, cost double")
    return weighed.select("word", "word_n", "plain", "meant", "meant_n", (F.col("cost") - 0.12 * F.log10("meant_n")).alias("rank"))


def filter_bits(rows: int) -> int:
    return min(max((16 * rows).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def membership(hashes: DataFrame, rows: int) -> np.ndarray:
    """A bitmap in which the lower bits of every number of the first column of ``hashes`` are marked; its size follows ``rows``, their number at most.

    Blocks of the bitmap are built by tasks and put together in a stream. A mark by chance only costs a row in a later join.
    """
    bits = filter_bits(rows)
    places = hashes.select(hashes[0].bitwiseAND((1 << bits) - 1).alias("slot")).select(F.shiftright("slot", BLOCK_BITS).cast("int").alias("block"), F.col("slot").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, at = batch.column("block").to_numpy(), batch.column("at").to_numpy()
            for b in np.unique(block).tolist():
                held.setdefault(b, np.zeros(1 << min(bits, BLOCK_BITS), dtype=bool))[at[block == b]] = True
        for b, marks in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    each = 1 << (min(bits, BLOCK_BITS) - 3)
    for row in places.distinct().repartition("block").mapInArrow(run, "block int, marks binary").toLocalIterator():
        out[row.block * each : (row.block + 1) * each] = np.frombuffer(row.marks, dtype=np.uint8)
    return out


def is_marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(marks) - 1)
    return (marks[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1 > 0


def pair_hash(before, after):  # noqa: ANN001, ANN201
    """The hash of a word pair from the hashes of its words, as a column: ``numeric_pair_hash`` of the same numbers."""
    return before.bitwiseXOR(F.shiftleft(after, 21)).bitwiseXOR(F.shiftrightunsigned(after, 43))


def numeric_pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return before ^ (after << np.uint64(21)) ^ (after >> np.uint64(43))


class WordColumn:
    """A batch's lists of words as numbers: ``code`` of each word (-1 for a cut word), ``row`` it stands in, ``pos`` in its row; the distinct ``words``, and a hash of each (that of Spark's xxhash64)."""

    def __init__(self, column: pa.Array, hashed: bool = True):
        lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = column.flatten().dictionary_encode()
        self.code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.pos = np.arange(len(self.row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.words = coded.dictionary
        self.hash = np.array([xxhash.xxh64_intdigest(w.encode(), seed=42) for w in self.words.to_pylist()] if hashed else [], dtype=np.uint64)

    def text(self, codes: np.ndarray) -> pa.Array:
        """The words of the codes, null for none."""
        return self.words.take(pa.array(codes, mask=codes < 0))


def marked_words(read: DataFrame, marks: np.ndarray) -> DataFrame:
    """(unit, pos, before, word, after): the occurrences of words that may be marked, with their neighbours."""
    shared = read.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = WordColumn(batch.column("words"))
            hit = np.append(is_marked(shared.value, w.hash), False)  # the last for code -1
            at = np.flatnonzero(hit[w.code])
            code, row = np.append(w.code, -1), np.append(w.row, -1)
            before = np.where((at > 0) & (row[at - 1] == row[at]), code[at - 1], -1)
            after = np.where(row[at + 1] == row[at], code[at + 1], -1)
            columns = [batch.column("unit").take(pa.array(w.row[at])), pa.array(w.pos[at].astype(np.int32)), w.text(before), w.text(w.code[at]), w.text(after)]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "pos", "before", "word", "after"])

    return read.select("unit", "words").mapInArrow(run, "unit long, pos int, before string, word string, after string")


def marked_pairs(read: DataFrame, marks: np.ndarray) -> DataFrame:
    """(before, after, n): counts of the word pairs of the corpus that may be marked; counted in each batch and task, then added up."""
    shared = read.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = WordColumn(batch.column("words"))
            a, b = w.code[:-1], w.code[1:]
            pair = (w.row[:-1] == w.row[1:]) & (a >= 0) & (b >= 0)
            a, b = a[pair], b[pair]
            hit = is_marked(shared.value, numeric_pair_hash(w.hash[a], w.hash[b])) if len(a) else np.zeros(0, dtype=bool)
            both, n = np.unique(a[hit] * max(1, len(w.words)) + b[hit], return_counts=True)
            yield pa.RecordBatch.from_arrays([w.text(both // max(1, len(w.words))), w.text(both % max(1, len(w.words))), pa.array(n.astype(np.int64))], names=["before", "after", "n"])

    return read.select("words").mapInArrow(run, "before string, after string, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))


def _analysed(df: DataFrame, id_col: str, doc_col: str, text_col: str, order_col: str, keep_text: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages as read: what stands on them, their words and cuts; cuts by unit; replacements by unit)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), F.col(order_col).cast("long").alias("place"), F.col(text_col).alias("text")).filter(F.trim("text") != "")

    def titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A unit that is nothing but a heading gives no running title.
            out = [(i, k) for i, t in enumerate(batch.column("text").to_pylist()) if "\n" in t.strip() for k in {key for _, key, _ in page_lines(t) if key}]
            row = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("doc").take(row), pa.array([k for _, k in out], pa.string())], names=["id", "doc", "key"])

    id_kind = df.schema[id_col].dataType.simpleString()
    doc_kind = df.schema[doc_col].dataType.simpleString()
    keys = cut_lineage(rows.select("id", "doc", "text").mapInArrow(titles, f"id {id_kind}, doc {doc_kind}, key string").distinct())
    # A title recurs if it stands on two pages of the document; pages of a long document are counted, not gathered.
    recurring = keys.groupBy("doc", "key").agg(F.count("*").alias("n")).filter("n > 1").select("doc", "key")
    of_page = keys.join(recurring, ["doc", "key"]).groupBy("id").agg(F.collect_set("key").alias("titles"))
    # Pages delivered again fall away where they meet their titles: the texts move once.
    pages = rows.join(of_page, "id", "left").withColumn("unit", F.xxhash64("id", "text")).dropDuplicates(["id", "unit"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, titles in zip(batch.column("text").to_pylist(), batch.column("titles").to_pylist()):
                lines, header, number = running(text, set(titles or ()))
                words, breaks = words_and_breaks(lines)
                found.append((header, number, words, [a for a, _ in breaks], [b for _, b in breaks], next((w for w in words if w), "")))
            kinds = (pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * len(kinds), kinds)]
            text = batch.column("text") if keep_text else pa.nulls(len(found), pa.string())
            names = ["unit", "id", "doc", "place", "titles"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns, text], names=[*names, "header", "number", "words", "l", "r", "first", "text"])

    schema = f"unit long, id {id_kind}, doc {doc_kind}, place long, titles array<string>, header boolean, number boolean, words array<string>, l array<string>, r array<string>, first string, text string"
    read = cut_lineage(pages.select("unit", "id", "doc", "place", "text", F.coalesce("titles", F.array().cast("array<string>")).alias("titles")).mapInArrow(cut, schema))

    # The rest of a word cut at the end of a page stands at the beginning of the document's next page.
    ends = read.filter(F.try_element_at("r", F.lit(-1)) == "").select("unit", "doc", "place", F.try_element_at("l", F.lit(-1)).alias("l"))
    starts = read.groupBy("doc", (F.col("place") - 1).alias("place")).agg(F.min("first").alias("r"))
    ends = ends.join(starts, ["doc", "place"], "left").select("unit", "l", F.coalesce("r", F.lit("")).alias("r"), F.lit(True).alias("at_end"))
    inside = read.select("unit", F.explode(F.arrays_zip("l", "r")).alias("b")).select("unit", "b.l", "b.r", F.lit(False).alias("at_end")).filter("r <> ''")
    cuts = inside.unionByName(ends)


    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = WordColumn(batch.column("words"), hashed=False)
            yield pa.RecordBatch.from_arrays([w.words, pa.array(np.bincount(w.code[w.code >= 0], minlength=len(w.words)))], names=["word", "n"])

    lexicon = cut_lineage(read.select("words").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    count_of = lambda name: lexicon.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    parts = cuts.select("l", "r").distinct().withColumn("joined", F.concat("l", "r")).withColumn("compound", F.concat_ws("-", "l", "r"))
    judged = parts.join(count_of("joined"), "joined", "left").join(count_of("compound"), "compound", "left").join(count_of("l"), "l", "left").join(count_of("r"), "r", "left").fillna(0, ["n_joined", "n_compound", "n_l", "n_r"])
    # Known as one word, else as a compound, else a compound if both parts are words of their own.
    whole = F.when(F.col("n_joined") + F.col("n_compound") > 0, F.col("n_joined") >= F.col("n_compound")).otherwise((F.col("n_l") < 3) | (F.col("n_r") < 3))
    cuts = cuts.join(judged.select("l", "r", whole.alias("broken")), ["l", "r"])

    found = cut_lineage(correction_candidates(lexicon))
    # Occurrences of odd words with their neighbours; the pairs they would make are counted in the corpus. Bitmaps keep
    # other words and pairs out of the shuffles; what they let through by chance is dropped by the joins.
    marks = membership(found.select(F.xxhash64("word").alias("h")), found.count())
    options = cut_lineage(marked_words(read, marks).join(found, "word"))
    beside = F.array_compact(F.array(F.when(F.col("before").isNotNull(), pair_hash(F.xxhash64("before"), F.xxhash64("meant"))), F.when(F.col("after").isNotNull(), pair_hash(F.xxhash64("meant"), F.xxhash64("after")))))
    pairs = marked_pairs(read, membership(options.select(F.explode(beside).alias("h")), 2 * options.count()))
    left = pairs.select("before", F.col("after").alias("meant"), F.col("n").alias("n_left"))
    right = pairs.select(F.col("before").alias("meant"), "after", F.col("n").alias("n_right"))
    options = options.join(left, ["before", "meant"], "left").join(right, ["meant", "after"], "left").fillna(0, ["n_left", "n_right"])
    support = F.col("n_left") + F.col("n_right")
    sure = ~F.col("plain") | (F.col("meant_n") >= SURE_TIMES * F.col("word_n")) | (support > 0)
    chosen = options.filter(sure).groupBy("unit", "pos", "word").agg(F.min(F.struct((F.col("rank") - 0.1 * F.log10(1 + support)).alias("score"), "meant")).alias("m"))
    replacements = chosen.select("unit", "pos", "word", F.col("m.meant").alias("meant"))
    return read, cuts, replacements


def page_damage(df: DataFrame, id_col: str = "page_id", doc_col: str = "document_id", text_col: str = "text", order_col: str = "unit_index") -> DataFrame:
    """(id, damage): the kinds of scanning damage of each page: broken_word, misread, header, page_number.

    Null, empty and blank texts have none; pages delivered again count once, different texts under one id are judged each; other
    columns are ignored; an empty table gives no row. Methods and confidences stated by the extraction are not used.
    """
    read, cuts, replacements = _analysed(df, id_col, doc_col, text_col, order_col)
    marks = read.select("unit", F.explode(F.filter(F.array(F.when(F.col("header"), F.lit("header")), F.when(F.col("number"), F.lit("page_number"))), lambda x: x.isNotNull())).alias("damage"))
    marks = marks.unionByName(cuts.filter("broken").select("unit", F.lit("broken_word").alias("damage"))).unionByName(replacements.select("unit", F.lit("misread").alias("damage")))
    return marks.distinct().join(read.select("unit", "id"), "unit").select(F.col("id").alias(id_col), "damage").distinct()


def repaired_pages(df: DataFrame, id_col: str = "page_id", doc_col: str = "document_id", text_col: str = "text", order_col: str = "unit_index") -> DataFrame:
    """(id, text, repaired): each page as continuous paragraphs, without running titles and page numbers, words joined and misreadings put right.

    Cases as in ``page_damage``; a sound text comes back as it stands. A word cut at the end of the page keeps its first part.
    """
    read, cuts, replacements = _analysed(df, id_col, doc_col, text_col, order_col, keep_text=True)
    joined = cuts.filter("broken AND NOT at_end").groupBy("unit").agg(F.collect_set(F.concat_ws("\t", "l", "r")).alias("broken"))
    better = replacements.groupBy("unit").agg(F.collect_set(F.concat_ws("\t", "word", "meant")).alias("better"))
    rows = read.select("unit", "id", "text", "titles", "header", "number", (F.size("l") > 0).alias("cut")).join(joined, "unit", "left").join(better, "unit", "left")
    id_kind = df.schema[id_col].dataType.simpleString()

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, titles, header, number, cut, broken, better in zip(batch.id, batch.text, batch.titles, batch.header, batch.number, batch["cut"], batch.broken, batch.better):
                sound = not (header or number or cut) and better is None
                out.append((i, text, text if sound else repaired(text, set(titles), set(broken) if broken is not None else set(), dict(x.split("\t") for x in better) if better is not None else {})))
            yield pd.DataFrame(out, columns=["id", "text", "repaired"])

    return rows.mapInPandas(fix, f"id {id_kind}, text string, repaired string").withColumnRenamed("id", id_col)


def repaired(text: str, titles: set[str], broken: set[str], better: dict[str, str]) -> str:
    """Continuous paragraphs of one page, from what was found about it."""
    lines, _, _ = running(text, titles)
    paragraphs, current = [], ""
    for line in [*lines, ""]:
        if not line or LABEL.match(current) or LABEL.match(line):
            if current:
                paragraphs.append(current)
            current = line
            continue
        cut = break_at(current)
        m = re.match(r"[\w@!|$-]+", line)
        if cut and m:
            whole = f"{cut[1].lower()}\t{m.group().rstrip(HYPHEN).lower()}" in broken
            current = cut[0] + cut[1] + ("" if whole else "-") + line
        else:
            current = f"{current} {line}" if current else line

    def put_right(m: re.Match) -> str:
        word = m.group()
        meant = better.get(word.lower())
        if meant is None:
            return word
        return meant.upper() if word.isupper() and len(word) > 1 else meant.capitalize() if word[0].isupper() or (word[0].isdigit() and word[1:2].isupper()) else meant

    return "\n\n".join(WORD.sub(put_right, p) for p in paragraphs)
