"""Cut text units into chunks: sentence packing with whole-sentence overlap, or fixed strides where there are no sentences.

Cleaning, sentence splitting, joining and offsets are built-in expressions; Python sees only the lengths of the sentences
of a text and answers with ranges of sentences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorequarry.functions.text import chunk_id, clean_text, is_blank, sentences, strip_space, word_count


def check_sizes(size: int, overlap: int, least: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("the overlap must be at least 0 and below the chunk size")
    if least < 0:
        raise ValueError("the least chunk size must not be negative")


def packed_ranges(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) sentence of each chunk: as many as fit, then again with the last sentences that fit the overlap."""
    total = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64) + 1)])  # with one blank after each
    n, first, new, out = len(lengths), 0, 0, []
    while new < n:
        # Joined, sentences first..last have total[last + 1] - total[first] - 1 characters; the first new one always fits.
        last = max(new, int(np.searchsorted(total, size + 1 + total[first], side="right")) - 2)
        last = min(last, n - 1)
        out.append((first, last))
        new = last + 1
        first = max(first, int(np.searchsorted(total, total[new] - overlap - 1)))
        first = min(first, new)
    return out


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once: expressions are not carried through a generator, so what refers to it reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def character_ranges(text: Column, size: int, overlap: int) -> Column:
    """(start, end) of strides of size - overlap characters, up to the first that reaches the end."""
    n, step = F.length(text), max(size - overlap, 1)
    count = F.greatest(F.lit(1), F.ceil((n - size) / step).cast("int") + 1)
    spans = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))
    return F.when(n > 0, spans).otherwise(F.slice(spans, 1, 0))


def split_units(units: DataFrame, text_col: str = "text", size: int = 1200, overlap: int = 200, least: int = 100) -> DataFrame:
    """All columns of ``units`` but the text, with ``piece_index``, ``piece``, ``start_char``, ``end_char`` for each piece of the cleaned text.

    Offsets are those of the text cleaned twice; a piece that is not found there (it was joined over a line break) begins at 0,
    the last one ends with the text. A short last piece is added to the one before it. Blank and null texts give no piece.
    """
    check_sizes(size, overlap, least)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def ranges(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: [list(r) for r in packed_ranges(list(x), size, overlap)] if x is not None and len(x) else [])

    rest = [c for c in units.columns if c != text_col]
    base = _held(_held(units, "_o", clean_text(F.col(text_col))), "_t", clean_text(F.col("_o"))).filter(F.col("_t") != "")
    base = _held(base, "_s", F.when(F.length("_t") > size, sentences(F.col("_t"))))
    packed = F.col("_s").isNotNull() & (F.size("_s") > 1)
    base = base.withColumn("_r", F.when(packed, ranges(F.when(packed, F.transform("_s", F.length)))))
    joined = F.transform("_r", lambda r: strip_space(F.array_join(F.slice("_s", r[0] + 1, r[1] - r[0] + 1), " ")))
    base = _held(base, "_p", joined)
    n = F.length("_t")
    at = lambda p: F.greatest(F.position(p, F.col("_t")) - 1, F.lit(0))
    behind = lambda p: F.position(F.reverse(p), F.reverse(F.col("_t")))
    final = lambda p: F.when(behind(p) > 0, n - (behind(p) - 1) - F.length(p)).otherwise(F.greatest(n - F.length(p), F.lit(0)))
    piece = lambda p, s, e: F.struct(p.alias("piece"), s.cast("int").alias("start_char"), e.cast("int").alias("end_char"))
    many = F.transform("_p", lambda p, i: F.when(i == F.size("_p") - 1, piece(p, final(p), final(p) + F.length(p))).otherwise(piece(p, at(p), at(p) + F.length(p))))
    base = _held(base, "_m", many)
    last, before = F.try_element_at("_m", F.lit(-1)), F.try_element_at("_m", F.lit(-2))
    tiny = (F.size("_m") >= 2) & (F.length(last["piece"]) < least)
    merged = F.concat(F.slice("_m", 1, F.greatest(F.size("_m") - 2, F.lit(0))), F.array(piece(strip_space(F.concat_ws(" ", before["piece"], last["piece"])), before["start_char"], last["end_char"])))
    strides = F.filter(F.transform(character_ranges(F.col("_t"), size, overlap), lambda r: piece(strip_space(F.substring("_t", r["start"] + 1, r["end"] - r["start"])), r["start"], r["end"])), lambda x: x["piece"] != "")
    pieces = F.when(n <= size, F.array(piece(F.col("_t"), F.lit(0), n))).when(~packed, strides).when(tiny, merged).otherwise(F.col("_m"))
    return base.select(*rest, F.posexplode(pieces).alias("piece_index", "_x")).select(*rest, "piece_index", "_x.*")


def chunk_documents(units: DataFrame, size: int = 1200, overlap: int = 200, least: int = 100, provenance: tuple[str, ...] = ("page", "section", "chapter", "extraction_method", "extraction_confidence")) -> DataFrame:
    """Chunks of units (document_id, unit_index, text and provenance columns), numbered through each document in order of units."""
    kept = [c for c in provenance if c in units.columns]
    pieces = split_units(units.select("document_id", "unit_index", "text", *kept), "text", size, overlap, least)
    window = Window.partitionBy("document_id").orderBy("unit_index", "piece_index")
    numbered = pieces.withColumn("chunk_index", F.row_number().over(window) - 1)
    return numbered.select(
        chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("piece")).alias("chunk_id"), "document_id", F.col("piece").alias("text"), F.length("piece").alias("char_count"),
        word_count(F.col("piece")).alias("word_count"), *kept, "chunk_index", "start_char", "end_char",
    )


def character_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """(id, piece_index, start_char, end_char, piece): strides over the text as it stands; pieces are trimmed, blank ones left out."""
    check_sizes(size, overlap, 0)
    rows = df.select(id_col, F.col(text_col).alias("_t")).filter(~is_blank(F.col("_t")))
    rows = rows.select(id_col, "_t", F.posexplode(character_ranges(F.col("_t"), size, overlap)).alias("piece_index", "_r"))
    piece = strip_space(F.substring("_t", F.col("_r.start") + 1, F.col("_r.end") - F.col("_r.start")))
    return rows.select(id_col, "piece_index", F.col("_r.start").cast("int").alias("start_char"), F.col("_r.end").cast("int").alias("end_char"), piece.alias("piece")).filter("piece <> ''")
