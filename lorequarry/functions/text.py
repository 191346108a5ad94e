"""Column functions over text. All but NFKC are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorequarry.config import SOURCE_AUTHORITY, SOURCE_DIRECTORIES

#: White space and word characters in the Unicode sense, spelled out so that every regex engine agrees.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"


def strip_space(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def remove_control_characters(c: Column) -> Column:
    """Without code points of category C, other than line feeds, carriage returns and tabs."""
    return F.regexp_replace(c, r"[^\P{C}\n\r\t]", "")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def normalize_unicode(c: Column) -> Column:
    """NFKC; texts of ASCII characters only never leave the JVM."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(_nfkc(F.when(F.octet_length(c) != F.length(c), c)))


def normalize_line_endings(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def join_hyphenated_lines(c: Column) -> Column:
    return F.regexp_replace(c, rf"({WORD})-\n({WORD})", "$1$2")


def normalize_whitespace(c: Column) -> Column:
    """Lines without space at their ends and runs of blanks within, at most one empty line in a row."""
    c = F.regexp_replace(c, r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    blank = SPACE.replace(r"\x09-\x0d", r"\x09")
    c = F.regexp_replace(c, rf"{blank}*\n{blank}*", "\n")
    return strip_space(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def fix_punctuation_spacing(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"{SPACE}+([,.;:!?])", "$1"), r"([,.;:!?])([A-Za-z])", "$1 $2")


def clean_text(c: Column, unicode: bool = True) -> Column:
    """All cleaning steps in order; null gives ''. Cleaning twice may differ from cleaning once."""
    c = remove_control_characters(F.coalesce(c, F.lit("")))
    c = normalize_unicode(c) if unicode else c
    for step in (normalize_line_endings, join_hyphenated_lines, normalize_whitespace, fix_punctuation_spacing, strip_space):
        c = step(c)
    return c


def clean_for_embedding(c: Column, unicode: bool = True) -> Column:
    c = F.regexp_replace(clean_text(c, unicode), rf"{SPACE}*\n{SPACE}*", " ")
    return strip_space(F.regexp_replace(c, r" {2,}", " "))


def sentences(c: Column) -> Column:
    """Pieces between white space that follows a full stop, exclamation or question mark; trimmed, without empty ones."""
    parts = F.split(c, rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, strip_space), lambda s: s != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), rf"{SPACE}+"), lambda w: w != ""))


def is_blank(c: Column) -> Column:
    return strip_space(F.coalesce(c, F.lit(""))) == ""


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def infer_title(file_name: Column) -> Column:
    """The stem with '_' and '-' as spaces, each letter after a non-letter in upper case and all others in lower case."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""), "[_-]", " ")
    stem = F.lower(strip_space(F.regexp_replace(stem, rf"{SPACE}+", " ")))
    letters = F.split(stem, "")
    return F.array_join(F.transform(letters, lambda x, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"\p{L}"), F.upper(x)).otherwise(x)), "")


def infer_source_type(path: Column) -> Column:
    """Category of the first known directory in the path, in order of precedence; else 'unknown'."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit("unknown")
    for directory, kind in reversed(SOURCE_DIRECTORIES.items()):
        out = F.when(low.rlike(f"(^|/){directory}/"), kind).otherwise(out)
    return out


def authority(source_type: Column, table: dict[str, float] = SOURCE_AUTHORITY) -> Column:
    pairs = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    return F.coalesce(F.try_element_at(pairs, first_filled(source_type)), F.lit(table["unknown"]))


def normalize_entity_name(c: Column) -> Column:
    c = F.regexp_replace(F.lower(strip_space(c)), r"[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}-]", "")
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def document_id(path: Column) -> Column:
    """'doc_' and twelve hex digits of the SHA-256 of the lower-cased path with forward slashes."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), 256), 1, 12))


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    mark = F.when(first_filled(text).isNull(), F.lit("000000")).otherwise(F.substring(F.sha2(text, 256), 1, 6))
    return F.format_string("%s_chunk_%04d_%s", document, index, mark)


def salvage_json(c: Column, schema: str) -> Column:
    """Strict JSON; else what stands from the first '{' to the last '}'; null if that is no JSON either."""
    whole = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    strict = F.get_json_object(c, "$").isNotNull() & strip_space(c).rlike(r"(?s)^\{.*\}$")
    inner = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(strict, whole).otherwise(F.from_json(F.when(F.get_json_object(inner, "$").isNotNull(), inner), schema))
