"""Registered queries of the core operators over whole tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.config import RANK_AUTHORITY
from lorequarry.functions import entities as names
from lorequarry.functions import text
from lorequarry.operators import answers, graph, metrics, retrieval
from lorequarry.operators.chunking import character_chunks, chunk_documents
from lorequarry.operators.resolve import best_matches
from lorequarry.operators.vectors import build_index, embed, nearest, search_index
from lorequarry.plans.engine import Engine
from lorequarry.session import cut_lineage, ensure_checkpoint_dir, table
from lorequarry.sources import sinks, units
from lorequarry.sources.chunks import document_texts as documents_of
from lorequarry.sources.chunks import read_chunks
from lorequarry.sources.questions import question_columns
from lorequarry.streaming.ingest import read_stream, read_upserts, stream_upsert, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "ask_evidence"

#: White space as DuckDB's regular expressions spell it, and word characters.
_S = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{S}", _S)
        return f

    return register


# Identity, titles and categories


@query(r"SELECT file_path, 'doc_' || sha256(lower(replace(file_path, '\', '/')))[1:12] AS derived_id FROM loaded_documents")
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loaded_documents").select("file_path", text.document_id(F.col("file_path")).alias("derived_id"))


_TYPE = r"""CASE WHEN regexp_matches(p, '(^|/)chronicles/') THEN 'chronicle' WHEN regexp_matches(p, '(^|/)wiki/') THEN 'wiki'
WHEN regexp_matches(p, '(^|/)codex/') THEN 'official_codex' WHEN regexp_matches(p, '(^|/)ephemera/') THEN 'ephemera' ELSE 'unknown' END"""


@query(rf"""WITH t AS (SELECT document_id, loaded_at, lower(replace(file_path, '\', '/')) AS p FROM loaded_documents), k AS (SELECT *, {_TYPE} AS kind FROM t)
SELECT document_id, loaded_at, kind, CASE kind WHEN 'official_codex' THEN 1.0 WHEN 'chronicle' THEN 0.85 WHEN 'wiki' THEN 0.65 WHEN 'ephemera' THEN 0.5 ELSE 0.4 END::DOUBLE AS authority FROM k""")
def source_type_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = text.infer_source_type(F.col("file_path"))
    return table(spark, sf_dir, "loaded_documents").select("document_id", "loaded_at", kind.alias("kind"), text.authority(kind).alias("authority"))


@query(r"""WITH t AS (SELECT file_name, lower(trim(regexp_replace(regexp_replace(regexp_replace(file_name, '(.)\.[^.]*$', '\1'), '[_-]', ' ', 'g'), '{S}+', ' ', 'g'))) AS s FROM loaded_documents)
SELECT file_name, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(s[i - 1], '\p{L}') THEN upper(s[i]) ELSE s[i] END), '') AS derived_title FROM t""")
def title_from_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loaded_documents").select("file_name", text.infer_title(F.col("file_name")).alias("derived_title"))


# Cleaning


def _nfkc_sql(c: str) -> str:
    """NFKC in DuckDB, which has only NFC: compatibility forms are put in place of the characters of the blocks that have them."""
    blocks = [(0xA0, 0x17F), (0x1C4, 0x1F3), (0x2000, 0x218F), (0x2460, 0x24FF), (0x3000, 0x303F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)]
    forms = {chr(i): unicodedata.normalize("NFKC", chr(i)) for a, b in blocks for i in range(a, b + 1)}
    forms = {k: v for k, v in forms.items() if v != k and unicodedata.normalize("NFC", k) != v}
    one = {k: v for k, v in forms.items() if len(v) == 1}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate({c}, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
    for k, v in forms.items():
        if len(v) > 1 and k in "¨ªº¯´¸¼½¾ĲĳŀŉǄǅǆ‗…‥‼⁇℀№℠℡™ﬀﬁﬂﬃﬄﬅﬆ":
            out = f"replace({out}, '{k}', {quoted(v)})"
    return f"nfc_normalize({out})"


@query(r"SELECT doc_id, md5(regexp_replace(text, '[^\P{C}\n\r\t]', '', 'g')) AS cleaned FROM documents WHERE text IS NOT NULL")
def strip_control_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text.remove_control_characters(F.col("text"))).alias("cleaned"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[^\P{C}\n\r\t]', '', 'g'), '\r\n?', chr(10), 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '[ \t]{2,}', ' ', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '[\x09\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\n[\x09\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*', chr(10), 'g') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^{S}+|{S}+$', '', 'g') AS t FROM d),
f AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{S}+([,.;:!?])', '\1', 'g'), '([,.;:!?])([A-Za-z])', '\1 \2', 'g') AS t FROM e)
SELECT doc_id, md5(regexp_replace(t, '^{S}+|{S}+$', '', 'g')) AS cleaned FROM f""")
def clean_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning steps but NFKC, which SQL does not have."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"), unicode=False)).alias("cleaned"))


_NO_CONTROLS = r"regexp_replace(coalesce(text, ''), '[^\P{C}\n\r\t]', '', 'g')"


def _clean_sql(source: str, keys: str, more: str = "t") -> str:
    """All cleaning steps over ``text`` of ``source``."""
    return rf"""WITH a AS (SELECT {keys}, {_nfkc_sql(_NO_CONTROLS)} AS t FROM {source}),
b AS (SELECT {keys}, regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS t FROM a),
c AS (SELECT {keys}, regexp_replace(regexp_replace(t, '[\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g') AS t FROM b),
d AS (SELECT {keys}, regexp_replace(t, '[\x09\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]*\n[\x09\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]*', chr(10), 'g') AS t FROM c),
e AS (SELECT {keys}, regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{{S}}+|{{S}}+$', '', 'g') AS t FROM d),
f AS (SELECT {keys}, regexp_replace(regexp_replace(t, '{{S}}+([,.;:!?])', '\1', 'g'), '([,.;:!?])([A-Za-z])', '\1 \2', 'g') AS t FROM e),
g AS (SELECT {keys}, regexp_replace(t, '^{{S}}+|{{S}}+$', '', 'g') AS t FROM f)
SELECT {keys}, {more} AS cleaned FROM g"""


@query(_clean_sql("loaded_pages", "page_id, loaded_at"))
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loaded_pages").select("page_id", "loaded_at", text.clean_text(F.col("text")).alias("cleaned"))


@query(_clean_sql("documents", "doc_id", "regexp_replace(regexp_replace(regexp_replace(t, '{S}*\\n{S}*', ' ', 'g'), ' {2,}', ' ', 'g'), '^{S}+|{S}+$', '', 'g')"))
def clean_for_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_for_embedding(F.col("text")).alias("cleaned"))


@query(r"""WITH t AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]){S}+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, regexp_replace(s, '^{S}+|{S}+$', '', 'g') AS s FROM t)
SELECT doc_id, md5(s) AS sentence, count(*) AS n FROM u WHERE s <> '' GROUP BY ALL""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s")).groupBy("doc_id", F.md5("s").alias("sentence")).agg(F.count("*").alias("n"))


@query(r"""SELECT chunk_id, loaded_at, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '{S}+'), lambda w: w <> '')) AS words,
regexp_replace(coalesce(text, ''), '{S}+', '', 'g') = '' AS blank FROM text_chunks""")
def char_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_chunks").select("chunk_id", "loaded_at", F.length("text").alias("chars"), text.word_count(F.col("text")).alias("words"), text.is_blank(F.col("text")).alias("blank"))


@query(r"""WITH n AS (SELECT DISTINCT unnest([subject, object]) AS name FROM claims)
SELECT name, regexp_replace(regexp_replace(lower(regexp_replace(name, '^{S}+|{S}+$', '', 'g')), '[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}-]', '', 'g'), '{S}+', ' ', 'g') AS normalized FROM n WHERE name IS NOT NULL""")
def normalize_entity_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "claims").select(F.explode(F.array("subject", "object")).alias("name")).filter("name IS NOT NULL").distinct()
    return found.select("name", text.normalize_entity_name(F.col("name")).alias("normalized"))


# Units and chunks


@query(r"""WITH t AS (SELECT doc_id, text AS t FROM documents WHERE regexp_replace(coalesce(text, ''), '{S}+', '', 'g') <> ''),
r AS (SELECT doc_id, t, unnest(range(0, greatest(1, ceil((length(t) - 1200) / 1000.0)::BIGINT + 1))) AS i FROM t)
SELECT doc_id, i::INT AS piece_index, (i * 1000)::INT AS start_char, least(i * 1000 + 1200, length(t))::INT AS end_char,
md5(regexp_replace(substr(t, (i * 1000 + 1)::BIGINT, 1200), '^{S}+|{S}+$', '', 'g')) AS piece FROM r WHERE regexp_replace(substr(t, (i * 1000 + 1)::BIGINT, 1200), '{S}+', '', 'g') <> ''""")
def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return character_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("piece", F.md5("piece"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.latest(table(spark, sf_dir, "loaded_pages"), ["page_id"], ["loaded_at"])


def _lengths_sql(least_end: str) -> str:
    """How many of the sums of sentence lengths are at most, or below, a value."""
    return f"len(list_filter(total, lambda x: x {least_end}))"


_STRIP = "regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"
_strip_sql = lambda c: _STRIP.replace("{c}", c)
_UNIT = "page_id, document_id, unit_index, page, section, chapter, extraction_method, extraction_confidence"
_NEWEST_PAGES = "SELECT * FROM loaded_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) = 1"
_CLEANED_ONCE = _clean_sql(f"({_NEWEST_PAGES})", _UNIT, "t").replace("AS cleaned", "AS text")
_CHUNKS_SQL = f"""WITH RECURSIVE units AS MATERIALIZED (SELECT *, length(cleaned) AS n FROM ({_clean_sql(f"({_CLEANED_ONCE})", _UNIT)}) WHERE cleaned <> ''),
cut AS (SELECT page_id, cleaned, n, list_filter(list_transform(string_split(regexp_replace(cleaned, '([.!?]){{S}}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip_sql("x")}), lambda x: x <> '') AS s FROM units WHERE n > 1200),
many AS MATERIALIZED (SELECT *, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: length(x) + 1)), 0)::BIGINT) AS total FROM cut WHERE len(s) > 1),
walk AS (SELECT page_id, total, len(s) AS m, 0::BIGINT AS first, least(len(s) - 1, greatest(0, {_lengths_sql("<= 1201")} - 2))::BIGINT AS last FROM many
UNION ALL SELECT page_id, total, m, first, least(m - 1, greatest(new, {_lengths_sql("<= 1201 + total[first + 1]")} - 2))::BIGINT FROM (
  SELECT page_id, total, m, last + 1 AS new, least(last + 1, greatest(first, {_lengths_sql("< total[last + 2] - 201")}))::BIGINT AS first FROM walk WHERE last + 1 < m)),
packed AS (SELECT page_id, cleaned, n, {_strip_sql("array_to_string(s[first + 1:last + 1], ' ')")} AS p, last, row_number() OVER w AS k, count(*) OVER (PARTITION BY page_id) AS pieces FROM walk JOIN many USING (page_id) WINDOW w AS (PARTITION BY page_id ORDER BY last)),
placed AS (SELECT page_id, k, pieces, p, CASE WHEN k < pieces THEN greatest(strpos(cleaned, p) - 1, 0) WHEN strpos(reverse(cleaned), reverse(p)) > 0 THEN n - strpos(reverse(cleaned), reverse(p)) + 1 - length(p) ELSE greatest(n - length(p), 0) END AS start FROM packed),
tails AS (SELECT *, start + length(p) AS stop, pieces > 1 AND any_value(length(p)) FILTER (WHERE k = pieces) OVER (PARTITION BY page_id) < 100 AS tiny, lead(p) OVER (PARTITION BY page_id ORDER BY k) AS next_p,
  lead(start + length(p)) OVER (PARTITION BY page_id ORDER BY k) AS next_stop FROM placed),
pieces AS (SELECT page_id, k, CASE WHEN tiny AND k = pieces - 1 THEN {_strip_sql("p || ' ' || next_p")} ELSE p END AS piece, start, CASE WHEN tiny AND k = pieces - 1 THEN next_stop ELSE stop END AS stop FROM tails WHERE NOT (tiny AND k = pieces)
UNION ALL SELECT page_id, 0, cleaned, 0, n FROM units WHERE n <= 1200
UNION ALL SELECT page_id, i, {_strip_sql("substr(cleaned, i * 1000 + 1, 1200)")}, i * 1000, least(i * 1000 + 1200, n) FROM (SELECT page_id, cleaned, n, unnest(range(0, ceil((n - 1200) / 1000.0)::BIGINT + 1)) AS i FROM cut WHERE len(s) < 2)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_index, k) - 1 AS i FROM pieces JOIN units USING (page_id) WHERE piece <> '')
SELECT document_id || '_chunk_' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, '0') || '_' || sha256(piece)[1:6] AS chunk_id, document_id, piece AS text, length(piece)::INT AS char_count,
len(list_filter(regexp_split_to_array(piece, '{{S}}+'), lambda w: w <> ''))::INT AS word_count, page::VARCHAR AS page, section, chapter, extraction_method, extraction_confidence, i::INT AS chunk_index, start::INT AS start_char, stop::INT AS end_char FROM numbered"""


@query(_CHUNKS_SQL)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of the files that are not chunked yet, cleaned and cut."""
    return chunk_documents(_pages(spark, sf_dir)).withColumn("page", F.col("page").cast("string"))


_LINES = r"regexp_replace({c}, '\r\n?|[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g')"
_HEADING = r"'^(#{1,6}){S}+(.+?){S}*$'"


@query(rf"""WITH t AS (SELECT doc_id, string_split({_LINES.replace("{c}", "text")}, chr(10)) AS l FROM documents WHERE source LIKE '%.md' AND text IS NOT NULL),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM t),
marked AS (SELECT *, length(regexp_extract(line, {_HEADING}, 1)) AS level, regexp_extract(line, {_HEADING}, 2) AS title FROM lines),
parts AS (SELECT *, sum((level > 0)::INT) OVER w AS part, last_value(CASE WHEN level > 0 THEN title END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS chapter
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
units AS (SELECT doc_id, part, 0 AS k, {_strip_sql("title")} AS text, section, chapter, 'markdown_heading' AS extraction_method FROM parts WHERE level > 0
UNION ALL SELECT doc_id, part, 1, {_strip_sql("string_agg(line, chr(10) ORDER BY i)")}, any_value(section), any_value(chapter), 'markdown_text' FROM parts WHERE level = 0 GROUP BY doc_id, part)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1)::INT AS unit_index, text, NULL::VARCHAR AS page, section, chapter, extraction_method, 1.0::DOUBLE AS extraction_confidence FROM units WHERE text <> ''""")
def markdown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.markdown_units(table(spark, sf_dir, "documents").filter("source LIKE '%.md' AND text IS NOT NULL"), "doc_id").withColumn("page", F.col("page").cast("string"))


_BLANK = r"[\x09\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


def _text_units_sql(source: str) -> str:
    """Paragraphs of the texts of ``source`` with the headings before them."""
    lines = _LINES.replace("{c}", "replace(text, chr(0), '')")
    return rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace({lines}, '{_BLANK}+\n', chr(10), 'g'), '{{S}}+$', '') AS t FROM {source}),
b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\n{{S}}*\n'), lambda x: {_strip_sql("x")}), lambda x: x <> '') AS b FROM t),
u AS (SELECT doc_id, unnest(b) AS text, generate_subscripts(b, 1) - 1 AS i FROM b),
c AS (SELECT *, NOT contains(text, chr(10)) AND regexp_matches(text, '(?i)^(chapter|book|part|volume)\s+[\p{{L}}\p{{N}}_]+(?:\s*[:-]\s*.+)?$') AS chap, NOT contains(text, chr(10)) AND (regexp_matches(text, '(?i)^(section|scene|act)\s+[\p{{L}}\p{{N}}_]+(?:\s*[:-]\s*.+)?$')
  OR (length(text) BETWEEN 3 AND 100 AND NOT regexp_matches(text, '[.!?,;]$') AND regexp_matches(text, '\p{{L}}') AND NOT regexp_matches(text, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]'))) AS sect FROM u)
SELECT doc_id, i::INT AS unit_index, text, NULL::VARCHAR AS page, last_value(CASE WHEN chap OR sect THEN text END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN chap THEN text END IGNORE NULLS) OVER w AS chapter,
CASE WHEN chap OR sect THEN 'text_heading' ELSE 'text_paragraph' END AS extraction_method, CASE WHEN chap THEN 0.95 WHEN sect THEN 0.85 ELSE 1.0 END::DOUBLE AS extraction_confidence FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""


@query(_text_units_sql("documents WHERE source LIKE '%.txt' AND text IS NOT NULL"))
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.text_units(table(spark, sf_dir, "documents").filter("source LIKE '%.txt' AND text IS NOT NULL"), "doc_id").withColumn("page", F.col("page").cast("string"))


@query(r"""SELECT page_id, loaded_at, CASE WHEN extraction_method = 'pdf_text_failed' THEN 'pdf_text_failed' WHEN n < 20 THEN 'pdf_text_low_content' ELSE 'pdf_text' END AS method,
CASE WHEN extraction_method = 'pdf_text_failed' THEN 0.0 WHEN n < 20 THEN 0.35 ELSE 0.95 END::DOUBLE AS confidence, extraction_method = 'pdf_text_failed' OR n < 20 AS scanned
FROM (SELECT *, length(regexp_replace(coalesce(text, ''), '^{S}+|{S}+$', '', 'g')) AS n FROM loaded_pages WHERE extraction_method LIKE 'pdf_text%')""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "loaded_pages").filter("extraction_method LIKE 'pdf_text%'")
    q = units.page_quality(F.col("text"), F.col("extraction_method") == "pdf_text_failed")
    return pages.select("page_id", "loaded_at", q.alias("q")).select("page_id", "loaded_at", F.col("q.extraction_method").alias("method"), F.col("q.extraction_confidence").alias("confidence"), F.col("q.likely_scanned_page").alias("scanned"))


# Tables and reports


@query("SELECT document_id, file_name, title, loaded_at FROM loaded_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY loaded_at DESC) = 1")
def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.latest(table(spark, sf_dir, "loaded_documents"), ["document_id"], ["loaded_at"]).select("document_id", "file_name", "title", "loaded_at")


@query("""WITH d AS (SELECT * FROM loaded_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY loaded_at DESC) = 1)
SELECT count(*) FILTER (WHERE ingestion_error IS NULL AND lower(extension) IN ('.pdf', '.docx', '.md', '.markdown', '.txt')) AS success_count, count(ingestion_error) AS failure_count,
count(*) FILTER (WHERE lower(extension) NOT IN ('.pdf', '.docx', '.md', '.markdown', '.txt')) AS skipped_count, sum(page_count)::BIGINT AS page_count FROM d""")
def ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.ingestion_report(units.latest(table(spark, sf_dir, "loaded_documents"), ["document_id"], ["loaded_at"]))


@query(r"""WITH p AS (SELECT * FROM loaded_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) = 1),
t AS (SELECT document_id, unit_index, regexp_replace(coalesce(text, ''), '^{S}+|{S}+$', '', 'g') AS t FROM p)
SELECT document_id, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY unit_index, t) FILTER (WHERE t <> ''), '')) AS text, count(*)::INT AS page_count, count(*) FILTER (WHERE t <> '') = 0 AS is_empty FROM t GROUP BY 1""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(_pages(spark, sf_dir)).withColumn("text", F.md5("text"))


def _json_sql(columns: list[str] | tuple[str, ...], more: str = "") -> str:
    """A JSON object of the columns that are not null, as Spark writes it."""
    parts = [f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || to_json({c}) END" for c in columns]
    return "'{' || concat_ws(',', " + ", ".join([*parts, *([more] if more else [])]) + ") || '}'"


_PAGE_JSON = _json_sql(["unit_index", "text", "page", "section", "chapter", "extraction_method", "extraction_confidence"])
_PAGES_JSON = "'\"pages\":[' || coalesce(pages, '') || '],\"page_count\":' || coalesce(n, 0)"


@query(f"""WITH d AS (SELECT * FROM loaded_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY loaded_at DESC) = 1),
p AS (SELECT * FROM loaded_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) = 1),
g AS (SELECT document_id, string_agg({_PAGE_JSON}, ',' ORDER BY unit_index, text, page) AS pages, count(*) AS n FROM p GROUP BY 1)
SELECT document_id, {_json_sql(["document_id", "file_name", "file_path", "extension", "source_type", "title", "ingestion_error"], _PAGES_JSON)} AS document FROM d LEFT JOIN g USING (document_id)""")
def document_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = units.latest(table(spark, sf_dir, "loaded_documents"), ["document_id"], ["loaded_at"]).drop("discovered_at", "loaded_at")
    return sinks.document_export(documents, _pages(spark, sf_dir))


_META = ("document_id", "char_count", "word_count", "file_name", "source_type", "page", "section", "chapter", "chunk_index", "start_char", "end_char", "extraction_method", "extraction_confidence")
_ONE_EACH = "(SELECT * FROM text_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at) = 1)"


@query("SELECT chunk_id, " + _json_sql(["chunk_id", "document_id", "text", "char_count", "word_count"], "'\"metadata\":' || " + _json_sql(["chunk_id", *[c for c in _META if c not in ("char_count", "word_count")]])) + f" AS chunk FROM {_ONE_EACH}")
def chunk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.chunk_export(table(spark, sf_dir, "text_chunks").dropDuplicates(["chunk_id"]).drop("extracted_at", "loaded_at"))


@query("SELECT chunk_id, " + _json_sql(_META) + f" AS metadata FROM {_ONE_EACH}")
def scalar_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.scalar_metadata(table(spark, sf_dir, "text_chunks").dropDuplicates(["chunk_id"]))


@query("""WITH new AS (SELECT vec_id, label + 100 AS label, embedding FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label, embedding FROM embeddings WHERE vec_id % 5 = 0)
SELECT vec_id, label::INT AS label, embedding[1]::DOUBLE AS first FROM (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM new) UNION ALL SELECT * FROM new)""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later vectors of every third row, and new rows, take their places in the store."""
    old = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    new = old.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(old.filter("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))
    return sinks.upsert(old, new, ["vec_id"]).select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding")[0].cast("double").alias("first"))


@query("SELECT item_id AS ord, qid, track, trim(question) AS question FROM eval_items WHERE trim(question) <> ''")
def question_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_columns(table(spark, sf_dir, "eval_items").withColumnRenamed("item_id", "ord"))


# Names and the graph of names

_NAMES = r"""
runs AS (SELECT chunk_id, regexp_extract_all(text, '\b((?:[A-Z][A-Za-z''-]+(?:{S}+(?:of|the|and|de|von|van))?{S}*){1,6})', 1) AS runs FROM (SELECT DISTINCT chunk_id, text FROM text_chunks)),
clean AS (SELECT chunk_id, list_transform(runs, lambda x: regexp_replace(regexp_replace(x, '{S}+', ' ', 'g'), '^ | $', '', 'g')) AS runs FROM runs),
named AS (SELECT chunk_id, list_distinct(list_transform(list_filter(runs, lambda x: length(x) >= 3 AND x NOT IN ('The', 'A', 'An', 'According', 'Volume', 'Chapter', 'Figure', 'Plate', 'Official', 'Age', 'What', 'Which', 'Whose', 'In', 'On', 'To', 'From', 'Its')),
  lambda x: regexp_replace(x, ' (?:of|the|and)$', ''))) AS entities FROM clean),
men AS (SELECT chunk_id, unnest(entities) AS entity FROM named),
pairs AS (SELECT x.entity AS a, y.entity AS b, count(*) AS count FROM men x JOIN men y ON x.chunk_id = y.chunk_id AND x.entity < y.entity GROUP BY 1, 2)
"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunk_entities(table(spark, sf_dir, "text_chunks"))


@query(f"WITH {_NAMES} SELECT entity, chunk_id FROM men")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mentions(_named(spark, sf_dir))


@query(f"WITH {_NAMES} SELECT a, b, count FROM pairs")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence(_named(spark, sf_dir))


@query(f"WITH {_NAMES} SELECT entity, chunk_id FROM men WHERE chunk_id IN (SELECT chunk_id FROM men GROUP BY 1 HAVING count(*) >= 2)")
def supported_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.supported_by(_named(spark, sf_dir))


@query(f"WITH {_NAMES} SELECT sum(len(entities))::BIGINT AS mentions, sum(len(entities) * (len(entities) - 1) // 2)::BIGINT AS connections FROM named")
def graph_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_counters(_named(spark, sf_dir))


_NEAR = r"""seeds AS (SELECT DISTINCT subject AS seed FROM claims WHERE subject <> ''),
ents AS (SELECT DISTINCT entity FROM men),
hit AS (SELECT seed, entity FROM seeds JOIN ents ON {match}),
edge AS (SELECT a AS node, b AS other, count FROM pairs UNION ALL SELECT b, a, count FROM pairs),
beside AS (SELECT seed, other AS name, sum(count)::BIGINT AS count FROM hit JOIN edge ON entity = node GROUP BY 1, 2),
ranked AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY count DESC, name) AS rank, name, count FROM beside)
SELECT seed, rank::INT AS rank, name, count FROM ranked WHERE rank <= 20 AND name NOT IN ({noise})"""
_BOTH, _ONE = "(contains(lower(entity), lower(seed)) OR contains(lower(seed), lower(entity)))", "contains(lower(entity), lower(seed))"
_NOISE = ", ".join(f"'{n}'" for n in names.NOISE_NAMES)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "claims").select(F.col("subject").alias("seed")).filter("seed <> ''").distinct()


@query("WITH " + _NAMES + ", " + _NEAR.replace("{match}", _BOTH).replace("{noise}", _NOISE))
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.archive_neighbours(_subjects(spark, sf_dir), _named(spark, sf_dir))


@query("WITH " + _NAMES + ", " + _NEAR.replace("{match}", _ONE).replace("{noise}", "''"))
def graph_neighbors_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.archive_neighbours(_subjects(spark, sf_dir), _named(spark, sf_dir), both_ways=False, noise=[""])


_in = lambda words: ", ".join(f"'{w}'" for w in words)
_ASKED = r"""
asked AS (SELECT qid, trim(question) AS question, list_filter(list_transform(regexp_extract_all(coalesce(question, ''), '\b((?:[A-Z][A-Za-z''-]+(?:{S}+(?:of|the|and))?{S}*){1,5})', 1),
  lambda x: regexp_replace(regexp_replace(x, '{S}+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x NOT IN ({question_stops})) AS names,
  regexp_extract_all(coalesce(question, ''), '(?:^|[^\p{L}\p{N}_])([A-Z][\p{L}\p{N}_''-]*(?:{S}+[A-Z][\p{L}\p{N}_''-]*)*)', 1) AS runs,
  list_filter(regexp_split_to_array(replace(coalesce(question, ''), '?', ''), '{S}+'), lambda w: w <> '') AS tokens FROM eval_items),
marked AS (SELECT *, array_to_string(list_transform(list_transform(tokens, lambda w: regexp_replace(w, '^[,.:;()\[\]{}"'']+|[,.:;()\[\]{}"'']+$', '', 'g')),
  lambda w: CASE WHEN regexp_matches(w, '^\p{Lu}') AND w NOT IN ({seed_stops}) THEN w ELSE chr(1) END), ' ') AS line FROM asked),
seeds_of AS (SELECT *, coalesce(list_filter(list_transform(regexp_split_to_array(line, ' ?\x01 ?'), lambda r: regexp_replace(r, '^{S}+|{S}+$', '', 'g')), lambda r: contains(r, ' '))[-1], question) AS seed,
  list_filter(runs, lambda x, i: list_position(runs, x) = i) AS analysed FROM marked)
""".replace("{question_stops}", _in(names.QUESTION_STOPWORDS)).replace("{seed_stops}", _in(names.SEED_STOPWORDS))


@query(f"""WITH {_NAMES}, {_ASKED}, named_in AS (SELECT DISTINCT qid AS query_id, unnest(names) AS name FROM asked),
hit AS (SELECT DISTINCT name, entity FROM (SELECT DISTINCT name FROM named_in WHERE name <> '') JOIN (SELECT DISTINCT entity FROM men WHERE entity <> '') ON {_BOTH.replace("seed", "name")}),
edge AS (SELECT a AS node, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs), near AS (SELECT DISTINCT name, other AS related FROM hit JOIN edge ON entity = node),
ranked AS (SELECT DISTINCT name, related, chunk_id FROM near JOIN men ON related = entity), kept AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY name ORDER BY chunk_id, related) <= 20)
SELECT DISTINCT query_id, chunk_id, related FROM named_in JOIN kept USING (name) WHERE related NOT IN ({_in(names.NOISE_NAMES[:7])})""")
def graph_evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the names beside those in each held-out question."""
    named = cut_lineage(_named(spark, sf_dir))
    asked = table(spark, sf_dir, "eval_items").select(F.col("qid").alias("query_id"), F.explode(names.question_entities(F.col("question"))).alias("name")).distinct()
    return graph.evidence_search(asked, named)


@query(f"WITH {_ASKED} SELECT qid, array_to_string(names, '|') AS names, array_to_string(analysed, '|') AS analysed, seed FROM seeds_of")
def question_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names, analysed names and the seed of each held-out question."""
    q = F.col("question")
    return table(spark, sf_dir, "eval_items").select("qid", F.array_join(names.question_entities(q), "|").alias("names"), F.array_join(names.analysed_entities(q), "|").alias("analysed"), names.seed_entity(q).alias("seed"))


# Claims

@query("""SELECT subject, predicate, object, chunk_id, max(loaded_at) AS loaded_at FROM claims
WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL""")
def claim_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.claim_graph(table(spark, sf_dir, "claims").withColumn("at", F.col("loaded_at")).withColumn("evidence", F.col("loaded_at").cast("string"))).select("subject", "predicate", "object", "chunk_id", F.col("evidence").cast("timestamp_ntz").alias("loaded_at"))


@query("""WITH e AS (SELECT DISTINCT subject, object, chunk_id FROM claims WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND chunk_id IS NOT NULL)
SELECT chunk_id, subject AS entity FROM e UNION SELECT chunk_id, object FROM e""")
def claim_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.claim_supports(graph.claim_graph(table(spark, sf_dir, "claims")))


@query("""WITH e AS (SELECT DISTINCT subject, predicate, object, chunk_id FROM claims WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND chunk_id IS NOT NULL),
n AS (SELECT DISTINCT subject AS name FROM e), b AS (SELECT subject AS node, object AS other, predicate, chunk_id FROM e UNION ALL SELECT object, subject, predicate, chunk_id FROM e),
r AS (SELECT name, other, predicate, chunk_id, row_number() OVER (PARTITION BY name ORDER BY other, predicate, chunk_id) AS rank FROM n JOIN b ON name = node)
SELECT name, rank::INT AS rank, other, predicate, chunk_id FROM r WHERE rank <= 20""")
def claim_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.claim_graph(table(spark, sf_dir, "claims"))
    return graph.claim_neighbours(edges, edges.select(F.col("subject").alias("name")).distinct()).drop("evidence")


@query("""WITH e AS (SELECT DISTINCT subject, object FROM claims WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND chunk_id IS NOT NULL),
n AS (SELECT DISTINCT unnest([subject, object]) AS entity FROM e), s AS (SELECT DISTINCT subject AS name FROM claims WHERE subject <> ''),
r AS (SELECT name, entity, row_number() OVER (PARTITION BY name ORDER BY entity) AS rank FROM s JOIN n ON entity <> '' AND (contains(lower(entity), lower(name)) OR contains(lower(name), lower(entity))))
SELECT name, rank::INT AS rank, entity FROM r WHERE rank <= 20""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut_lineage(graph.claim_graph(table(spark, sf_dir, "claims")))
    return graph.search_entities(edges, _subjects(spark, sf_dir).withColumnRenamed("seed", "name"))


_SUPPLY = """edges AS (SELECT 's' || s_suppkey AS edge_id, s_name AS subject, 'BASED_IN' AS predicate, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, n_name, 'PART_OF', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are based in nations, nations are parts of regions."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    based = s.join(n, s.s_nationkey == n.n_nationkey).select(F.concat(F.lit("s"), "s_suppkey").alias("edge_id"), F.col("s_name").alias("subject"), F.lit("BASED_IN").alias("predicate"), F.col("n_name").alias("object"), F.lit("supplier").alias("document_id"))
    part = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("n"), "n_nationkey").alias("edge_id"), F.col("n_name").alias("subject"), F.lit("PART_OF").alias("predicate"), F.col("r_name").alias("object"), F.lit("nation").alias("document_id"))
    return based.unionByName(part).withColumn("evidence", F.concat_ws(" ", "subject", F.lower("predicate"), "object")).withColumn("chunk_id", F.concat(F.lit("c_"), "edge_id"))


_TRAILS = f"""WITH RECURSIVE {_SUPPLY}, ways AS (SELECT subject AS node, object AS other, edge_id, predicate FROM edges UNION ALL SELECT object, subject, edge_id, predicate FROM edges),
walk AS (SELECT s_name AS seed, [s_name] AS nodes, []::VARCHAR[] AS ids, s_name AS tip, 0 AS hops, '' AS line FROM supplier
UNION ALL SELECT seed, list_append(nodes, other), list_append(ids, edge_id), other, hops + 1, line || CASE WHEN hops > 0 THEN ' | ' ELSE '' END || tip || ' -[' || predicate || ']-> ' || other FROM walk JOIN ways ON node = tip WHERE hops < 3 AND NOT list_contains(ids, edge_id)),
kept AS (SELECT * FROM walk WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hops, ids, nodes) <= 50)"""


def _supply_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supply_edges(spark, sf_dir)
    return graph.trails(edges, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("seed")), 3, 50)


@query(_TRAILS + " SELECT seed, array_to_string(nodes, '/') AS nodes, array_to_string(ids, '/') AS edge_ids, hops FROM kept")
def multi_hop_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supply_trails(spark, sf_dir).select("seed", F.array_join("nodes", "/").alias("nodes"), F.array_join("edge_ids", "/").alias("edge_ids"), "hops")


@query(_TRAILS + " SELECT seed, array_to_string(ids, '/') AS edge_ids, line AS summary FROM kept")
def path_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.with_relationships(_supply_trails(spark, sf_dir), _supply_edges(spark, sf_dir))
    return paths.select("seed", F.array_join("edge_ids", "/").alias("edge_ids"), graph.path_summary(F.col("nodes"), F.col("relationships")).alias("summary"))


@query(_TRAILS + """, steps AS (SELECT seed, hops, unnest(ids) AS edge_id FROM kept)
SELECT seed, 'c_' || edge_id AS chunk_id, round(1.0 / hops, 6)::DOUBLE AS score, count(*) AS n FROM steps GROUP BY ALL""")
def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = graph.graph_evidence(graph.with_relationships(_supply_trails(spark, sf_dir), _supply_edges(spark, sf_dir)))
    return facts.groupBy("seed", "chunk_id", F.round("score", 6).alias("score")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT subject, predicate, object, count(*) AS n FROM claims GROUP BY ALL)
SELECT subject, predicate, array_to_string(list_sort(list(object) FILTER (WHERE object IS NOT NULL)), '|') AS objects, sum(n)::BIGINT AS n_claims FROM o GROUP BY ALL HAVING count(*) > 1""")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.detect_conflicts(table(spark, sf_dir, "claims"))
    return found.withColumn("objects", F.when(F.size("objects") > 0, F.array_join("objects", "|")))


@query()
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of each name of the claims, subject or object, among all subjects; the more often stated first among equals."""
    c = table(spark, sf_dir, "claims")
    named = c.select(F.col("subject").alias("name")).unionByName(c.select(F.col("object").alias("name")))
    subjects = c.filter("subject IS NOT NULL").groupBy("subject").agg(F.count("*").alias("n"))
    return best_matches(named, subjects.select(F.col("subject").alias("candidate"), (-F.col("n")).alias("ord")))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties read back out of replies that wrap them in prose."""
    wrapped = F.concat(F.lit("Here it is: "), "props", F.lit(" - done."))
    return table(spark, sf_dir, "events").select("event_id", text.salvage_json(wrapped, "k string")["k"].alias("k"))


@query("""SELECT claim_id, loaded_at, subject, predicate, object, coalesce(evidence, '') AS evidence FROM claims WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL""")
def claims_from_llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims read back out of replies in JSON with prose around it; the replies are made of the claims table."""
    relation = F.struct("subject", "predicate", "object", "evidence")
    reply = F.concat(F.lit("The relations are "), F.to_json(F.struct(F.array(relation).alias("relations"))), F.lit("."))
    rows = answers.parsed_claims(table(spark, sf_dir, "claims").select("claim_id", "loaded_at", reply.alias("reply")))
    return rows.filter("error IS NULL").drop("error")


# Vectors

_KNN = """knn AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS score, c.label AS label, q.label AS query_label
FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM knn QUALIFY rank <= 10)"""


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "embeddings")
    return nearest(corpus.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), corpus)


@query(f"WITH {_KNN} SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM top")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@query()
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index, as it is by default, against the exact search, over the stated queries: one row."""
    corpus = table(spark, sf_dir, "embeddings")
    index, centres = build_index(corpus)
    asked = corpus.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search_index(asked, index, centres).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return _knn(spark, sf_dir).join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("expected"), F.count("hit").alias("found"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@query(f"""WITH {_KNN}, hits AS (SELECT query_id // 100 AS grp, (query_id % 100) // 20 AS query_ord, rank, vec_id, score FROM top),
seen AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY grp, vec_id ORDER BY query_ord, rank) = 1)
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY query_ord, rank, vec_id)::INT AS ord, vec_id, round(score, 6) AS score FROM seen""")
def multi_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five queries at a time fused in order of first sight."""
    hits = _knn(spark, sf_dir).select(F.floor(F.col("query_id") / 100).cast("long").alias("grp"), F.floor(F.col("query_id") % 100 / 20).cast("int").alias("query_ord"), "rank", "vec_id", "score")
    return retrieval.fuse_first_seen(hits, "grp", "vec_id").select("grp", "ord", "vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_KNN}, rel AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
per AS (SELECT query_id, count(*) FILTER (WHERE label = query_label) AS hits, count(*) AS n, min(rank) FILTER (WHERE label = query_label) AS first, any_value(query_label) AS ql FROM top GROUP BY 1)
SELECT count(*) AS queries, round(avg(hits / per.n), 9) AS precision, round(avg(hits / rel.n), 9) AS recall, round(avg(coalesce(1.0 / first, 0)), 9) AS mrr FROM per JOIN rel ON rel.label = ql""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "embeddings")
    asked = corpus.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    report = metrics.label_report(asked, _knn(spark, sf_dir), corpus.select("vec_id", "label"))
    return report.select("queries", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "mrr")])


@query(r"""WITH t AS (SELECT item_id, regexp_extract_all(lower(coalesce(question, '')), '([\p{L}\p{N}_]+)', 1) AS p, regexp_extract_all(lower(coalesce(passage, '')), '([\p{L}\p{N}_]+)', 1) AS r FROM eval_items),
s AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda x: x = t))))) AS shared FROM t)
SELECT item_id, round(CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN coalesce(shared, 0) = 0 THEN 0.0 ELSE 2.0 * shared / (len(p) + len(r)) END, 9)::DOUBLE AS f1 FROM s""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", F.round(metrics.token_f1(F.col("question"), F.col("passage")), 9).alias("f1"))


# Questions to evidence


def _engine(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame]:
    engine = Engine(table(spark, sf_dir, "text_chunks"), table(spark, sf_dir, "claims"))
    return engine, table(spark, sf_dir, "eval_items").select("qid", "question")


#: The hashing embedder in SQL: counts of words by the first eight hex digits of their MD5, modulo 64, scaled to length 1.
_VECTOR = r"""(SELECT {key}, list_transform(n, lambda x: (x / sqrt(list_sum(list_transform(n, lambda y: y * y))))::FLOAT::DOUBLE) AS v FROM (
  SELECT {key}, list_transform(range(0, 64), lambda b: len(list_filter(h, lambda x: x = b))::DOUBLE) AS n FROM (
    SELECT {key}, list_transform(regexp_extract_all(lower({text}), '[\p{L}\p{N}]+'), lambda w: ('0x' || md5(w)[1:8])::UBIGINT % 64) AS h FROM {source} WHERE trim({text}) <> '') WHERE len(h) > 0))"""
_vector = lambda source, key, text: _VECTOR.replace("{source}", source).replace("{key}", key).replace("{text}", text)
_CHUNKS = f"one AS MATERIALIZED {_ONE_EACH}, chunk_v AS MATERIALIZED {_vector('one', 'chunk_id', 'text')}"
_NEAREST = """(SELECT {key}, chunk_id, round(list_cosine_similarity(q.v, c.v), 12) AS score, row_number() OVER (PARTITION BY {key} ORDER BY round(list_cosine_similarity(q.v, c.v), 12) DESC, chunk_id) AS rank
  FROM {asked} q, chunk_v c QUALIFY rank <= 10)"""
_nearest = lambda asked, key: _NEAREST.replace("{asked}", asked).replace("{key}", key)
_EXPANDED = f"""{_NAMES}, {_ASKED}, {_CHUNKS}, ents AS (SELECT DISTINCT entity FROM men WHERE entity <> ''),
hit AS (SELECT DISTINCT seed, entity FROM (SELECT DISTINCT seed FROM seeds_of WHERE question <> '' AND seed <> '') JOIN ents ON {_BOTH}),
edge AS (SELECT a AS node, b AS other, count FROM pairs UNION ALL SELECT b, a, count FROM pairs),
beside AS (SELECT seed, other AS name, sum(count)::BIGINT AS count FROM hit JOIN edge ON entity = node GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY count DESC, name) AS rank FROM beside QUALIFY rank <= 20),
lists AS (SELECT seed, list(name ORDER BY rank) AS neighbours FROM ranked WHERE name NOT IN ({_NOISE}) GROUP BY 1),
with_lists AS (SELECT qid, question, s.seed, coalesce(neighbours, []::VARCHAR[]) AS neighbours FROM seeds_of s LEFT JOIN lists l ON l.seed = s.seed WHERE question <> ''),
chosen AS (SELECT *, (CASE WHEN len(list_filter(neighbours, lambda n: regexp_matches(n, '{"|".join(retrieval.BODY_WORDS)}'))) > 0
  THEN list_filter(neighbours, lambda n: regexp_matches(n, '{"|".join(retrieval.BODY_WORDS)}')) ELSE neighbours END)[1:3] AS names FROM with_lists),
queries AS (SELECT *, unnest(texts) AS query, generate_subscripts(texts, 1) - 1 AS query_ord FROM (
  SELECT qid, question, seed, neighbours, list_concat([question], flatten(list_transform(names, lambda n: [n || ' ' || question, n || ' {retrieval.EXPANSION_WORDS}']))) AS texts FROM chosen)),
query_v AS MATERIALIZED {_vector("queries", "qid, query_ord", "query")},
hits AS {_nearest("query_v", "qid, query_ord")},
fused AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY query_ord, rank, chunk_id) AS ord, chunk_id, query_ord, rank, score
  FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY query_ord, rank, score) = 1))"""


@query(f"""WITH {_EXPANDED} SELECT qid, ord::INT AS ord, chunk_id, query_ord::INT AS query_ord, rank::INT AS rank, round(score, 6) AS score, text, document_id, source_type FROM fused JOIN one USING (chunk_id)""")
def ask_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for every held-out question: seed, neighbours, expanded queries, nearest chunks, fused."""
    engine, asked = _engine(spark, sf_dir)
    return engine.retrieve(asked).withColumn("score", F.round("score", 6))


@query(f"""WITH {_EXPANDED}, context AS (SELECT qid, count(*)::INT AS evidence_count, string_agg('[Evidence ' || ord || ']' || chr(10) || 'chunk: ' || chunk_id || chr(10) || 'document: ' || coalesce(nullif(document_id, ''), 'unknown')
  || chr(10) || 'source: ' || coalesce(nullif(source_type, ''), 'unknown') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY ord) AS context FROM fused JOIN one USING (chunk_id) WHERE ord <= 15 GROUP BY 1)
SELECT qid, question, seed AS seed_entity, 'Answer the question from the evidence alone. If it does not suffice, say what is missing.' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Subject: ' || seed || chr(10)
  || 'Related names: ' || array_to_string(neighbours[1:12], ', ') || chr(10) || chr(10) || 'Evidence:' || chr(10) || context || chr(10) || chr(10)
  || 'Write three parts: ''Answer'', ''Reasons'' and ''Evidence used'', naming the numbers of the evidence.' || chr(10) AS prompt, evidence_count FROM with_lists JOIN context USING (qid)""")
def ask_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, asked = _engine(spark, sf_dir)
    return engine.ask_batch(asked)


_STEP = """(SELECT seed, list_append(nodes, other) AS nodes, list_append(ids, edge_id) AS ids, other AS tip, have FROM {before} JOIN ways ON node = tip
  WHERE have < 50 AND NOT list_contains(ids, edge_id) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY list_append(ids, edge_id), list_append(nodes, other)) <= 50 - have)"""
_step = lambda before: f"(SELECT * REPLACE (have + count(*) OVER (PARTITION BY seed) AS have) FROM {_STEP.replace('{before}', before)})"
_AUTHORITY = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANK_AUTHORITY.items()) + f" ELSE {RANK_AUTHORITY['unknown']} END::DOUBLE"
_RANKED = f"""{_ASKED}, {_CHUNKS}, questions AS (SELECT qid, question, analysed FROM seeds_of WHERE question <> ''),
query_v AS MATERIALIZED {_vector("questions", "qid", "question")}, hits AS {_nearest("query_v", "qid")},
edges AS MATERIALIZED (SELECT subject, predicate, object, chunk_id, evidence, document_id, source_type, concat_ws(chr(1), subject, predicate, object, chunk_id) AS edge_id FROM claims
  WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject, predicate, object, chunk_id ORDER BY loaded_at DESC) = 1),
ways AS MATERIALIZED (SELECT subject AS node, object AS other, edge_id FROM edges UNION ALL SELECT object, subject, edge_id FROM edges WHERE subject <> object),
wanted AS (SELECT DISTINCT qid, unnest(analysed) AS name FROM questions), graph_names AS (SELECT DISTINCT unnest([subject, object]) AS entity FROM edges),
matched AS (SELECT name, entity FROM (SELECT DISTINCT name FROM wanted WHERE name <> '') JOIN graph_names ON entity <> '' AND (contains(lower(entity), lower(name)) OR contains(lower(name), lower(entity)))
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY entity) <= 20),
seeds AS MATERIALIZED (SELECT DISTINCT qid, entity AS seed FROM wanted JOIN matched USING (name)),
hop0 AS (SELECT DISTINCT seed, [seed] AS nodes, []::VARCHAR[] AS ids, seed AS tip, 0::BIGINT AS have FROM seeds),
hop1 AS MATERIALIZED {_step("hop0")}, hop2 AS MATERIALIZED {_step("hop1")}, hop3 AS MATERIALIZED {_step("hop2")},
steps AS (SELECT seed, nodes, ids, len(ids) AS hops, unnest(ids) AS edge_id, generate_subscripts(ids, 1) AS i FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2 UNION ALL SELECT * FROM hop3)),
facts AS (SELECT qid, 1000000 + row_number() OVER (PARTITION BY qid ORDER BY seed, hops, ids, nodes, i) AS ord, 'graph' AS kind, evidence AS text, chunk_id, document_id, source_type, predicate, 1.0::DOUBLE / hops AS score
  FROM seeds JOIN steps USING (seed) JOIN edges USING (edge_id) WHERE evidence <> ''),
found AS (SELECT qid, rank - 1 AS ord, 'vector' AS kind, text, chunk_id, document_id, source_type, NULL::VARCHAR AS predicate, score FROM hits JOIN one USING (chunk_id) UNION ALL SELECT * FROM facts),
merged AS (SELECT * REPLACE (min(ord) OVER w AS ord), row_number() OVER (w ORDER BY score DESC, ord) AS nth FROM found WINDOW w AS (PARTITION BY qid, coalesce(nullif(chunk_id, ''), text))),
scored AS (SELECT *, {_AUTHORITY} AS authority_score, round(0.75 * score + 0.25 * {_AUTHORITY}, 9) AS final_score FROM merged WHERE nth = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, ord) AS place FROM scored QUALIFY place <= 8)"""


@query(f"""WITH {_RANKED} SELECT qid, place::INT AS rank, ord, kind, r.text, r.chunk_id, r.document_id, r.source_type, predicate, round(score, 6) AS score, authority_score, round(final_score, 6) AS final_score, file_name, page::VARCHAR AS page, section
FROM ranked r LEFT JOIN one o ON o.chunk_id = r.chunk_id""")
def ask_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of vectors and of trails in the claim graph, ranked by score and authority."""
    engine, asked = _engine(spark, sf_dir)
    return engine.retrieve_modular(asked).withColumns({"score": F.round("score", 6), "final_score": F.round("final_score", 6), "page": F.col("page").cast("string")})


@query(f"""WITH {_RANKED} SELECT qid, 'E' || place AS marker, nullif(r.chunk_id, '') AS chunk_id, nullif(r.document_id, '') AS document_id, nullif(file_name, '') AS file_name, nullif(page, 0)::VARCHAR AS page, nullif(section, '') AS section,
nullif(r.source_type, '') AS source_type FROM ranked r LEFT JOIN one o ON o.chunk_id = r.chunk_id""")
def ask_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, asked = _engine(spark, sf_dir)
    return answers.citations(engine.retrieve_modular(asked)).withColumn("page", F.col("page").cast("string"))

@query(f"""WITH {_CHUNKS}, asked AS (SELECT qid, question FROM eval_items), query_v AS MATERIALIZED {_vector("asked", "qid", "question")}, hits AS {_nearest("query_v", "qid")},
matched AS (SELECT chunk_id, list(question ORDER BY qid, question) AS all_questions, min(qid) AS first_question, arg_min(rank, (qid, rank)) AS first_rank FROM hits JOIN asked USING (qid) GROUP BY 1)
SELECT chunk_id, text, array_to_string(list_filter(all_questions, lambda x, i: list_position(all_questions, x) = i), '|') AS matched_questions, first_question, first_rank::INT AS first_rank
FROM matched JOIN one USING (chunk_id) WHERE length(regexp_replace(text, '^{{S}}+|{{S}}+$', '', 'g')) >= 100""")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that any held-out question finds, with the questions that find them."""
    engine, asked = _engine(spark, sf_dir)
    hits = nearest(embed(asked, "qid", "question", is_query=True), engine.vectors(), 10, "qid", "chunk_id").join(asked, "qid")
    return retrieval.select_candidates(hits.withColumn("question_ord", F.col("qid")), engine.chunks).withColumn("matched_questions", F.array_join("matched_questions", "|"))


@query(f"""WITH {_CHUNKS}, query_v AS MATERIALIZED {_vector("eval_items", "qid", "passage")}, hits AS {_nearest("query_v", "qid")}
SELECT qid, rank::INT AS rank, chunk_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM hits""")
def text_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks to every held-out passage."""
    items = table(spark, sf_dir, "eval_items").select("qid", "passage")
    engine, _ = _engine(spark, sf_dir)
    return nearest(embed(items, "qid", "passage", is_query=True), engine.vectors(), 10, "qid", "chunk_id").withColumns({c: F.round(c, 6) for c in ("score", "distance")})


@query(f"""WITH {_EXPANDED} SELECT qid, array_to_string(list_concat([question], list_transform(CASE WHEN len(list_filter(neighbours, lambda n: regexp_matches(n, '{"|".join(retrieval.EXPLORATORY_BODY_WORDS)}'))) > 0
  THEN list_filter(neighbours, lambda n: regexp_matches(n, '{"|".join(retrieval.EXPLORATORY_BODY_WORDS)}')) ELSE neighbours[1:5] END, lambda n: n || ' ' || question || ' {retrieval.EXPANSION_WORDS}')), chr(10)) AS queries FROM chosen""")
def exploratory_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wider expansion of every held-out question."""
    engine, asked = _engine(spark, sf_dir)
    rows = engine.queries(asked).filter("query_ord = 0")
    return rows.select("qid", F.array_join(retrieval.explored_queries(F.col("question"), F.col("neighbours")), "\n").alias("queries"))


@query(f"""WITH {_CHUNKS}, asked AS (SELECT qid, trim(question) AS question FROM eval_items WHERE trim(question) <> ''), query_v AS MATERIALIZED {_vector("asked", "qid", "question")}, hits AS {_nearest("query_v", "qid")},
context AS (SELECT qid, string_agg('[E' || rank || '] chunk_id=' || chunk_id || '; source=' || coalesce(nullif(file_name, ''), 'unknown') || coalesce(', page ' || nullif(page, 0), '') || '; source_type=' || coalesce(nullif(source_type, ''), 'unknown')
  || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN one USING (chunk_id) WHERE rank <= 8 GROUP BY 1)
SELECT qid, 'Answer the question from the evidence below. Mark each statement with its evidence, like [E1]. Where sources disagree, say so and name both.' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || context || chr(10) AS prompt
FROM asked JOIN context USING (qid)""")
def cited_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt with marked evidence, the eight nearest chunks, for every held-out question."""
    engine, asked = _engine(spark, sf_dir)
    asked = asked.select("qid", F.trim("question").alias("question")).filter("question <> ''")
    hits = nearest(embed(asked, "qid", "question", is_query=True), engine.vectors(), engine.config.final_top_k, "qid", "chunk_id")
    context = answers.cited_context(hits.join(engine.chunks.select("chunk_id", "file_name", "page", "source_type", "text"), "chunk_id"))
    return asked.join(context, "qid").select("qid", answers.cited_prompt(F.col("question"), F.col("context")).alias("prompt"))


@query(f"""SELECT chunk_id, md5('List the names in the passage as JSON {{"entities": [{{"name": ..., "type": PERSON|FACTION|EVENT|PLACE|ARTIFACT|OBJECT|OTHER}}]}}.' || chr(10) || chr(10) || 'Passage:' || chr(10) || text) AS names,
md5('List what the passage states as JSON {{"relations": [{{"subject": ..., "predicate": UPPER_SNAKE_CASE, "object": ..., "evidence": ...}}]}}.' || chr(10) || chr(10) || 'Passage:' || chr(10) || text) AS relations FROM {_ONE_EACH}""")
def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about each chunk."""
    of_names, of_relations = answers.extraction_prompts(F.col("text"))
    return table(spark, sf_dir, "text_chunks").dropDuplicates(["chunk_id"]).select("chunk_id", F.md5(of_names).alias("names"), F.md5(of_relations).alias("relations"))


# Files


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(_text_units_sql("documents WHERE source LIKE '%.txt' AND text IS NOT NULL").replace("page, last_value", "page, 'unknown' AS source_type, last_value"))
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain text documents written as files, one each, found again and read by their extension."""
    root = _folder(spark, "corpus")
    table(spark, sf_dir, "documents").filter("source LIKE '%.txt' AND text IS NOT NULL").select("doc_id", "text").write.partitionBy("doc_id").text(root)
    documents, found = units.load_corpus(spark, root)
    key = F.regexp_extract("file_path", r"doc_id=(-?\d+)/", 1).cast("long").alias("doc_id")
    return found.join(documents.filter("ingestion_error IS NULL").select("document_id", key, "source_type"), "document_id").drop("document_id").withColumn("page", F.col("page").cast("string"))


@query(f"""SELECT chunk_id, nullif(document_id, '') AS document_id, md5(text) AS text, file_name, source_type, page::VARCHAR AS page, section, chapter, chunk_index::VARCHAR AS chunk_index,
start_char::VARCHAR AS start_char, end_char::VARCHAR AS end_char, extraction_method, extraction_confidence FROM {_ONE_EACH} WHERE chunk_id <> '' AND text <> ''""")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks written as JSON lists, and read back flat."""
    root = _folder(spark, "chunks")
    sinks.write_chunk_files(table(spark, sf_dir, "text_chunks").dropDuplicates(["chunk_id"]).drop("extracted_at", "loaded_at"), root)
    rows = read_chunks(spark, root).withColumn("text", F.md5("text")).withColumns({c: F.col(c).cast("string") for c in ("page", "chunk_index", "start_char", "end_char")})
    return rows.select("chunk_id", "document_id", "text", "file_name", "source_type", "page", "section", "chapter", "chunk_index", "start_char", "end_char", "extraction_method", "extraction_confidence")


@query("SELECT claim_id, subject, predicate, object, evidence, chunk_id FROM claims")
def claim_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims written as JSON, and read back."""
    root = _folder(spark, "claims")
    rows = table(spark, sf_dir, "claims").select("claim_id", "subject", "predicate", "object", "evidence", "chunk_id")
    sinks.write_json(rows, root)
    return spark.read.schema(rows.schema).json(root)


@query(f"SELECT page_id, document_id, md5(text) AS text, loaded_at FROM ({_NEWEST_PAGES})")
def stage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest pages handed on as a stage's table."""
    root = _folder(spark, "stage")
    sinks.write_stage(_pages(spark, sf_dir), root)
    return spark.read.parquet(root).select("page_id", "document_id", F.md5("text").alias("text"), "loaded_at")


# Rows that arrive over time


@query("""SELECT claim_id, subject, predicate, object, loaded_at FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY loaded_at DESC) = 1""")
def streamed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims folded in as a stream: of repeated and late rows of one id the last stays."""
    root = _folder(spark, "stream")
    schema = table(spark, sf_dir, "claims").schema
    stream_upsert(read_stream(spark, sf_dir, "claims", schema), f"{root}/table", f"{root}/progress", ["claim_id"], "loaded_at")
    return read_upserts(spark, f"{root}/table", ["claim_id"], "loaded_at").select("claim_id", "subject", "predicate", "object", "loaded_at")


@query("""SELECT date_trunc('hour', loaded_at) AS start, predicate, count(*) AS n FROM claims WHERE loaded_at IS NOT NULL GROUP BY ALL""")
def claims_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "claims"), "loaded_at", ["predicate"]).filter("start IS NOT NULL")
