"""Turn documents into text units: Markdown and plain text with built-in expressions, DOCX and PDF by parsers on workers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorequarry.config import SUPPORTED_EXTENSIONS
from lorequarry.functions.text import SPACE, document_id, infer_source_type, infer_title, strip_space

UNIT_COLUMNS = "text string, page int, section string, chapter string, extraction_method string, extraction_confidence double"
HEADING = rf"^(#{{1,6}}){SPACE}+(.+?){SPACE}*$"
CHAPTER = r"(?i)^(chapter|book|part|volume)\s+[\p{L}\p{N}_]+(?:\s*[:-]\s*.+)?$"
SECTION = r"(?i)^(section|scene|act)\s+[\p{L}\p{N}_]+(?:\s*[:-]\s*.+)?$"
#: Below this many characters a PDF page holds next to no text.
LOW_CONTENT = 20


def markdown_units(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(id, unit_index, text, page, section, chapter, method, confidence): headings and the blocks between them.

    A first-level heading is chapter and section of what follows, other headings only the section. Lines are handled within
    the row of their document, by expressions on its array of lines, so a document is never shuffled.
    """
    lines = F.split(F.regexp_replace(F.col(text_col), r"\r\n?|[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n"), "\n")
    level = lambda x: F.length(F.regexp_extract(x, HEADING, 1))
    title = lambda x: F.regexp_extract(x, HEADING, 2)
    numbered = docs.select(id_col, lines.alias("_l")).withColumn("_h", F.filter(F.transform("_l", lambda x, i: F.when(level(x) > 0, i)), lambda i: i.isNotNull()))
    # A block begins at the top and after each heading, and ends before the next one.
    starts = F.concat(F.array(F.lit(-1)), "_h")
    ends = F.concat("_h", F.array(F.size("_l")))
    tops = F.filter("_h", lambda i: level(F.get("_l", i)) == 1)
    spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))

    def unit(x: Column, head: bool) -> Column:
        place, at = x["s"], x["s"] + 1
        own = F.try_element_at(F.filter(tops, lambda i: i <= place), F.lit(-1))
        body = F.array_join(F.slice("_l", at + 1, F.greatest(x["e"] - at, F.lit(0))), "\n")
        text = title(F.get("_l", place)) if head else F.regexp_replace(body, rf"^(?:{SPACE}*\n)+|{SPACE}+\z", "")
        return F.struct(
            (place * 2 + (0 if head else 1)).alias("k"), strip_space(text).alias("text"), F.when(place >= 0, title(F.get("_l", place))).alias("section"), F.when(own.isNotNull(), title(F.get("_l", own))).alias("chapter"),
            F.lit("markdown_heading" if head else "markdown_text").alias("extraction_method"),
        )

    heads = F.transform(F.filter(spans, lambda x: x["s"] >= 0), lambda x: unit(x, True))
    bodies = F.transform(spans, lambda x: unit(x, False))
    units = F.filter(F.array_sort(F.concat(heads, bodies)), lambda u: u["text"] != "")
    return numbered.select(id_col, F.posexplode(units).alias("unit_index", "u")).select(id_col, "unit_index", "u.text", F.lit(None).cast("int").alias("page"), "u.section", "u.chapter", "u.extraction_method", F.lit(1.0).alias("extraction_confidence"))


def is_upper_heading(c: Column) -> Column:
    """3 to 100 characters, no closing punctuation, at least one letter and only upper-case ones."""
    return F.length(c).between(3, 100) & ~c.rlike(r"[.!?,;]$") & c.rlike(r"\p{L}") & ~c.rlike(r"[\p{L}&&[^\p{Lu}]]")


def text_units(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Paragraphs of plain text, with chapter and section headings carried on to the paragraphs after them."""
    text = F.regexp_replace(F.regexp_replace(F.replace(F.col(text_col), F.lit("\x00"), F.lit("")), r"\r\n?|[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n"), rf"(?:(?!\n){SPACE})+(?=\n)|{SPACE}+\z", "")
    blocks = F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n"), strip_space), lambda b: b != "")
    single = lambda b: ~b.contains("\n")
    chapter = lambda b: single(b) & b.rlike(CHAPTER)
    section = lambda b: single(b) & (b.rlike(SECTION) | is_upper_heading(b))
    rows = docs.select(id_col, blocks.alias("_b"))
    marks = lambda test: F.filter(F.transform("_b", lambda b, i: F.when(test(b), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_c", marks(chapter)).withColumn("_s", marks(lambda b: chapter(b) | section(b)))
    last = lambda array, i: F.get("_b", F.try_element_at(F.filter(array, lambda j: j <= i), F.lit(-1)))
    units = F.transform("_b", lambda b, i: F.struct(
        b.alias("text"), last("_s", i).alias("section"), last("_c", i).alias("chapter"),
        F.when(chapter(b) | section(b), "text_heading").otherwise("text_paragraph").alias("extraction_method"),
        F.when(chapter(b), 0.95).when(section(b), 0.85).otherwise(1.0).alias("extraction_confidence"),
    ))
    return rows.select(id_col, F.posexplode(units).alias("unit_index", "u")).select(id_col, "unit_index", "u.text", F.lit(None).cast("int").alias("page"), "u.section", "u.chapter", "u.extraction_method", "u.extraction_confidence")


def page_quality(text: Column, failed: Column) -> Column:
    """(extraction_method, extraction_confidence, likely_scanned_page) of a PDF page by what could be read of it."""
    low = F.length(strip_space(F.coalesce(text, F.lit("")))) < LOW_CONTENT
    return F.struct(
        F.when(failed, "pdf_text_failed").when(low, "pdf_text_low_content").otherwise("pdf_text").alias("extraction_method"),
        F.when(failed, 0.0).when(low, 0.35).otherwise(0.95).alias("extraction_confidence"),
        (failed | low).alias("likely_scanned_page"),
    )


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(content: bytes) -> list[dict]:
    """Paragraphs, headings and tables of a DOCX body in order."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    chapter = section = None
    out = []
    flat = lambda node: re.sub(r"\s+", " ", "".join(t.text or "" for t in node.iter(f"{_W}t"))).strip()
    for node in body:
        if node.tag == f"{_W}p" and (text := flat(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            kind = "docx_paragraph"
            if name.lower().startswith("heading"):
                kind, section = "docx_heading", text
                chapter = text if re.sub(r"\D", "", name) == "1" else chapter
            out.append({"text": text, "section": section, "chapter": chapter, "extraction_method": kind, "extraction_confidence": 1.0})
        elif node.tag == f"{_W}tbl":
            rows = [[flat(cell) for cell in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")]
            lines = [f"Row {i}: " + " | ".join(f"Column {j}: {v}" for j, v in enumerate(row, 1) if v) for i, row in enumerate(rows, 1) if any(row)]
            if lines:
                out.append({"text": "\n".join(lines), "section": section, "chapter": chapter, "extraction_method": "docx_table", "extraction_confidence": 0.95})
    return out


def parse_pdf(content: bytes) -> list[dict]:
    """Page texts of a PDF, if a parser is installed."""
    import pypdf  # optional

    out = []
    for number, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1):
        try:
            text, failed = (page.extract_text() or "").replace("\x00", ""), False
        except Exception:  # noqa: BLE001 - one bad page does not stop the file
            text, failed = "", True
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(line.strip() for line in text.splitlines())).strip()
        low = len(text) < LOW_CONTENT
        out.append({"text": text, "page": number, "extraction_method": "pdf_text_failed" if failed else "pdf_text_low_content" if low else "pdf_text", "extraction_confidence": 0.0 if failed else 0.35 if low else 0.95})
    return out


def discover(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, relative_path, extension, content) of the supported files below ``root``."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    except (AnalysisException, Py4JJavaError) as e:
        raise FileNotFoundError(f"no folder to read: {root}") from e
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    base = re.sub(r"^file:/*", "/", root.rstrip("/")) if "://" not in root or root.startswith("file:") else root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/", "")
    return files.select("path", relative.alias("relative_path"), extension.alias("extension"), "content").filter(F.col("extension").isin(*SUPPORTED_EXTENSIONS))


def load_corpus(spark: SparkSession, root: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, units) of all supported files below ``root``; a file that cannot be read is a document with an ingestion error."""
    files = discover(spark, root, recursive)
    files = files.withColumn("document_id", document_id(F.col("relative_path")))

    kinds = pa.schema([("document_id", pa.string()), ("unit_index", pa.int32()), ("text", pa.string()), ("page", pa.int32()), ("section", pa.string()), ("chapter", pa.string()), ("extraction_method", pa.string()), ("extraction_confidence", pa.float64()), ("ingestion_error", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, extension, content in zip(*(batch.column(c).to_pylist() for c in ("document_id", "extension", "content"))):
                try:
                    units = parse_docx(content) if extension == ".docx" else parse_pdf(content)
                    out += [{"document_id": key, "unit_index": i, **u} for i, u in enumerate(units)]
                except Exception as e:  # noqa: BLE001 - the error becomes a row
                    out.append({"document_id": key, "unit_index": -1, "ingestion_error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    binary = files.filter(F.col("extension").isin(".docx", ".pdf")).select("document_id", "extension", "content")
    parsed = binary.mapInArrow(parse, f"document_id string, unit_index int, {UNIT_COLUMNS}, ingestion_error string")
    decoded = files.select("document_id", "extension", F.decode(F.col("content"), "UTF-8").alias("text"))
    units = (
        parsed.filter("ingestion_error IS NULL").drop("ingestion_error")
        .unionByName(markdown_units(decoded.filter(F.col("extension").isin(".md", ".markdown"))))
        .unionByName(text_units(decoded.filter("extension = '.txt'")))
    )
    counts = units.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count"), F.max((F.length(strip_space(F.col("text"))) > 0)).alias("filled"))
    errors = parsed.filter("ingestion_error IS NOT NULL").select("document_id", "ingestion_error")
    name = F.regexp_extract("relative_path", r"[^/]*$", 0)
    documents = (
        files.drop("content").join(counts, "document_id", "left").join(errors, "document_id", "left")
        .select("document_id", name.alias("file_name"), F.col("relative_path").alias("file_path"), "extension", infer_source_type(F.col("relative_path")).alias("source_type"), infer_title(name).alias("title"),
                F.coalesce("page_count", F.lit(0)).alias("page_count"), (~F.coalesce("filled", F.lit(False))).alias("is_empty"), "ingestion_error")
    )
    return documents, units


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with the same keys the last one by ``order``; ties are broken by the whole row."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest)))
    return df.groupBy(*keys).agg(last.alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def document_order(units: DataFrame) -> DataFrame:
    """Units with their ordinal in the document."""
    return units.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy("unit_index")) - 1)
