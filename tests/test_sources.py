import json
import zipfile

import pytest
from lorequarry.config import EngineConfig
from lorequarry.sources import sinks, units
from lorequarry.sources.questions import read_questions

DOCX = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>The Gate</w:t></w:r></w:p><w:p><w:r><w:t>It  stood</w:t></w:r><w:r><w:t> open.</w:t></w:r></w:p><w:p/>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("unit_index").collect()]


def test_markdown(spark):
    text = "before\n\n# One\nbody of one\n\nmore \n## Two  \n#nospace\n# Three\n\n \n### Four"
    got = rows(units.markdown_units(spark.createDataFrame([("d", text)], "document_id string, text string")), "text", "section", "chapter", "extraction_method")
    assert got == [
        ("before", None, None, "markdown_text"), ("One", "One", "One", "markdown_heading"), ("body of one\n\nmore", "One", "One", "markdown_text"), ("Two", "Two", "One", "markdown_heading"),
        ("#nospace", "Two", "One", "markdown_text"), ("Three", "Three", "Three", "markdown_heading"), ("Four", "Four", "Three", "markdown_heading"),
    ]


def test_plain_text(spark):
    text = "Start here.\n\nChapter IV: The Gate\n\npara one\nstill one\n\nSection 2\n\nPart of\n\nTHE RIVER\n\nNOT THIS.\n\nPart two of it"
    got = rows(units.text_units(spark.createDataFrame([("d", text)], "document_id string, text string")), "text", "section", "chapter", "extraction_confidence")
    assert got == [
        ("Start here.", None, None, 1.0), ("Chapter IV: The Gate", "Chapter IV: The Gate", "Chapter IV: The Gate", 0.95), ("para one\nstill one", "Chapter IV: The Gate", "Chapter IV: The Gate", 1.0),
        ("Section 2", "Section 2", "Chapter IV: The Gate", 0.85), ("Part of", "Part of", "Part of", 0.95), ("THE RIVER", "THE RIVER", "Part of", 0.85), ("NOT THIS.", "THE RIVER", "Part of", 1.0), ("Part two of it", "THE RIVER", "Part of", 1.0),
    ]


def test_corpus(spark, tmp_path):
    for d in ("chronicles", "wiki", "wikis"):
        (tmp_path / d).mkdir()
    (tmp_path / "chronicles/a_b.md").write_text("# H\ntext")
    (tmp_path / "wiki/c.TXT").write_text("only text")
    (tmp_path / "wikis/bad.docx").write_bytes(b"no zip")
    (tmp_path / "wiki/skip.csv").write_text("1,2")
    with zipfile.ZipFile(tmp_path / "wiki/d.docx", "w") as z:
        z.writestr("word/document.xml", DOCX)
    documents, got = units.load_corpus(spark, str(tmp_path))
    by = {r.file_name: r for r in documents.collect()}
    assert set(by) == {"a_b.md", "c.TXT", "bad.docx", "d.docx"}
    assert by["bad.docx"].ingestion_error and by["bad.docx"].is_empty and by["bad.docx"].source_type == "unknown"
    assert by["a_b.md"].source_type == "chronicle" and by["a_b.md"].title == "A B" and by["a_b.md"].page_count == 2
    docx = rows(got.filter(got.document_id == by["d.docx"].document_id), "text", "section", "chapter", "extraction_method")
    assert docx == [("The Gate", "The Gate", "The Gate", "docx_heading"), ("It stood open.", "The Gate", "The Gate", "docx_paragraph"), ("Row 1: Column 1: a | Column 2: b", "The Gate", "The Gate", "docx_table")]
    report = sinks.ingestion_report(documents).first()
    assert (report.success_count, report.failure_count, report.skipped_count) == (3, 1, 0)
    whole = {json.loads(r.document)["file_name"]: json.loads(r.document) for r in sinks.document_export(documents, got).collect()}
    assert [p["text"] for p in whole["a_b.md"]["pages"]] == ["H", "text"] and whole["bad.docx"]["pages"] == []
    with pytest.raises(FileNotFoundError):
        units.load_corpus(spark, str(tmp_path / "none"))[0].collect()


def test_questions(spark, tmp_path):
    for name, body in (("a", ["  plain? ", {"qid": "q2", "question": "", "query": "from query?"}, {"text": " "}]), ("b", {"questions": [{"text": "from text?"}]}), ("c", {"items": ["x?"]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert [(r.qid, r.question) for r in read_questions(spark, str(tmp_path / "a.json")).orderBy("ord").collect()] == [(None, "plain?"), ("q2", "from query?")]
    assert [r.question for n in "bc" for r in read_questions(spark, str(tmp_path / f"{n}.json")).collect()] == ["from text?", "x?"]


def test_upsert_and_exports(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "id int, v string, at int")
    assert sorted((r.id, r.v) for r in sinks.upsert(old, new, ["id"], "at").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    with pytest.raises(Exception, match="a row without id"):
        sinks.upsert(old, spark.createDataFrame([(None, "x", 1)], old.schema), ["id"], "at").collect()
    chunk = spark.createDataFrame([("c", "t", None, 3)], "chunk_id string, text string, section string, page int")
    assert json.loads(sinks.chunk_export(chunk).first().chunk) == {"chunk_id": "c", "text": "t", "metadata": {"chunk_id": "c", "page": 3}}
    assert json.loads(sinks.scalar_metadata(chunk).first().metadata) == {"page": 3}


def test_config():
    c = EngineConfig.from_env({"QUARRY_CHUNK_SIZE": "900", "QUARRY_FUZZY_THRESHOLD": "0.9"})
    assert (c.chunk_size, c.fuzzy_threshold, c.final_top_k) == (900, 0.9, 8)


def test_chunk_files_and_document_texts(spark, tmp_path):
    from lorequarry.sources.chunks import document_texts, read_chunks

    rows = [{"chunk_id": "a", "text": "", "content": "from content"}, {"text": "t", "metadata": {"chunk_id": "b", "page": 2, "extra": {"title": "T"}}}, {"id": "c"}, {"text": "no id"}]
    (tmp_path / "chunks.json").write_text(json.dumps(rows))
    assert sorted((r.chunk_id, r.text, r.page, r.title) for r in read_chunks(spark, str(tmp_path / "chunks.json")).collect()) == [("a", "from content", None, None), ("b", "t", 2, "T")]
    units_ = spark.createDataFrame([("d", 1, " two "), ("d", 0, "one"), ("d", 2, None), ("e", 0, " ")], "document_id string, unit_index int, text string")
    assert sorted(map(tuple, document_texts(units_).collect())) == [("d", "one\n\ntwo", 3, False), ("e", "", 1, True)]


def test_chunk_files_hold_lists_that_are_read_back(spark, tmp_path):
    from lorequarry.sources.chunks import read_chunks
    from lorequarry.sources.sinks import write_chunk_files

    rows = [(f"c{i}", "d", f'text "{i}"\nwith a line', 1) for i in range(25)] + [("", "d", "no id", 1), ("empty", "d", "", 1)]
    write_chunk_files(spark.createDataFrame(rows, "chunk_id string, document_id string, text string, page int"), str(tmp_path / "chunks"), per_file=10)
    found = {r.chunk_id: (r.document_id, r.text, r.page) for r in read_chunks(spark, str(tmp_path / "chunks")).collect()}
    assert found == {f"c{i}": ("d", f'text "{i}"\nwith a line', 1) for i in range(25)}
    assert 1 < len(list((tmp_path / "chunks").glob("part-*"))) <= 4
