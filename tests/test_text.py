import re
import unicodedata

from lorequarry.functions import entities, text
from pyspark.sql import functions as F


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.c for r in df.select("i", f(F.col("t")).alias("c")).orderBy("i").collect()]


def test_cleaning_goldens(spark):
    cases = {"a  ,b": "a, b", "e.g.": "e. g.", "soft­hy": "softhy", "ﬁn": "fin", "x\r\ny": "x\ny", "inter-\nnational": "international", None: "", "": "", "inter- \nnational": "inter-\nnational", "a\n\n\n\nb": "a\n\nb", "NUL\x00L": "NULL", "x y": "x\ny", "word\n, next": "word, next", "１２": "12", "a​b": "ab"}
    assert column(spark, list(cases), text.clean_text) == list(cases.values())
    assert column(spark, ["inter- \nnational"], lambda c: text.clean_text(text.clean_text(c))) == ["international"]
    assert column(spark, ["a \n b\n\nc"], text.clean_for_embedding) == ["a b c"]


def test_nfkc_equals_the_standard_library(spark):
    values = ["".join(chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000) for lo in range(0x80, 0x3400, 64)]
    assert column(spark, values, text.normalize_unicode) == [unicodedata.normalize("NFKC", v) for v in values]


def test_space_is_unicode_space(spark):
    values = [chr(c) + "x" + chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    assert column(spark, values, text.strip_space) == [v.strip() for v in values]
    assert column(spark, ["a b　c", " ", "", None], text.word_count) == [3, 0, 0, 0]


def test_sentences(spark):
    values = ["One. Two!  Three? four", "", "no end", "A.B. C"]
    assert column(spark, values, text.sentences) == [[s.strip() for s in re.split(r"(?<=[.!?])\s+", v) if s.strip()] for v in values]


def test_titles_and_categories(spark):
    assert column(spark, ["x_y-3rd o'b.md", "the_great-book.v2.pdf", "noext"], text.infer_title) == ["X Y 3Rd O'B", "The Great Book.V2", "Noext"]
    assert column(spark, ["Chronicles/b.pdf", "x/wiki/y.md", "codex\\a.txt", "wikis/a.md", None], text.infer_source_type) == ["chronicle", "wiki", "official_codex", "unknown", "unknown"]
    assert column(spark, ["wiki", "", None, "other"], text.authority) == [0.65, 0.4, 0.4, 0.4]
    assert column(spark, ["  Anna-Roe, the  \tBold! "], text.normalize_entity_name) == ["anna-roe the bold"]


def test_ids(spark):
    import hashlib

    assert column(spark, ["A\\B.pdf"], text.document_id) == ["doc_" + hashlib.sha256(b"a/b.pdf").hexdigest()[:12]]
    assert column(spark, ["", None, "x"], lambda c: text.chunk_id(F.lit("d"), F.lit(7), c)) == ["d_chunk_0007_000000", "d_chunk_0007_000000", "d_chunk_0007_" + hashlib.sha256(b"x").hexdigest()[:6]]


def test_json_salvage(spark):
    got = column(spark, ['{"a":1}', 'x {"a": {"b": 2}} y', "nope", "{broken", None, '{"b":1}'], lambda c: text.salvage_json(c, "a string")["a"])
    assert got == ["1", '{"b":2}', None, None, None, None]


def test_entities(spark):
    values = ["War of Drowned Light", "Battle of the Pass", "In the hall", "House devoured", "Order officials", "A", None, "One Two Three Four Five Six Seven"]
    assert column(spark, values, entities.passage_entities) == [["War of Drowned Light"], ["Battle", "Pass"], ["In"], ["House de"], ["Order"], [], [], ["One Two Three Four Five Six", "Seven"]]
    assert column(spark, ["Who met Anna Roe of Tor and Anna Roe?"], entities.question_entities) == [["Anna Roe of Tor and Anna Roe"]]
    assert column(spark, ["Which king met Bela Kun?"], entities.analysed_entities) == [["Which", "Bela Kun"]]


def test_seeds(spark):
    cases = {"Which lord ruled House Aldermoor?": "House Aldermoor", "Who gave Anna Roe's ring to Bela Kun?": "Bela Kun", "Whose was Anna Roe's?": "Anna Roe's", "Who came first?": "Who came first?", "Where is The Iron Gate": "Iron Gate", '"Edda Holt" wrote what?': "Edda Holt"}
    assert column(spark, list(cases), entities.seed_entity) == list(cases.values())
