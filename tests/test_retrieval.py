import pytest
from lorequarry.operators import answers, metrics, retrieval
from lorequarry.plans.engine import BadRequest, Engine, NotFound
from pyspark.sql import functions as F


def test_expansion(spark):
    df = spark.createDataFrame([(["Anna", "House Roe", "Iron Order", "Guild A", "Legion B"],), (["x", "y"],), ([],)], "n array<string>")
    assert [r.e for r in df.select(retrieval.expansion_names(F.col("n")).alias("e")).collect()] == [["House Roe", "Iron Order", "Guild A"], ["x", "y"], []]
    assert df.limit(1).select(retrieval.expanded_queries(F.lit("q?"), F.array(F.lit("N"))).alias("e")).first().e == ["q?", "N q?", "N accord war conflict victory won winner"]


def test_fusion_keeps_first_sight(spark):
    hits = spark.createDataFrame([("q", 1, 1, "b", 0.9), ("q", 0, 2, "b", 0.5), ("q", 0, 1, "a", 0.4), ("q", 1, 2, "c", 0.99), ("q", 1, 3, "", 1.0)], "qid string, query_ord int, rank int, chunk_id string, score double")
    assert [(r.ord, r.chunk_id, r.score) for r in retrieval.fuse_first_seen(hits).orderBy("ord").collect()] == [(1, "a", 0.4), (2, "b", 0.5), (3, "c", 0.99)]


def test_merge_and_rank(spark):
    rows = [("q", 0, "v", "t1", "c1", "wiki", 0.8), ("q", 1, "v", "t2", "c2", "official_codex", 0.5), ("q", 2, "g", "e1", "c1", "wiki", 1.0), ("q", 3, "g", "e2", "c2", None, 0.5), ("q", 4, "g", "text", "", "odd", None), ("q", 5, "g", "text", None, "x", 0.1)]
    df = spark.createDataFrame(rows, "qid string, ord long, kind string, text string, chunk_id string, source_type string, score double")
    merged = retrieval.merge_evidence(df)
    assert sorted((r.ord, r.text) for r in merged.collect()) == [(0, "e1"), (1, "t2"), (4, "text")]
    ranked = retrieval.rank_evidence(df.filter("ord < 2")).orderBy("rank").collect()
    assert [(r.final_score, r.chunk_id) for r in ranked] == [(0.8, "c1"), (0.625, "c2")]


def test_contexts_and_citations(spark):
    df = spark.createDataFrame([("q", 1, 1, "c1", "d", None, "text", "f.pdf", 0, ""), ("q", 2, 2, "c2", "", "wiki", "more", None, 3, "S")], "qid string, ord int, rank int, chunk_id string, document_id string, source_type string, text string, file_name string, page int, section string")
    assert answers.evidence_context(df).first().context == "[Evidence 1]\nchunk: c1\ndocument: d\nsource: unknown\ntext\n\n[Evidence 2]\nchunk: c2\ndocument: unknown\nsource: wiki\nmore"
    assert answers.cited_context(df).first().context == "[E1] chunk_id=c1; source=f.pdf; source_type=unknown\ntext\n\n[E2] chunk_id=c2; source=unknown, page 3; source_type=wiki\nmore"
    assert [(r.marker, r.page, r.section) for r in answers.citations(df).orderBy("marker").collect()] == [("E1", None, None), ("E2", 3, "S")]


def test_model_boundary(spark):
    class Failing:
        def generate(self, prompt, temperature=0.1):
            if "bad" in prompt:
                raise TimeoutError("slow")
            return '{"relations": [{"subject": "a", "predicate": "P", "object": "b"}, {"subject": "a"}]}'

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string")
    replies = answers.generate(df, "id", "prompt", Failing())
    assert {r.id: r.error for r in replies.collect()} == {1: None, 2: "TimeoutError: slow"}
    claims = answers.parsed_claims(replies.select("id", "reply")).collect()
    assert sorted((r.subject or "", r.evidence, r.error or "") for r in claims) == [("", "", "incomplete relation"), ("a", "", "")]
    waits, tries = [], iter([0, 0, 1])
    assert answers.with_retries(lambda: 1 / next(tries), sleep=waits.append) == 1 and waits == [1, 2]


def test_extraction(spark):
    class Model:
        def generate(self, prompt, temperature=0.1):
            if "fails" in prompt:
                raise TimeoutError("slow")
            return 'Sure: {"entities": [{"name": "A", "type": "PERSON"}]}' if '"entities"' in prompt else '{"relations": [{"subject": "A", "predicate": "P", "object": "B", "evidence": "e"}]}'

    rows = [("c1", "d", "wiki", "long enough " * 10), ("c2", "d", None, "short"), ("c3", "d", None, "this fails " * 10)]
    claims, listed = answers.extract_claims(spark.createDataFrame(rows, "chunk_id string, document_id string, source_type string, text string"), Model())
    assert sorted((r.chunk_id, r.subject, r.error) for r in claims.collect()) == [("c1", "A", None), ("c3", None, "TimeoutError: slow")]
    assert [tuple(r) for r in listed.collect()] == [("c1", "A", "PERSON")]
    q = spark.createDataFrame([(["x", "House Y", "Order Z"],)], "n array<string>").select(retrieval.explored_queries(F.lit("q"), F.col("n")).alias("e")).first().e
    assert len(q) == 3 and q[1].startswith("House Y q ")


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "d"]), ([], ["x"]), (["a", "a"], []), (["b", "b"], ["b"])], "r array<string>, g array<string>")
    got = df.select(metrics.precision_at(F.col("r"), F.col("g"), 2).alias("p"), metrics.recall_at(F.col("r"), F.col("g"), 3).alias("c"), metrics.reciprocal_rank(F.col("r"), F.col("g")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.5, 1.0, 1.0)]
    f1 = spark.createDataFrame([("a b b", "b c"), ("", ""), ("a", ""), (None, None), ("x", "y")], "p string, r string").select(metrics.token_f1(F.col("p"), F.col("r")).alias("f"))
    assert [round(r.f, 9) for r in f1.collect()] == [0.4, 1.0, 0.0, 1.0, 0.0]


def test_engine(spark):
    rows = [("c1", "d", "Anna Roe ruled House Aldermoor beside Bela Kun for years.", "wiki", "f.md", 1, None), ("c2", "d", "Bela Kun fought the Iron Order at the river gate.", "chronicle", "f.md", 2, None), ("c3", "e", "Nothing of note happened by the sea.", None, None, None, None)]
    chunks = spark.createDataFrame(rows + rows[:1], "chunk_id string, document_id string, text string, source_type string, file_name string, page int, section string")
    claims = spark.createDataFrame([("Anna Roe", "RULED", "House Aldermoor", "c1", "Anna Roe ruled", "d", "wiki", 1)], "subject string, predicate string, object string, chunk_id string, evidence string, document_id string, source_type string, loaded_at int")
    engine = Engine(chunks, claims)
    answer = engine.ask("Who ruled House Aldermoor?")
    assert answer.seed_entity == "House Aldermoor" and answer.evidence_count == 3 and "[Evidence 1]" in answer.answer
    asked = spark.createDataFrame([("1", "Who ruled House Aldermoor?"), ("2", "  ")], "qid string, question string")
    assert {r.qid for r in engine.retrieve(asked).collect()} == {"1"}
    out = engine.ask_modular("Who ruled House Aldermoor?")
    assert out["evidence"][0]["chunk_id"] == "c1" and out["evidence"][0]["kind"] == "graph" and out["citations"][0]["marker"] == "E1"
    with pytest.raises(BadRequest):
        engine.ask(" ")
    with pytest.raises(NotFound):
        Engine(chunks.limit(0)).ask("Who?")


def test_label_report_keeps_hits_as_rows(spark):
    corpus = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "y"), (6, None)], "vec_id long, label string")
    asked = spark.createDataFrame([(1, "x"), (4, "y"), (6, None)], "query_id long, label string")
    hits = spark.createDataFrame([(1, 1, 4), (1, 2, 2), (4, 1, 1), (4, 2, 6), (6, 1, 6), (6, 2, 1)], "query_id long, rank int, vec_id long")
    report = metrics.label_report(asked, hits, corpus)
    row = report.first()
    assert row.queries == 2 and abs(row.precision - 0.25) < 1e-12 and abs(row.recall - 1 / 6) < 1e-12 and row.mrr == 0.25
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_retrieval_metrics_gathers_no_label(spark, tmp_path):
    from lorequarry.queries import QUERIES

    spark.createDataFrame([(i, [1.0, float(i % 7)], "x" if i % 3 else "y") for i in range(60)], "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = QUERIES["retrieval_metrics"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "collect_list(vec_id" in line]


def test_ask_ranked_walks_as_far_as_configured(spark, tmp_path):
    from lorequarry.queries import QUERIES

    spark.createDataFrame([("c1", "d", "Nothing of note.", "wiki", "f.md", 1, None)], "chunk_id string, document_id string, text string, source_type string, file_name string, page int, section string").write.parquet(f"{tmp_path}/text_chunks.parquet")
    facts = [("House Aldermoor", "HAS", "Bela Kun", "c1", "first fact"), ("Bela Kun", "MET", "Edda Holt", "c2", "second fact"), ("Edda Holt", "SAW", "Iron Gate", "c3", "third fact"), ("Iron Gate", "IS", "Old", "c4", "fourth fact")]
    spark.createDataFrame([(*f, "d", "wiki", 1) for f in facts], "subject string, predicate string, object string, chunk_id string, evidence string, document_id string, source_type string, loaded_at int").write.parquet(f"{tmp_path}/claims.parquet")
    spark.createDataFrame([("q1", "Who ruled House Aldermoor?")], "qid string, question string").write.parquet(f"{tmp_path}/eval_items.parquet")
    found = {r.text for r in QUERIES["ask_ranked"](spark, str(tmp_path)).filter("kind = 'graph'").collect()}
    assert found == {"first fact", "second fact", "third fact"}


def test_one_call_for_each_prompt(spark, tmp_path):
    calls = tmp_path / "calls"

    class Counting:
        def generate(self, prompt, temperature=0.1):
            with open(calls, "a") as f:
                f.write("relations\n" if '"relations"' in prompt else "names\n")
            if "fails" in prompt:
                raise TimeoutError("slow")
            if "refused" in prompt:
                raise ValueError("no key")
            return '{"relations": [{"subject": "A", "predicate": "P", "object": "B"}], "entities": []}'

    rows = [("c1", "d", "w", "long enough " * 10), ("c1", "d", "w", "long enough " * 10), ("c2", "d", None, "this fails " * 10), ("c3", "d", None, "is refused " * 10)]
    claims, listed = answers.extract_claims(spark.createDataFrame(rows, "chunk_id string, document_id string, source_type string, text string"), Counting(), attempts=2, first_wait=0.0)
    got = sorted((r.chunk_id, r.subject, r.error) for r in claims.collect())
    assert got == [("c1", "A", None), ("c2", None, "TimeoutError: slow"), ("c3", None, "ValueError: no key")] and claims.count() == 3 and listed.count() == 0
    lines = calls.read_text().split()
    # One call for a good prompt and for one that is refused, two for one that fails.
    assert lines.count("relations") == lines.count("names") == 4


def test_engine_tables_are_stored(spark, tmp_path):
    rows = [("c1", "d", "Anna Roe ruled House Aldermoor beside Bela Kun for years.", "wiki"), ("c2", "d", "Bela Kun fought the Iron Order at the river gate.", "chronicle")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, text string, source_type string")
    asked = spark.createDataFrame([("q1", "Who stood beside Anna Roe?")], "qid string, question string")
    engine = Engine(chunks)
    want = sorted(map(tuple, engine.retrieve(asked).collect()))
    assert engine.vectors() is engine.vectors()
    engine.save(str(tmp_path / "store"))
    loaded = Engine.load(spark, str(tmp_path / "store"), with_claims=False)
    assert sorted(map(tuple, loaded.retrieve(asked).collect())) == want and want
    loaded.upsert(spark.createDataFrame([("c2", "d", "Clara Ford met Anna Roe.", "wiki"), ("c3", "e", "Bela Kun saw Anna Roe.", None)], chunks.schema))
    assert {r.chunk_id for r in loaded.vectors().collect()} == {"c1", "c2", "c3"} and {r.chunk_id: r.entities for r in loaded.names().collect()}["c2"] == ["Anna Roe", "Clara Ford"]
    assert {(r.a, r.b) for r in loaded.name_edges().collect()} >= {("Anna Roe", "Clara Ford"), ("Anna Roe", "Bela Kun")}


def test_a_cluster_needs_a_shared_folder():
    from lorequarry.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(Session())
