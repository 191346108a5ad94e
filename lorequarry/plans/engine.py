"""The two ways from questions to evidence, as plans over tables: one plan serves one question or many."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorequarry.config import EngineConfig
from lorequarry.functions.entities import analysed_entities, seed_entity
from lorequarry.operators import answers, graph, retrieval
from lorequarry.operators.vectors import Embedder, HashingEmbedder, embed, nearest
from lorequarry.session import cut_lineage
from lorequarry.sources.sinks import upsert


class BadRequest(ValueError):
    """A blank question."""


class NotFound(LookupError):
    """No evidence for a question."""


@dataclass
class Answer:
    question: str
    seed_entity: str
    answer: str
    evidence_count: int


class Engine:
    """Holds the tables of an archive: chunks, claims, and what is derived from them, which is made once and stored.

    Names, their co-occurrence, vectors and claim edges are written when they are first asked for; ``save`` and ``load`` keep
    them for other sessions, so a question reads them and derives nothing from the archive.
    """

    def __init__(self, chunks: DataFrame, claims: DataFrame | None = None, config: EngineConfig | None = None, embedder: Embedder | None = None, llm: answers.LLM | None = None):
        self.config = config or EngineConfig()
        self.embedder = embedder or HashingEmbedder(self.config.dimensions)
        self.llm = llm or answers.EchoLLM()
        self.chunks = chunks.dropDuplicates(["chunk_id"])
        self.claims = claims
        self._stored: dict[str, DataFrame] = {}

    @staticmethod
    def health() -> dict[str, str]:
        return {"status": "ok"}

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = cut_lineage(make())
        return self._stored[name]

    def names(self) -> DataFrame:
        return self._kept("names", lambda: graph.chunk_entities(self.chunks))

    def name_edges(self) -> DataFrame:
        return self._kept("name_edges", lambda: graph.cooccurrence(self.names()))

    def vectors(self) -> DataFrame:
        return self._kept("vectors", lambda: embed(self.chunks, "chunk_id", "text", self.embedder))

    def claim_edges(self) -> DataFrame:
        key = F.concat_ws("\u0001", "subject", "predicate", "object", "chunk_id")
        return self._kept("claim_edges", lambda: graph.claim_graph(self.claims).withColumn("edge_id", key))

    def save(self, path: str) -> None:
        """Write all tables under ``path``."""
        tables = {"chunks": self.chunks, "names": self.names(), "name_edges": self.name_edges(), "vectors": self.vectors()}
        if self.claims is not None:
            tables |= {"claims": self.claims, "claim_edges": self.claim_edges()}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, with_claims: bool = True, config: EngineConfig | None = None, embedder: Embedder | None = None, llm: answers.LLM | None = None) -> Engine:
        """An engine on the tables that ``save`` wrote; the embedder must be the one they were made with."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        engine = cls(read("chunks"), read("claims") if with_claims else None, config, embedder, llm)
        engine._stored = {name: read(name) for name in ("names", "name_edges", "vectors", *(("claim_edges",) if with_claims else ()))}
        return engine

    def upsert(self, chunks: DataFrame) -> None:
        """New and changed chunks take the places of those with the same id, in the vectors and in the names too."""
        fresh = Engine(chunks, None, self.config, self.embedder)
        names, vectors = upsert(self.names(), fresh.names(), ["chunk_id"]), upsert(self.vectors(), fresh.vectors(), ["chunk_id"])
        self.chunks = cut_lineage(upsert(self.chunks, fresh.chunks.select(*self.chunks.columns), ["chunk_id"]))
        self._stored |= {"names": cut_lineage(names), "vectors": cut_lineage(vectors)}
        self._stored.pop("name_edges", None)

    def seeds(self, questions: DataFrame) -> DataFrame:
        """(qid, question, seed) of the questions that are not blank."""
        return questions.select("qid", F.trim("question").alias("question")).filter("question <> ''").withColumn("seed", seed_entity(F.col("question")))

    def queries(self, questions: DataFrame) -> DataFrame:
        """(qid, question, seed, neighbours, query_ord, query_id, query): the question and its expansions by names beside its seed."""
        asked = self.seeds(questions)
        near = graph.graph_neighbours(asked.select("seed"), graph.mentions(self.names()).select("entity"), self.name_edges(), self.config.neighbour_limit)
        near = near.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("neighbours"))
        asked = asked.join(near, "seed", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))
        chosen = retrieval.expansion_names(F.col("neighbours"), most=self.config.expansions)
        rows = asked.select("qid", "question", "seed", "neighbours", F.posexplode(retrieval.expanded_queries(F.col("question"), chosen)).alias("query_ord", "query"))
        return cut_lineage(rows.withColumn("query_id", F.concat_ws("#", "qid", "query_ord")))

    def _hits(self, queries: DataFrame, k: int) -> DataFrame:
        asked = embed(queries, "query_id", "query", self.embedder, is_query=True)
        hits = nearest(asked, self.vectors(), k, "query_id", "chunk_id")
        return hits.join(queries.select("query_id", "qid", "query_ord"), "query_id")

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """(qid, ord, chunk_id, query_ord, rank, score, text, document_id, source_type): evidence in order of first sight."""
        fused = retrieval.fuse_first_seen(self._hits(self.queries(questions), self.config.vector_top_k))
        return fused.join(self.chunks.select("chunk_id", "text", "document_id", "source_type"), "chunk_id")

    def ask_batch(self, questions: DataFrame) -> DataFrame:
        """(qid, question, seed_entity, prompt, evidence_count) of every question with evidence."""
        asked = self.queries(questions)
        fused = retrieval.fuse_first_seen(self._hits(asked, self.config.vector_top_k)).join(self.chunks.select("chunk_id", "text", "document_id", "source_type"), "chunk_id")
        context = answers.evidence_context(fused, most=self.config.context_items)
        prompt = answers.grounded_prompt(F.col("question"), F.col("seed"), F.col("neighbours"), F.col("context"), self.config.prompt_neighbours)
        return asked.filter("query_ord = 0").join(context, "qid").select("qid", "question", F.col("seed").alias("seed_entity"), prompt.alias("prompt"), "evidence_count")

    def ask(self, question: str) -> Answer:
        """Answer one question; BadRequest for a blank one, NotFound without evidence."""
        if not question.strip():
            raise BadRequest("the question is blank")
        one = self.chunks.sparkSession.createDataFrame([("q", question.strip())], "qid string, question string")
        row = self.ask_batch(one).first()
        if row is None:
            raise NotFound("no evidence")
        return Answer(row.question, row.seed_entity, answers.with_retries(lambda: self.llm.generate(row.prompt)), row.evidence_count)

    def retrieve_modular(self, questions: DataFrame, top_k: int | None = None, max_hops: int | None = None, final_k: int | None = None) -> DataFrame:
        """Ranked evidence from vectors and from trails in the claim graph: (qid, rank, kind, text, chunk_id, ..., final_score)."""
        c = self.config
        asked = questions.select("qid", F.trim("question").alias("question")).filter("question <> ''")
        direct = asked.select("qid", F.col("qid").cast("string").alias("query_id"), F.lit(0).alias("query_ord"), F.col("question").alias("query"))
        hits = self._hits(direct, top_k or c.vector_top_k).join(self.chunks.select("chunk_id", "text", "document_id", "source_type"), "chunk_id")
        vector = hits.select("qid", (F.col("rank") - 1).cast("long").alias("ord"), F.lit("vector").alias("kind"), "text", "chunk_id", "document_id", "source_type", F.lit(None).cast("string").alias("predicate"), "score")
        evidence = vector
        if self.claims is not None:
            edges = self.claim_edges()
            wanted = asked.select("qid", F.explode(analysed_entities(F.col("question"))).alias("name"))
            found = graph.search_entities(edges, wanted.select("name").distinct(), c.entity_limit)
            seeds = cut_lineage(wanted.join(found, "name").select("qid", F.col("entity").alias("seed")).distinct())
            paths = graph.trails(edges, seeds.select("seed"), max_hops or c.max_hops, c.path_limit)
            facts = graph.graph_evidence(graph.with_relationships(paths, edges)).join(seeds, "seed")
            place = F.row_number().over(Window.partitionBy("qid").orderBy("seed", "ord"))  # behind all hits, in one order for all seeds
            facts = facts.select("qid", (F.lit(1_000_000).cast("long") + place).alias("ord"), F.lit("graph").alias("kind"), "text", "chunk_id", "document_id", "source_type", "predicate", "score")
            evidence = vector.unionByName(facts)
        ranked = retrieval.rank_evidence(retrieval.merge_evidence(evidence), final_k or c.final_top_k, table=c.authority)
        return ranked.join(self.chunks.select("chunk_id", "file_name", "page", "section"), "chunk_id", "left")

    def ask_modular(self, question: str, top_k: int = 10, max_hops: int = 3, final_k: int = 8) -> dict:
        """(question, answer, citations, evidence) for one question."""
        if not question.strip():
            raise BadRequest("the question is blank")
        one = self.chunks.sparkSession.createDataFrame([("q", question.strip())], "qid string, question string")
        ranked = self.retrieve_modular(one, top_k, max_hops, final_k).cache()
        context = answers.cited_context(ranked).first()
        if context is None:
            raise NotFound("no evidence")
        prompt = one.select(answers.cited_prompt(F.col("question"), F.lit(context.context)).alias("p")).first().p
        out = {"question": question, "answer": answers.with_retries(lambda: self.llm.generate(prompt)), "citations": [r.asDict() for r in answers.citations(ranked).collect()], "evidence": [r.asDict() for r in ranked.orderBy("rank").collect()]}
        ranked.unpersist()
        return out
