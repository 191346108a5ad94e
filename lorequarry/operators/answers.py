"""Contexts, prompts, citations and the language model boundary."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.functions.text import first_filled, salvage_json
from lorequarry.session import cut_lineage


class LLM(Protocol):
    """What answers a prompt. Services plug in here."""

    def generate(self, prompt: str, temperature: float = 0.1) -> str: ...


class EchoLLM:
    """An offline stand-in: answers with the first block of evidence in the prompt."""

    def generate(self, prompt: str, temperature: float = 0.1) -> str:
        at = prompt.find("[E1]") if "[E1]" in prompt else prompt.find("[Evidence 1]")
        return prompt[at : prompt.find("\n\n", at)] if at >= 0 else "No evidence."


def with_retries(call: Callable[[], str], attempts: int = 5, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Call until it succeeds, with waits that double; the last error is raised, and at once a ValueError: what is wrong with a request or its settings stays wrong."""
    for attempt in range(attempts):
        try:
            return call()
        except ValueError:
            raise
        except Exception:
            if attempt == attempts - 1:
                raise
            sleep(first_wait * 2**attempt)
    raise ValueError("attempts must be positive")


def evidence_context(evidence: DataFrame, group: str = "qid", most: int = 15) -> DataFrame:
    """(group, context, evidence_count): numbered blocks of the first items with chunk, document, source and text."""
    unknown = lambda c: F.coalesce(first_filled(F.col(c)), F.lit("unknown"))
    first = evidence.filter(F.col("ord") <= most)
    block = F.concat(F.lit("[Evidence "), F.col("ord").cast("string"), F.lit("]\nchunk: "), F.coalesce("chunk_id", F.lit("")), F.lit("\ndocument: "), unknown("document_id"), F.lit("\nsource: "), unknown("source_type"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"), F.count("*").cast("int").alias("evidence_count"))


def cited_context(evidence: DataFrame, group: str = "qid") -> DataFrame:
    """(group, context): blocks marked [E1], [E2]... with chunk, file, page and source type; a page 0 counts as none."""
    page = F.nullif(F.col("page"), F.lit(0))
    head = F.concat(F.lit("[E"), F.col("rank").cast("string"), F.lit("] chunk_id="), F.coalesce("chunk_id", F.lit("")), F.lit("; source="), F.coalesce(first_filled(F.col("file_name")), F.lit("unknown")), F.coalesce(F.concat(F.lit(", page "), page.cast("string")), F.lit("")), F.lit("; source_type="), F.coalesce(first_filled(F.col("source_type")), F.lit("unknown")))
    block = F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")))
    return evidence.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def citations(evidence: DataFrame, group: str = "qid") -> DataFrame:
    """(group, marker, chunk_id, document_id, file_name, page, section, source_type) of ranked evidence; empty values count as missing."""
    filled = lambda c: first_filled(F.col(c)).alias(c)
    return evidence.select(group, F.concat(F.lit("E"), F.col("rank").cast("string")).alias("marker"), filled("chunk_id"), filled("document_id"), filled("file_name"), F.nullif(F.col("page"), F.lit(0)).alias("page"), filled("section"), filled("source_type"))


def grounded_prompt(question: Column, seed: Column, names: Column, context: Column, most: int = 12) -> Column:
    """A prompt that holds an answer to the evidence, in three parts."""
    return F.concat(
        F.lit("Answer the question from the evidence alone. If it does not suffice, say what is missing.\n\nQuestion: "), question, F.lit("\nSubject: "), seed,
        F.lit("\nRelated names: "), F.array_join(F.slice(names, 1, most), ", "), F.lit("\n\nEvidence:\n"), context,
        F.lit("\n\nWrite three parts: 'Answer', 'Reasons' and 'Evidence used', naming the numbers of the evidence.\n"),
    )


def cited_prompt(question: Column, context: Column) -> Column:
    """A prompt that asks for marks of evidence in the answer and for disagreements between sources."""
    return F.concat(F.lit("Answer the question from the evidence below. Mark each statement with its evidence, like [E1]. Where sources disagree, say so and name both.\n\nQuestion: "), question, F.lit("\n\n"), context, F.lit("\n"))


def generate(df: DataFrame, key: str, prompt_col: str, llm: LLM | None = None, temperature: float = 0.1, attempts: int = 5, first_wait: float = 1.0) -> DataFrame:
    """(key, reply, error): the model's reply to each prompt; a call that fails again after its retries becomes an error, not the end of the job."""
    llm = llm or EchoLLM()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, prompt in zip(batch["key"], batch["prompt"]):
                try:
                    out.append((k, with_retries(lambda prompt=prompt: llm.generate(prompt, temperature), attempts, first_wait), None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["key", "reply", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(prompt_col).alias("prompt")).mapInPandas(run, f"key {kind}, reply string, error string").withColumnRenamed("key", key)


ENTITY_SCHEMA = "entities array<struct<name:string,type:string>>"
RELATION_SCHEMA = "relations array<struct<subject:string,predicate:string,object:string,evidence:string>>"


#: The kinds of names in the JSON reply are fixed values.
def extraction_prompts(text: Column) -> tuple[Column, Column]:
    """Prompts for the names and the relations of a passage, to be answered in JSON."""
    names = F.concat(F.lit('List the names in the passage as JSON {"entities": [{"name": ..., "type": PERSON|FACTION|EVENT|PLACE|ARTIFACT|OBJECT|OTHER}]}.\n\nPassage:\n'), text)
    relations = F.concat(F.lit('List what the passage states as JSON {"relations": [{"subject": ..., "predicate": UPPER_SNAKE_CASE, "object": ..., "evidence": ...}]}.\n\nPassage:\n'), text)
    return names, relations


def parsed_claims(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """One claim for each relation of a JSON reply, with the other columns of its row; missing lists give none, missing evidence ''.

    A relation without subject, predicate or object fails in ``error`` and gives no names.
    """
    rest = [c for c in replies.columns if c != reply_col]
    rows = replies.select(*rest, F.explode(salvage_json(F.col(reply_col), RELATION_SCHEMA)["relations"]).alias("r"))
    whole = F.col("r.subject").isNotNull() & F.col("r.predicate").isNotNull() & F.col("r.object").isNotNull()
    return rows.select(*rest, *[F.when(whole, F.col(f"r.{c}")).alias(c) for c in ("subject", "predicate", "object")], F.coalesce("r.evidence", F.lit("")).alias("evidence"), F.when(~whole, "incomplete relation").alias("error"))


def extract_claims(chunks: DataFrame, llm: LLM | None = None, least: int = 100, attempts: int = 5, first_wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(claims, names) that a model finds in the chunks of at least ``least`` characters; a failed or unreadable reply is a row with an error.

    Both prompts of a chunk are answered once, where the chunk stands, and the replies are written before they are read; a chunk
    delivered again counts once.
    """
    rows = chunks.filter(F.length(F.trim("text")) >= least).dropDuplicates(["chunk_id"])
    names, relations = extraction_prompts(F.col("text"))
    asked = rows.select(F.struct("chunk_id", "document_id", "source_type").alias("of"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("prompt")) for k, p in (("relations", relations), ("names", names))])).alias("p"))
    replies = cut_lineage(generate(asked.select(F.struct("of.*", "p.kind").alias("key"), "p.prompt"), "key", "prompt", llm, 0.0, attempts, first_wait).select("key.*", "reply", "error"))
    found = replies.filter("kind = 'relations'").drop("kind")
    failed = found.filter("error IS NOT NULL").select("chunk_id", "document_id", "source_type", *[F.lit(None).cast("string").alias(c) for c in ("subject", "predicate", "object")], F.lit("").alias("evidence"), "error")
    claims = parsed_claims(found.filter("error IS NULL").drop("error")).unionByName(failed)
    called = replies.filter("kind = 'names'")
    listed = called.select("chunk_id", F.explode(salvage_json(F.col("reply"), ENTITY_SCHEMA)["entities"]).alias("e")).select("chunk_id", "e.name", "e.type")
    return claims, listed
