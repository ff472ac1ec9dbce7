"""Audit of a case by strategies behind an injected model: prompts go out, parsed answers come back as rows."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import written
from tessera.operators.matching import merged
from tessera.operators.sampling import PRICES

log = logging.getLogger(__name__)

CLAIMS = "array<struct<subject: string, predicate: string, object: string, confidence: double>>"
FINDINGS = "array<struct<doc_a: string, doc_b: string, evidence: string, confidence: double>>"
DETECTION = "case_id string, ord bigint, refs array<string>, evidence string, confidence double, scope string"


def answered(prompts: DataFrame, model: Callable[[str], tuple[str | None, str | None]]) -> DataFrame:
    """``prompts`` (key columns and prompt) with ``answer`` and ``error``; an exception is that row's error."""
    kinds = [(f.name, f.dataType.simpleString()) for f in prompts.schema.fields]

    def ask(p):
        try:
            return model(p)
        except Exception as e:  # a failed call loses its row, not the job
            return None, str(e)

    def run(batches):
        for batch in batches:
            got = [ask(p) for p in batch.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=[*batch.schema.names, "answer", "error"])

    return prompts.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds) + ", answer string, error string")


class Busy(Exception):
    """What a client raises when it is asked too often."""


class Client:
    """Calls of a model that try again: after ``Busy`` with long waits, after an answer without choices with short ones; other errors end the call.

    ``ask(prompt)`` gives (text, prompt tokens, completion tokens), or None for an answer without choices; a null text
    is an error. Calls give (text, error), as ``answered`` takes them; ``metered`` gives the tokens too.
    """

    # Seconds of the first wait, and the longest.
    BUSY, EMPTY = (30, 300), (1, 60)

    def __init__(self, ask: Callable[[str], tuple[str | None, int, int] | None], retries: int = 20, sleep: Callable[[float], None] = time.sleep):
        self.ask, self.retries, self.sleep = ask, retries, sleep

    def metered(self, prompt: str) -> tuple[str | None, str | None, int, int]:
        for attempt in range(self.retries + 1):
            try:
                got = self.ask(prompt)
            except Busy as e:
                error, (wait, most) = f"rate limit exceeded after {self.retries} retries: {e}", self.BUSY
            except Exception as e:
                return None, f"error of the model: {e}", 0, 0
            else:
                if got is not None:
                    text, told, written_ = got
                    return (text, None, told, written_) if text is not None else (None, "empty content", 0, 0)
                error, (wait, most) = "no choices", self.EMPTY
            if attempt < self.retries:
                self.sleep(min(wait * 2**attempt, most))
        return None, error, 0, 0

    def __call__(self, prompt: str) -> tuple[str | None, str | None]:
        return self.metered(prompt)[:2]


def metered(prompts: DataFrame, client: Client) -> DataFrame:
    """``prompts`` with ``answer``, ``error`` and the tokens of each call, which are the rows' own and so add up over any number of executors."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(batches):
        for batch in batches:
            got = list(zip(*map(client.metered, batch.column("prompt").to_pylist()), strict=True)) or [()] * 4
            new = [pa.array(x, k) for x, k in zip(got, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "answer", "error", "prompt_tokens", "completion_tokens"])

    return prompts.mapInArrow(run, f"{kinds}, answer string, error string, prompt_tokens bigint, completion_tokens bigint")


def usage_summary(calls: DataFrame) -> DataFrame:
    """One row: tokens of all calls and their cost at the default prices."""
    p, c = (F.coalesce(F.sum(x), F.lit(0)) for x in ("prompt_tokens", "completion_tokens"))
    x = calls.agg(p.alias("prompt_tokens"), c.alias("completion_tokens"))
    cost = F.col("prompt_tokens") / 1e6 * PRICES["default"][0] + F.col("completion_tokens") / 1e6 * PRICES["default"][1]
    return x.select("prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.round(cost, 6).alias("cost"))


def dry_run(prompts: DataFrame, model: str = "default") -> DataFrame:
    """``prompts`` with the ``estimate`` that stands in for an answer: a token for four characters, priced as input in decimals, halves up; no call is made."""
    tokens = F.floor(F.length("prompt") / 4)
    price = F.lit(Decimal(str(PRICES.get(model, PRICES["default"])[0])) / 1_000_000).cast("decimal(18,9)")
    cost = F.round(tokens.cast("decimal(18,0)") * price, 4).cast("string")
    return prompts.withColumn("estimate", F.concat(F.lit("Dry run: "), tokens.cast("string"), F.lit(" input tokens, $"), cost))


def parsed(rows: DataFrame, kind: str) -> DataFrame:
    """Adds ``items``: the answer's JSON, outside a code fence if there is one; rows with errors or other text have null."""
    bare = F.regexp_replace(F.trim("answer"), "(?s)^```(?:json)?\\s*|\\s*```$", "")
    return rows.withColumn("items", F.when(F.col("error").isNull(), F.from_json(bare, kind)))


def claims(docs: DataFrame, model) -> DataFrame:
    """(case_id, doc_ord, claim_id, subject, ...) numbered through a case in order of documents and claims; confidence within 0 and 1, 0.5 if missing."""
    rows = parsed(answered(docs.select("case_id", "doc_ord", F.concat(F.lit("List the claims as JSON:\n"), "content").alias("prompt")), model), CLAIMS)
    each = rows.select("case_id", "doc_ord", F.posexplode("items").alias("pos", "c"))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("doc_ord", "pos")) - 1
    sure = F.least(F.greatest(F.coalesce("c.confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return each.select("case_id", "doc_ord", F.format_string("claim_%04d", number).alias("claim_id"), "c.subject", "c.predicate", "c.object", sure.alias("confidence"))


def detections(rows: DataFrame, order: list[str]) -> DataFrame:
    """Detections of parsed findings: one reference is within a document, two are across, none is dropped."""
    each = rows.select("case_id", *order, F.posexplode("items").alias("pos", "f"))
    refs = F.filter(F.array("f.doc_a", "f.doc_b"), lambda x: F.coalesce(x, F.lit("")) != "")
    number = F.row_number().over(Window.partitionBy("case_id").orderBy(*order, "pos")) - 1
    sure = F.least(F.greatest(F.coalesce("f.confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    out = each.select("case_id", number.cast("bigint").alias("ord"), refs.alias("refs"), F.col("f.evidence").alias("evidence"), sure.alias("confidence"))
    return out.where(F.size("refs") > 0).withColumn("scope", F.when(F.size("refs") > 1, "inter_doc").otherwise("intra_doc"))


def by_graph(docs: DataFrame, model) -> DataFrame:
    """One question a case over all its claims."""
    told = claims(docs, model).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "subject", "predicate", "object"))), lambda c: F.concat_ws(" ", c["claim_id"], c["subject"], c["predicate"], c["object"])), "\n").alias("c"))
    return detections(parsed(answered(told.select("case_id", F.concat(F.lit("Find anomalies as JSON:\n"), "c").alias("prompt")), model), FINDINGS), [])


def by_reasoning(docs: DataFrame, model) -> DataFrame:
    """A question for each pair of a case's documents that have claims; each pair is a call, so all pairs are made."""
    told = claims(docs, model).groupBy("case_id", "doc_ord").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "subject", "predicate", "object"))), "\n").alias("c"))
    a, b = told.select("case_id", F.col("doc_ord").alias("a"), F.col("c").alias("ca")), told.select("case_id", F.col("doc_ord").alias("b"), F.col("c").alias("cb"))
    pairs = a.join(b, "case_id").where("a < b").select("case_id", "a", "b", F.concat(F.lit("Compare as JSON:\n"), "ca", F.lit("\n---\n"), "cb").alias("prompt"))
    return detections(parsed(answered(pairs, model), FINDINGS), ["a", "b"])


def none(docs: DataFrame, model=None) -> DataFrame:
    """The null strategy: no detections."""
    return docs.sparkSession.createDataFrame([], DETECTION)


def mode(graph, reasoning) -> str:
    """Which kind of audit two strategies make."""
    if (graph is none) == (reasoning is none):
        return "hybrid"
    return "agentic" if graph is none else "graph_native"


def tried(strategy, docs: DataFrame, model) -> DataFrame:
    """A strategy's detections, written so that its errors show here; one that fails gives none and is logged."""
    try:
        return written(strategy(docs, model).select("case_id", "ord", "refs", "confidence"))
    except Exception as e:  # the other strategy's detections still count
        log.warning("strategy %s failed: %s", getattr(strategy, "__name__", strategy), e)
        return none(docs).select("case_id", "ord", "refs", "confidence")


def audit(docs: DataFrame, model, graph=by_graph, reasoning=by_reasoning) -> DataFrame:
    """Both strategies' detections merged by reference set; a strategy that fails has none."""
    return merged(tried(graph, docs, model), tried(reasoning, docs, model), ["case_id"]).withColumn("mode", F.lit(mode(graph, reasoning)))


def until_passed(step: Callable[[int], dict[str, DataFrame]], gates: Callable[[dict[str, DataFrame]], DataFrame], most: int) -> tuple[dict[str, DataFrame], DataFrame, int]:
    """Runs ``step`` (given the round from 1) until every gate (passed) of its tables holds, at most ``most`` times; gives the last tables, their gates and the rounds. Gates are a handful of rows, written once a round; what a step has finished it may keep in its own tables."""
    if most < 1:
        raise ValueError("at least one round")
    for i in range(1, most + 1):
        tables = step(i)
        found = written(gates(tables))
        if found.where("not passed").limit(1).count() == 0:
            break
    return tables, found, i
