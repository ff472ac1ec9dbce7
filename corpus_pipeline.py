"""Training-data pipeline over ``documents``: the stages' order is fixed, each reads what the one before wrote."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, mixing, packing, pii, toxicity
from tessera.llm.common import sized, table, written


#: The columns that stages work on.
OWN = ["doc_id", "text", "lang", "source", "n_chars"]


def set_aside(stage):
    """``stage`` with columns besides those of documents in one struct while it runs, so that none of their names can clash with one that it adds, uses or drops; they come back as they were."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in OWN]
        if not others:
            return stage(spark, docs, sf_dir)
        name = "set_aside"
        held = docs.select(*[c for c in docs.columns if c in OWN], F.struct(*[F.col(f"`{c}`") for c in others]).alias(name))
        out = stage(spark, held, sf_dir)
        return out.select(*[F.col(name).getField(c).alias(c) if c in others else F.col(c) for c in docs.columns])

    return run


@set_aside
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, by a lexicon learned from them and ``labels``.

    Null and empty texts and those with a null doc_id are scored like any other and have no match, so they stay; rows
    that repeat are kept or dropped alike; without labels nothing is dropped; no documents give none; columns besides
    those of documents pass through, whatever their names.
    """
    lexicon = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, lexicon).where("predicted = 0").select(docs.columns)


@set_aside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, the first as the rows come.

    Rows are told apart by number, for a doc_id can be null or repeat: of equal rows one stays, and of two texts with
    one doc_id each is judged by itself. Null, empty and wordless texts are like no other and all stay; no documents
    give none; columns besides those of documents pass through, whatever their names.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    dropped = written(found.where("not kept").select(F.col("doc_id").alias("_row")))
    return rows.join(sized(dropped), "_row", "left_anti").select(docs.columns)


@set_aside
def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced in the text; ``n_chars`` follows.

    Null texts stay null, with a null n_chars; rows that repeat stay and are treated alike; no documents give none;
    columns besides those of documents pass through, whatever their names.
    """
    clean = pii.sanitised(docs).withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(docs.columns)


@set_aside
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its budget, again for each epoch that they are chosen in.

    Null texts are empty, null sources and languages a leaf of their own, as ``mixing.mixed`` defines; rows that repeat
    are each a document; no documents give none; columns besides those of documents pass through, whatever their names.
    """
    return mixing.mixed(docs).select(docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in fixed-length sequences. Null and empty texts are one token; a row that repeats, as mixing makes them, is packed each time; no documents give none."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_filter), ("near_duplicates", near_duplicates), ("sanitisation", sanitisation), ("mixing", source_mixing), ("packing", sequence_packing)]
#: SQL can't express stages 1, 2 and 5; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; the others' results are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
