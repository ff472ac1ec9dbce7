"""Folders of datasets: discovery, their labels and graphs, validation, totals and versioned packages. Files are listed and read by Spark, so any path that it opens will do."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tessera.functions.lineage import numbered
from tessera.sources.corpus import CLAIM, DOCUMENT, DOMAINS, LABEL
from tessera.sources.versions import committed

LINK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("xref_id", "reference_id", "id", "source_claim", "target_claim", "from_claim", "to_claim", "relationship_type", "relationship", "rationale", "description")]
    + [T.StructField("claim_ids", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())]
)
CLUSTER = T.StructType([*[T.StructField(n, T.StringType()) for n in ("cluster_id", "id", "relation", "theme")], T.StructField("claim_ids", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())])
GRAPH = T.StructType([T.StructField("claims", T.ArrayType(CLAIM)), T.StructField("cross_references", T.ArrayType(LINK)), T.StructField("claim_clusters", T.ArrayType(CLUSTER))])
NODE = T.StructType([*[T.StructField(n, T.StringType()) for n in ("id", "entity_type", "canonical_name")], T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("subcorpus_memberships", T.ArrayType(T.StringType()))])
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "target", "relationship_type")])
ENTITY_GRAPH = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])
# Where a dataset keeps its files, and what its metadata has to name.
GRAPH_FILE, GOLD_FILE, ALL_FILE = "metadata/knowledge_graph.json", "gold_labels.jsonl", "all_contradictions.jsonl"
LEGACY = {"graph": "gold/entity_graph.json", "labels": "gold/gold_incoherence_labels.json", "distractors": "gold/gold_distractor_labels.json", "metadata": "metadata.json"}
REQUIRED = ["benchmark_version", "master_seed"]


def files(spark: SparkSession, *globs: str) -> DataFrame:
    """(path) of the files that match any of the globs; contents aren't read. A glob without a match gives none."""
    out = spark.createDataFrame([], "path string")
    for g in globs:
        try:
            out = out.union(spark.read.format("binaryFile").load(g).select("path"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def whole(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of whole text files; none where the glob has no match."""
    try:
        return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame([], "path string, content string")


def lines(spark: SparkSession, glob: str) -> DataFrame:
    """(path, line, value): lines of text files in order; none where the glob has no match."""
    try:
        return spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), "value")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame([], "path string, line bigint, value string")


def part(path: Column, back: int) -> Column:
    """A part of a path, counted from its end (1: the file's name)."""
    return F.element_at(F.split(path, "/"), -back)


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, path): the root, if one of its folders holds a graph of claims, else each of its folders of which that is so."""
    root = root.rstrip("/")
    found = files(spark, f"{root}/*/{GRAPH_FILE}")
    if found.limit(1).count() == 0:
        found = files(spark, f"{root}/*/*/{GRAPH_FILE}")
    parts = F.split("path", "/")
    return found.select(part(F.col("path"), 4).alias("dataset"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), "/").alias("path")).distinct()


def graphs(spark: SparkSession, dataset: str) -> dict[str, DataFrame]:
    """Claims, cross references and clusters of a dataset's cases, with their case_id."""
    read = whole(spark, f"{dataset.rstrip('/')}/*/{GRAPH_FILE}").select(part(F.col("path"), 3).alias("case_id"), F.from_json("content", GRAPH).alias("g"))
    return {name: read.select("case_id", F.inline(f"g.{name}")) for name in GRAPH.names}


def contradictions(spark: SparkSession, dataset: str) -> DataFrame:
    """Labels of a dataset's cases: those of the gold file where a case has one, else of its other files but the one that holds all of them. A label without an ``id`` is numbered in order of case, file and line through the dataset."""
    rows = lines(spark, f"{dataset.rstrip('/')}/*/contradictions/*.jsonl").where("trim(value) <> ''").withColumns({"case_id": part(F.col("path"), 3), "file": part(F.col("path"), 1)})
    golden = rows.where(F.col("file") == GOLD_FILE).select("case_id", F.lit(True).alias("golden")).distinct()
    rows = rows.join(golden, "case_id", "left").where((F.col("file") == GOLD_FILE) | (F.col("golden").isNull() & (F.col("file") != ALL_FILE)))
    shape = T.StructType([T.StructField("id", T.StringType()), *LABEL.fields])
    own = numbered(rows, "case_id", "file", "line").withColumn("x", F.from_json("value", shape))
    return own.select("case_id", F.coalesce("x.id", F.concat(F.lit("c_"), F.col("i").cast("string"))).alias("id"), *[f"x.{n}" for n in LABEL.names])


def legacy(spark: SparkSession, dataset: str) -> dict[str, DataFrame]:
    """Nodes, edges, labels, distractors and documents of a dataset of the older layout; files that are missing give no rows."""
    top = dataset.rstrip("/")
    graph = whole(spark, f"{top}/{LEGACY['graph']}").select(F.from_json("content", ENTITY_GRAPH).alias("g"))
    shape = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), *LABEL.fields]))
    listed = lambda name: whole(spark, f"{top}/{LEGACY[name]}").select(F.inline(F.from_json("content", shape)))
    document = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "document_type", "subcorpus_id", "reliability_signal", "content")])
    docs = lines(spark, f"{top}/corpus/*.jsonl").select(F.from_json("value", document).alias("d")).select("d.*").where("id is not null")
    return {"nodes": graph.select(F.inline("g.nodes")), "edges": graph.select(F.inline("g.edges")), "labels": listed("labels"), "distractors": listed("distractors"), "documents": docs}


def label_fault(label: Column) -> Column:
    """The first field of a label that its schema refuses, or null."""
    return F.coalesce(*[F.when(~F.coalesce(label[c].isin(v), F.lit(False)), F.lit(c)) for c, v in DOMAINS.items()])


def validated(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, valid, errors, documents, entities, edges, labels, distractors) of each folder under a root in the older layout.

    What is missing, lines and labels that don't parse or lack a field, files that aren't JSON and metadata without a
    required key are errors; a folder without corpus, gold folder or metadata isn't looked into. Folders whose names
    begin with a dot are passed over. Nothing under the root gives no rows.
    """
    root = root.rstrip("/")
    at = len(root.split("://", 1)[-1].lstrip("/").split("/"))
    found = files(spark, f"{root}/*/*", f"{root}/*/*/*").select(F.split(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), "/").alias("p"))
    found = found.select(F.element_at("p", at + 1).alias("dataset"), F.array_join(F.slice("p", at + 2, 9), "/").alias("file")).where("not startswith(dataset, '.')")
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    there = found.groupBy("dataset").agg(
        has(F.startswith("file", F.lit("corpus/"))).alias("corpus"), has(F.startswith("file", F.lit("gold/"))).alias("gold"), has(F.col("file").rlike(r"^corpus/subcorpus_[^/]*\.jsonl$")).alias("lines"),
        *[has(F.col("file") == f).alias(f"has_{n}") for n, f in LEGACY.items()],
    )
    missing = F.array_compact(F.array(F.when(~F.col("corpus"), "missing corpus"), F.when(~F.col("gold"), "missing gold"), F.when(~F.col("has_metadata"), f"missing {LEGACY['metadata']}")))
    there = there.withColumn("missing", missing)
    sound = F.size("missing") == 0

    rows = lines(spark, f"{root}/*/corpus/subcorpus_*.jsonl").withColumns({"dataset": part(F.col("path"), 3), "file": part(F.col("path"), 1)})
    rows = numbered(rows, "path", "line")
    first = rows.groupBy("path").agg(F.min("i").alias("start"))
    doc = F.from_json("value", DOCUMENT)
    whole_doc = F.lit(True)
    for n in DOCUMENT.names:
        whole_doc &= doc[n].isNotNull()
    rows = rows.where("value <> ''").join(first, "path").select("dataset", F.when(whole_doc, 1).otherwise(0).alias("documents"), F.when(~whole_doc, F.concat_ws(" ", "file", F.lit("line"), (F.col("i") - F.col("start") + 1).cast("string"))).alias("fault"))
    docs = rows.groupBy("dataset").agg(F.sum("documents").alias("documents"), F.array_compact(F.array_sort(F.collect_list("fault"))).alias("doc_faults"))

    def json_file(name: str, shape: str | T.DataType, back: int) -> DataFrame:
        return whole(spark, f"{root}/*/{LEGACY[name]}").select(part(F.col("path"), back).alias("dataset"), F.try_parse_json("content").isNotNull().alias(f"{name}_json"), F.from_json("content", shape).alias(name))

    shape = T.ArrayType(LABEL)
    x = there.join(docs, "dataset", "left").join(json_file("graph", ENTITY_GRAPH, 3), "dataset", "left").join(json_file("labels", shape, 3), "dataset", "left").join(json_file("distractors", shape, 3), "dataset", "left")
    x = x.join(json_file("metadata", "map<string,string>", 2), "dataset", "left")
    faults = lambda name, bad: F.filter(F.transform(name, lambda y, i: F.when(bad(y), F.concat(F.lit(f"{name} "), i.cast("string")))), lambda y: y.isNotNull())
    broken = lambda name: F.when(~F.col(f"has_{name}"), f"missing {LEGACY[name]}").when(~F.coalesce(f"{name}_json", F.lit(False)), f"{LEGACY[name]} is not JSON")
    bad = {"labels": lambda y: label_fault(y).isNotNull(), "distractors": lambda y: ~F.coalesce(y["scope"].isin(DOMAINS["scope"]), F.lit(False))}
    none = F.array().cast("array<string>")
    deep = F.concat(
        F.array_compact(F.array(F.when(~F.col("lines"), "no lines of documents"), *[broken(n) for n in ("graph", "labels", "distractors", "metadata")], F.when(F.col("graph_json") & (F.col("graph.nodes").isNull() | F.col("graph.edges").isNull()), "graph without nodes or edges"))),
        F.coalesce("doc_faults", none), *[F.coalesce(faults(n, b), none) for n, b in bad.items()],
        F.when(F.col("metadata_json"), F.array_compact(F.array(*[F.when(~F.coalesce(F.array_contains(F.map_keys("metadata"), k), F.lit(False)), f"metadata without {k}") for k in REQUIRED]))).otherwise(none),
    )
    errors = F.when(sound, deep).otherwise(F.col("missing"))
    count = lambda c: F.when(sound, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint")
    good = lambda name: F.size(name) - F.size(faults(name, bad[name]))
    x = x.withColumn("errors", errors)
    return x.select("dataset", (F.size("errors") == 0).alias("valid"), "errors", count(F.col("documents")).alias("documents"), count(F.size("graph.nodes")).alias("entities"), count(F.size("graph.edges")).alias("edges"), count(good("labels")).alias("labels"), count(good("distractors")).alias("distractors"))


def shares(labels: DataFrame, field: str) -> DataFrame:
    """One row, a map from each value of a field to its share of the labels; a missing value counts as unknown."""
    n = labels.groupBy(F.coalesce(field, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    # A row for each value that a label's field may have.
    return n.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("m"), F.sum("n").alias("all")).select(F.transform_values("m", lambda _, v: v / F.col("all")).alias(field))


def manifest(docs: DataFrame, labels: DataFrame, distractors: DataFrame) -> DataFrame:
    """One row of a dataset's totals: cases and documents (case_id), labels by scope, distractors, and shares of mechanisms and of detectabilities."""
    a = docs.agg(F.countDistinct("case_id").alias("case_count"), F.count("*").alias("document_count"))
    b = labels.agg(F.count_if(F.col("scope") == "intra_doc").alias("intra_doc"), F.count_if(F.col("scope") == "inter_doc").alias("inter_doc"))
    c = distractors.agg(F.count("*").alias("distractor_count"))
    out = a.withColumn("_k", F.lit(1))
    for one in (b, c, shares(labels, "mechanism"), shares(labels, "detectability")):
        # Every side is a single row.
        out = out.join(one.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def corpus_totals(docs: DataFrame) -> DataFrame:
    """One row over documents (source_id, case_id, document_type): sources, cases, documents and the sorted types; a case is told by its source as well, a missing source is unknown."""
    source = F.coalesce("source_id", F.lit("unknown"))
    per = docs.groupBy(source.alias("source_id"), "case_id", "document_type").agg(F.count("*").alias("n"))
    return per.agg(F.countDistinct("source_id").alias("total_sources"), F.countDistinct(F.struct("source_id", "case_id")).alias("total_cases"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"), F.sort_array(F.collect_set("document_type")).alias("types"))


def case_types(docs: DataFrame) -> DataFrame:
    """(source_id, case_id, documents, types): documents of each case and a sorted map of their types."""
    per = docs.groupBy("source_id", "case_id", "document_type").agg(F.count("*").alias("n"))
    return per.groupBy("source_id", "case_id").agg(F.sum("n").alias("documents"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("document_type").isNotNull(), F.struct("document_type", "n"))))).alias("types"))


def write_package(tables: dict[str, DataFrame], path: str, version: str, base: str | None = None, params: dict | None = None) -> None:
    """A version of a dataset: its tables, its ``generation_params`` (rates of 0 where none are given) and its ``dataset_manifest``, which readers see once all are written. Tables are docs, labels and distractors, and any others; a version is written once."""
    spark = tables["docs"].sparkSession
    told = {"contradiction_rate_intra_doc": 0.0, "contradiction_rate_inter_doc": 0.0, "distractor_ratio": 0.0} | (params or {}) | {"version_id": version, "base_version": base}
    found = manifest(tables["docs"], tables["labels"], tables["distractors"]).withColumns({"version": F.lit(version), "base_version": F.lit(base).cast("string")})
    more = {"generation_params": spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1), "dataset_manifest": found.coalesce(1)}
    committed(tables | more, path, version, base, {"generation_params": "text", "dataset_manifest": "json"})


def backed_up(df: DataFrame, path: str) -> None:
    """A copy that is made once: where there is one already, it stays."""
    df.write.mode("ignore").parquet(path)
