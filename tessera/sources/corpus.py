"""Readers and writers of case directories, labels, claims, texts and versioned datasets, by any path that Spark opens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tessera.functions.lineage import numbered
from tessera.operators.ranges import first_range

DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("document_id", "source", "document_type", "source_case_id", "scope_classification", "content")])
LABEL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("scope", "mechanism", "detectability", "system_affinity", "difficulty")]
    + [T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("original_text", "modified_text", "rationale")]
    + [T.StructField("ground_truth", T.BooleanType()), T.StructField("document_references", T.ArrayType(T.StringType()))]
)
CLAIM = T.StructType([T.StructField(n, T.StringType()) for n in ("claim_id", "subject", "predicate", "object", "source_document")] + [T.StructField("confidence", T.DoubleType()), T.StructField("category", T.StringType())])
# What the enumerated fields of a label may hold.
DOMAINS = {
    "scope": ["intra_doc", "inter_doc"],
    "mechanism": ["numeric_drift", "entity_swap", "causal_inversion", "temporal_contradiction", "omission_based_implicit", "temporal_revision_conflict"],
    "detectability": ["single_hop", "multi_hop", "entity_resolution_dependent"],
    "difficulty": ["easy", "medium", "hard"],
}


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Rows of JSON lines with ``file`` (name) and ``line`` (their order there); malformed lines are left out, or fail if ``strict``; a path with no file gives no rows."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    except AnalysisException as e:
        if strict or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("file", T.StringType()), T.StructField("line", T.LongType())]))
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", wide, options).alias("row"), "file", "line")
    return rows.where("row._corrupt is null").select("row.*", "file", "line").drop("_corrupt")


def corpus(spark: SparkSession, case_dir: str) -> DataFrame:
    """A case's documents; a case without its folder is an error, as is one without files."""
    rows = json_lines(spark, f"{case_dir}/anonymized_docs/*.jsonl", DOCUMENT, strict=True)
    return rows.withColumn("case_id", F.lit(case_dir.rstrip("/").rsplit("/", 1)[-1]))


def last_by_id(docs: DataFrame) -> DataFrame:
    """Each document id once: of repeated ones the last, by file and line."""
    w = Window.partitionBy("document_id").orderBy(F.desc("file"), F.desc("line"))
    return docs.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of JSON files that hold them in an object's ``claims``."""
    wrapped = T.StructType([T.StructField("claims", T.ArrayType(CLAIM))])
    return spark.read.schema(wrapped).option("multiLine", True).json(path).select(F.inline("claims"))


def with_ids(labels: DataFrame, prefix: str = "c_") -> DataFrame:
    """Labels with an ``id``: their own, or a number in order of file and line."""
    own = F.col("id") if "id" in labels.columns else F.lit(None).cast("string")
    return numbered(labels, "file", "line").withColumn("id", F.coalesce(own, F.concat(F.lit(prefix), F.col("i").cast("string")))).drop("i")


def label_errors(labels: DataFrame) -> DataFrame:
    """``labels`` with ``errors``: the fields that break the schema; valid rows have none."""
    checks = [F.when(~F.coalesce(F.col(c).isin(v), F.lit(False)), F.lit(c)) for c, v in DOMAINS.items()]
    checks += [F.when(F.coalesce(F.col(c), F.lit(-1)) < 0, F.lit(c)) for c in ("char_start", "char_end")]
    return labels.withColumn("errors", F.array_compact(F.array(*checks)))


def modules_of(listing: DataFrame, modules: DataFrame) -> DataFrame:
    """``listing`` (url, filename) once for each url, with the day in the file name and the module (module, start, end) that it falls in, the lowest of several; names without a day are left out."""
    pattern = r"(?i)trans?cript\s*[-–]?\s*(\d{1,2})\s+([A-Za-z]+)\s+(20(?:20|21|22))(?:_\d+)?\.pdf$"
    day = F.try_to_date(F.concat_ws(" ", *[F.regexp_extract("filename", pattern, i) for i in (1, 2, 3)]), "d MMMM yyyy")
    once = listing.withColumn("day", day).where("day is not null").dropDuplicates(["url"])
    return first_range(once, modules, "day", "module").select("url", "filename", "day", "module")


def links_in(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): distinct links of a page in order of first appearance."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))


def write_by_file(docs: DataFrame, path: str) -> None:
    """Documents back to a folder for each file that they came from, or else for their type."""
    docs.withColumn("file", F.coalesce("file", F.concat("document_type", F.lit(".jsonl")))).write.partitionBy("file").mode("overwrite").json(path)


def write_by_scope(labels: DataFrame, path: str) -> None:
    labels.write.partitionBy("scope").mode("overwrite").json(path)


def upserted(manifest: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """The manifest with the new rows' sources replaced and the others kept."""
    return manifest.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
