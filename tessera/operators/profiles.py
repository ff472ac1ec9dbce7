"""Text quality, profiles by document type, entities across cases and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import written
from tessera.operators.classify import CANONICAL_TYPES

# Thresholds of text quality and of the gates.
QUALITY = {"min_char_ratio": 0.85, "min_word_count": 100, "min_avg_word_length": 2.5, "max_avg_word_length": 12.0, "min_clean_rate": 0.80}
GATES = {"min_cases_with_docs": 5, "min_docs_per_case": 10, "min_document_types": 6, "min_shared_entities": 10}
# Regulations and directives.
REGULATION = r"\b14\s+CFR\s+(?:Part\s+)?\d+(?:\.\d+)?\b"
DIRECTIVE = r"\bAD\s+\d{4}-\d{2}-\d{2}\b"
REGULATIONS_A_DOCUMENT = 10
WORD, GAP = r"(?U)\S+", r"(?U)\s+"


def text_quality(docs: DataFrame) -> DataFrame:
    """Adds char_ratio (printable), avg_word_length, word_count, line_count and passed; blank texts have zeros and do not pass."""
    t = F.col("content")
    words = F.regexp_count(t, F.lit(WORD))
    blank = F.coalesce(words == 0, F.lit(True))
    # What is left of the text without its gaps, and without what can't be printed: fewer matches than words or characters.
    letters = F.length(F.regexp_replace(t, F.lit(GAP), F.lit("")))
    printable = F.length(F.regexp_replace(t, F.lit("[^\t-\r -~]+"), F.lit("")))
    docs = docs.select(
        "*",
        F.when(blank, 0.0).otherwise(printable / F.length(t)).alias("char_ratio"),
        F.when(blank, 0.0).otherwise(letters / words).alias("avg_word_length"),
        F.when(blank, 0).otherwise(words).cast("bigint").alias("word_count"),
        F.when(blank, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("line_count"),
    )
    q = QUALITY
    return docs.withColumn("passed", (F.col("char_ratio") >= q["min_char_ratio"]) & (F.col("word_count") >= q["min_word_count"]) & F.col("avg_word_length").between(q["min_avg_word_length"], q["max_avg_word_length"]))


def type_profiles(docs: DataFrame) -> DataFrame:
    """Counts, word and line statistics and the first five titles of each type, over documents that passed."""
    good = written(docs.where("passed and document_type is not null").select("document_type", "doc_ord", F.left("title", F.lit(100)).alias("title"), "word_count", "line_count"))
    first = good.withColumn("nth", F.row_number().over(Window.partitionBy("document_type").orderBy("doc_ord"))).where("nth <= 5")
    titles = first.groupBy("document_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"]), " | ").alias("example_titles"))
    stats = good.groupBy("document_type").agg(
        F.count("*").alias("count"), F.min("word_count").alias("word_count_min"), F.max("word_count").alias("word_count_max"), F.bround(F.avg("word_count"), 1).alias("word_count_mean"), F.bround(F.avg("line_count"), 1).alias("avg_line_count")
    )
    return stats.join(titles, "document_type")


def case_summaries(docs: DataFrame) -> DataFrame:
    """Documents, clean documents, clean rate and the number of types of each case."""
    return docs.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("clean"), F.bround(F.count_if("passed") / F.count("*"), 4).alias("clean_rate"), F.countDistinct("document_type").alias("types"))


def type_distribution(docs: DataFrame) -> DataFrame:
    return docs.groupBy("case_id", "document_type").agg(F.count("*").alias("n"))


def taxonomy(docs: DataFrame) -> DataFrame:
    """Each canonical type with its count and whether it is there."""
    spark = docs.sparkSession
    types = spark.createDataFrame([(t,) for t in CANONICAL_TYPES], "document_type string")
    counts = docs.groupBy("document_type").agg(F.count("*").alias("n"))
    return types.join(counts, "document_type", "left").select("document_type", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("present"))


def quality_gates(summaries: DataFrame, types: DataFrame, profiles: DataFrame) -> DataFrame:
    """(gate, actual, threshold, passed): cases with documents enough, cases below the clean rate, types found, shared entities. Summaries feed two gates and are made once."""
    summaries = written(summaries)
    g = GATES
    row = lambda df, name, actual, threshold, passed: df.select(F.lit(name).alias("gate"), actual.cast("double").alias("actual"), F.lit(float(threshold)).alias("threshold"), passed(actual.cast("double")).alias("passed"))
    a = summaries.agg(F.count_if(F.col("total") >= g["min_docs_per_case"]).alias("x"))
    b = summaries.agg(F.count_if(F.col("clean_rate") < QUALITY["min_clean_rate"]).alias("x"))
    c = types.agg(F.countDistinct("document_type").alias("x"))
    d = profiles.where("n_cases >= 2").agg(F.countDistinct("name").alias("x"))
    out = row(a, "G1", F.col("x"), g["min_cases_with_docs"], lambda v: v >= g["min_cases_with_docs"])
    out = out.union(row(b, "G2", F.col("x"), 0, lambda v: v == 0))
    out = out.union(row(c, "G3", F.col("x"), g["min_document_types"], lambda v: v >= g["min_document_types"]))
    return out.union(row(d, "G4", F.col("x"), g["min_shared_entities"], lambda v: v >= g["min_shared_entities"]))


# What a gate measures and what to do where it fails.
ACTIONS = {
    "G1": ("dockets_with_docs", "Try additional docket candidates"),
    "G2": ("low_quality_dockets", "Re-extract with alternative settings"),
    "G3": ("document_types", "Note: press_coverage is synthetic-only"),
    "G4": ("shared_entities", "Expand docket selection for more overlap"),
}


def gate_report(gates: DataFrame) -> DataFrame:
    """``gates`` with the metric of each and the action where it failed (empty where it passed)."""
    told = lambda i: F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (k, v[i])])[F.col("gate")]
    return gates.withColumns({"metric": told(0), "action": F.when(F.col("passed"), "").otherwise(told(1))})


def failed_gates(gates: DataFrame) -> DataFrame:
    """One row: whether all gates passed, and the names of those that failed."""
    return gates.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))).alias("failed"))


def taxonomy_notes(types: DataFrame) -> DataFrame:
    """(note): which canonical types the documents lack, in their order, and that one of them is expected to be absent."""
    order = F.array_position(F.array(*map(F.lit, CANONICAL_TYPES)), F.col("document_type"))
    gone = types.where("not present").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "document_type"))), lambda x: x["document_type"]).alias("gone")).where("size(gone) > 0")
    press = F.when(F.array_contains("gone", "press_coverage"), "press_coverage is expected absent: such sources don't hold press articles")
    return gone.select(F.explode(F.array_compact(F.array(F.concat(F.lit("Types not found in scraped data: "), F.array_join("gone", ", ")), press))).alias("note"))


def normal_name(name: Column) -> Column:
    """Trimmed, lower case, without a leading "the " and then "a ", single spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "^the ", ""), "^a ", ""), r"\s+", " ")


def mentioned(t: Column, organisations: dict[str, list[str]], equipment: list[str]) -> Column:
    """The entities (name, entity_type) of a text: an organisation once if any of its forms is in it, each equipment pattern's first match, the first regulations (ten at most) and all directives."""
    lower = F.lower(t)
    found = lambda forms: F.exists(F.array(*[F.lit(f.lower()) for f in forms]), lambda f: F.contains(lower, f))
    orgs = F.array_compact(F.array(*[F.when(found([name, *forms]), F.lit(name)) for name, forms in organisations.items()])) if organisations else F.array().cast("array<string>")
    gear = F.filter(F.array(*[F.trim(F.regexp_extract(t, p, 0)) for p in equipment]), lambda x: x != "") if equipment else F.array().cast("array<string>")
    rules = F.concat(F.slice(F.regexp_extract_all(t, F.lit(f"(?i){REGULATION}"), F.lit(0)), 1, REGULATIONS_A_DOCUMENT), F.regexp_extract_all(t, F.lit(f"(?i){DIRECTIVE}"), F.lit(0)))
    typed = lambda names, kind: F.transform(names, lambda x: F.struct(F.trim(x).alias("name"), F.lit(kind).alias("entity_type")))
    return F.concat(typed(orgs, "organization"), typed(gear, "equipment"), typed(rules, "regulation"))


def entity_mentions(docs: DataFrame, organisations: dict[str, list[str]], equipment: list[str]) -> DataFrame:
    """(case_id, doc_ord, name, entity_type) of the documents given, as ``mentioned`` finds them."""
    return docs.select("case_id", "doc_ord", F.inline(mentioned(F.col("content"), organisations, equipment)))


def entity_profiles(mentions: DataFrame) -> DataFrame:
    """Aliases, cases and mentions of each normalised name and type."""
    return mentions.groupBy(normal_name(F.col("name")).alias("name"), "entity_type").agg(
        F.countDistinct(F.col("name")).alias("n_aliases"), F.array_join(F.sort_array(F.collect_set("name")), " | ").alias("aliases"), F.countDistinct("case_id").alias("n_cases"), F.count("*").alias("mentions")
    )


def cross_case(profiles: DataFrame) -> DataFrame:
    """Shared entities (two cases or more), the mean number of their cases, and names with variations."""
    return profiles.agg(
        F.count_if(F.col("n_cases") >= 2).alias("shared"),
        F.coalesce(F.bround(F.avg(F.when(F.col("n_cases") >= 2, F.col("n_cases"))), 4), F.lit(0.0)).alias("connectivity"),
        F.count_if(F.col("n_aliases") > 1).alias("with_variations"),
    )


def top_by_type(profiles: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("entity_type").orderBy(F.desc("n_cases"), F.desc("mentions"), "name")
    return profiles.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("entity_type", "rank", "name", "n_cases", "mentions")
