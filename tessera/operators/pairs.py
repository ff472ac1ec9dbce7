"""Terms of documents and scores of document pairs within a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import sized, written

# The words that signal a contradiction.
SIGNALS = ["not", "no", "never", "none", "neither", "nor", "without", "denied", "failed", "incorrect", "false", "contrary", "opposite", "however", "but", "although", "despite", "unlike"]
# Fixed value: key terms are phrases of capitalised words, acronyms, and numbers with a unit.
KEY_TERM = r"(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)|(?:[A-Z]{2,}(?:\s+[A-Z]{2,})*)|(?:\d+[,.]?\d*\s*(?:feet|ft|km|m|mph|knots|UTC|hours?|minutes?|seconds?|kg|lbs?|%))"
FEATURES = ["word_count", "unique_ratio", "avg_word_length", "avg_sentence_length", "paragraph_count", "digit_ratio", "upper_ratio"]


def tokens(text: str = "content") -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(case_id, doc_ord, term, tf)."""
    return docs.select("case_id", "doc_ord", F.explode(tokens()).alias("term")).groupBy("case_id", "doc_ord", "term").agg(F.count("*").alias("tf"))


def inverse_frequencies(docs: DataFrame) -> DataFrame:
    """(case_id, term, df, idf) with idf = ln((N + 1) / (df + 1)), N the documents of the case."""
    n = docs.groupBy("case_id").agg(F.countDistinct("doc_ord").alias("n"))
    df = docs.select("case_id", "doc_ord", F.explode(F.array_distinct(tokens())).alias("term")).groupBy("case_id", "term").agg(F.count("*").alias("df"))
    return df.join(n, "case_id").select("case_id", "term", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best pairs of each case by score rounded to six places, ties in order of documents, with the score's share of the best as confidence. The cut comes before the best is looked up, so each task keeps only its ``k`` best of a case."""
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), "doc_a", "doc_b")
    ranked = pairs.withColumn("score", F.round("score", 6)).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = F.first("score").over(Window.partitionBy("case_id").orderBy("rank"))
    return ranked.select("case_id", "rank", "doc_a", "doc_b", "score", F.round(F.least(F.col("score") / first, F.lit(1.0)), 6).alias("confidence"))


#: Rows of a group that meet all of its rows in one task; a larger group is met in several.
BLOCK = 512


def crossed(a: DataFrame, b: DataFrame, key: list[str], doc: str, size: str) -> DataFrame:
    """Each row of ``a`` with each of ``b`` of its group. A group of ``size`` rows is cut into blocks by the hash of ``doc`` in ``a``, and ``b`` goes to each, so that a hot group is many tasks' work."""
    parts = F.ceil(F.col(size) / BLOCK)
    one = a.withColumn("_part", F.pmod(F.xxhash64(doc), parts)).drop(size)
    two = b.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop(size)
    return one.join(two, [*key, "_part"]).drop("_part")


def oversized(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): the groups of over BLOCK rows and their sizes; there are few of them."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)


def measured(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``n``, the size of their group where that is over BLOCK, else 1: only large groups are cut, and there are few of them."""
    return rows.join(sized(written(oversized(rows, key))), key, "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))


def keyword_pairs(docs: DataFrame) -> DataFrame:
    """(case_id, doc_a, doc_b, score): the idf of shared terms, raised by half for each signal word that one document has alone.

    Pairs come from an equi-join on the term, never from all pairs of a case; terms that all its documents have
    weigh nothing and do not take part. Terms travel as 64-bit hashes.
    """
    words = docs.select("case_id", "doc_ord", F.array_distinct(tokens()).alias("words"))
    terms = words.select("case_id", "doc_ord", F.explode("words").alias("term")).withColumn("term", F.xxhash64("term"))
    n = docs.groupBy("case_id").agg(F.countDistinct("doc_ord").alias("n"))
    idf = terms.groupBy("case_id", "term").agg(F.count("*").alias("df")).where("df > 1").join(n, "case_id").where("df < n").select("case_id", "term", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    weighed = terms.join(idf, ["case_id", "term"])
    a = weighed.select("case_id", "term", "idf", "df", F.col("doc_ord").alias("doc_a"))
    b = weighed.select("case_id", "term", "df", F.col("doc_ord").alias("doc_b"))
    shared = crossed(a, b, ["case_id", "term"], "doc_a", "df").where("doc_a < doc_b").groupBy("case_id", "doc_a", "doc_b").agg(F.sum("idf").alias("overlap"))
    signals = words.select("case_id", "doc_ord", F.array_intersect("words", F.array(*map(F.lit, SIGNALS))).alias("s"))
    one = signals.select("case_id", F.col("doc_ord").alias("doc_a"), F.col("s").alias("sa"))
    two = signals.select("case_id", F.col("doc_ord").alias("doc_b"), F.col("s").alias("sb"))
    lone = F.size(F.array_except("sa", "sb")) + F.size(F.array_except("sb", "sa"))
    return shared.join(one, ["case_id", "doc_a"]).join(two, ["case_id", "doc_b"]).select("case_id", "doc_a", "doc_b", (F.col("overlap") * (1 + 0.5 * lone)).alias("score"))


def surface_features(docs: DataFrame) -> DataFrame:
    """(case_id, doc_ord and the seven FEATURES) without reading meaning."""
    x = docs.select("case_id", "doc_ord", "content", tokens().alias("w"))
    n, chars = F.size("w"), F.greatest(F.lit(1), F.length("content"))
    return x.select(
        "case_id",
        "doc_ord",
        n.cast("double").alias("word_count"),
        (F.size(F.array_distinct("w")) / F.greatest(F.lit(1), n)).alias("unique_ratio"),
        (F.length(F.array_join("w", "")) / F.greatest(F.lit(1), n)).alias("avg_word_length"),
        (n / F.greatest(F.lit(1), F.regexp_count("content", F.lit("[.!?]+")))).alias("avg_sentence_length"),
        (F.regexp_count("content", F.lit("\n\n")) + 1).cast("double").alias("paragraph_count"),
        (F.regexp_count("content", F.lit(r"\p{Nd}")) / chars).alias("digit_ratio"),
        (F.regexp_count("content", F.lit(r"\p{Lu}")) / chars).alias("upper_ratio"),
    )


def divergent_pairs(features: DataFrame) -> DataFrame:
    """(case_id, doc_a, doc_b, score): distance of the features, each difference over the greater absolute value or 1. All pairs of a case, for each has a score."""
    features = features.join(features.groupBy("case_id").agg(F.count("*").alias("n")), "case_id")
    a = features.select("case_id", "n", F.col("doc_ord").alias("doc_a"), *[F.col(f).alias(f"a_{f}") for f in FEATURES])
    b = features.select("case_id", "n", F.col("doc_ord").alias("doc_b"), *[F.col(f).alias(f"b_{f}") for f in FEATURES])
    part = lambda f: F.pow((F.col(f"a_{f}") - F.col(f"b_{f}")) / F.greatest(F.abs(f"a_{f}"), F.abs(f"b_{f}"), F.lit(1.0)), 2)
    return crossed(a, b, ["case_id"], "doc_a", "n").where("doc_a < doc_b").select("case_id", "doc_a", "doc_b", F.sqrt(sum((part(f) for f in FEATURES), F.lit(0.0))).alias("score"))


#: Lists of a key, both sides together, up to which each of one side is held against each of the other.
NARROW = 64


def listed(left: DataFrame, right: DataFrame, key: list[str], more: tuple[str, ...]) -> list[DataFrame]:
    """Both sides with their lists as sets, ``refs_a`` and ``refs_b``, and these sets' sizes."""
    side = lambda x, s: x.select(*key, s, *[c for c in more if c in x.columns], F.array_distinct("refs").alias(f"refs_{s}")).withColumn(f"size_{s}", F.size(f"refs_{s}"))
    return [side(left, "a"), side(right, "b")]


def narrow_pairs(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """The pairs of ``listed`` sides that share a member, and ``shared``: all lists of a key against each other, each row meeting few."""
    both = one.join(two, key).where(F.arrays_overlap("refs_a", "refs_b"))
    return both.withColumn("shared", F.size(F.array_compact(F.array_intersect("refs_a", "refs_b"))).cast("long")).drop("refs_a", "refs_b")


def wide_pairs(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """The same by an equi-join on members, for keys of any size."""
    one, two = one.withColumn("ref", F.explode("refs_a")).drop("refs_a"), two.withColumn("ref", F.explode("refs_b")).drop("refs_b")
    key_ = [*key, "ref"]
    large = sized(written(oversized(one, key_)))
    one, two = (x.join(large, key_, "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long"))) for x in (one, two))
    both = crossed(one, two, key_, "a", "n")
    return both.groupBy(*[c for c in both.columns if c != "ref"]).agg(F.count("*").alias("shared"))


def narrow_and_wide(left: DataFrame, right: DataFrame, key: list[str], *more: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``set_pairs`` in two: the pairs of keys of at most NARROW lists, met whole and partitioned by key alone, and those of wider ones, met member by member; None if there are no wider ones. ``counts`` (key, n) are the lists of each key, both sides together, if known."""
    one, two = listed(left, right, key, more)
    if counts is None:
        counts = one.select(*key).unionByName(two.select(*key)).groupBy(*key).agg(F.count("*").alias("n"))
    wide = written(counts.where(F.col("n") > NARROW).drop("n"))
    columns = [*key, "a", "b", *more, (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("similarity")]
    if not wide.limit(1).count():
        return narrow_pairs(one, two, key).select(columns), None
    wide = sized(wide)
    part = lambda how: [x.join(wide, key, how) for x in (one, two)]
    return narrow_pairs(*part("anti"), key).select(columns), wide_pairs(*part("semi"), key).select(columns)


def set_pairs(left: DataFrame, right: DataFrame, key: list[str], *more: str) -> DataFrame:
    """(key, a, b, ``more``, similarity) of the pairs of ``left`` (key, a, refs) and ``right`` (key, b, refs) that share a member: Jaccard similarity of the lists as sets. ``more`` columns of either side come along."""
    narrow, wide = narrow_and_wide(left, right, key, *more)
    return narrow if wide is None else narrow.unionByName(wide)


def key_terms(text: str = "content") -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(KEY_TERM), F.lit(0)), lambda x: F.lower(F.trim(x))))


def key_term_pairs(docs: DataFrame) -> DataFrame:
    """(case_id, doc_a, doc_b, similarity) of documents of a case that share a key term."""
    # Terms are found once; texts without any are in no pair.
    x = written(docs.select("case_id", "doc_ord", key_terms().alias("refs")).where(F.size("refs") > 0))
    pairs = set_pairs(x.withColumnRenamed("doc_ord", "a"), x.withColumnRenamed("doc_ord", "b"), ["case_id"])
    return pairs.where("a < b").select("case_id", F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "similarity")
