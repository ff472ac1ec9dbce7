"""The best document pairs of each case without looking at all pairs: bounds against a k-th score that some pairs already reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import sized, written
from tessera.operators.pairs import FEATURES, SIGNALS, best, crossed, tokens

#: Documents of a case whose pairs set the first bar: each meets those up to NEAR places off in an order that brings copies together; the LONGEST all meet each other.
SEEDS, NEAR, LONGEST = 256, 4, 24
#: Scores are compared after rounding to six places.
SLACK = 1e-6
#: Widths of the cells of features, each a multiple of the next.
WIDTHS = (1.0, 0.25, 0.0625)


def bar(pairs: DataFrame, k: int) -> DataFrame:
    """(case_id, bar): the ``k``-th best of some pairs' scores, which the best of all can't be below; cases with fewer have none."""
    top = Window.partitionBy("case_id").orderBy(F.desc("score"))
    ranked = pairs.where("score > 0").select("case_id", F.round("score", 6).alias("score")).withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k)
    return ranked.groupBy("case_id").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def hashed_words(docs: DataFrame) -> DataFrame:
    """(case_id, doc_ord, signals, terms, size), written: a document's different words as 64-bit hashes, signal words as bits."""
    words = docs.select("case_id", "doc_ord", F.array_distinct(tokens()).alias("words"))
    words = words.select("case_id", "doc_ord", F.transform("words", lambda w: F.xxhash64(w)).alias("terms"), F.coalesce(F.size("words"), F.lit(0)).alias("size"))
    bits = sum((F.array_contains("terms", F.xxhash64(F.lit(s))).cast("int") * (1 << i) for i, s in enumerate(SIGNALS)), F.lit(0))
    return written(words.select("case_id", "doc_ord", bits.alias("signals"), "terms", "size"))


def lone(a: str, b: str) -> Column:
    """Signal words that one of two documents has alone."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def overlaps(pairs: DataFrame, words: DataFrame, idf: DataFrame) -> DataFrame:
    """``pairs`` (written: case_id, doc_a, doc_b, signals_a, signals_b) with their score: the idf of the terms they share, raised by half for each lone signal."""
    ends = pairs.select("case_id", F.explode(F.array("doc_a", "doc_b")).alias("doc_ord")).distinct()
    ends = written(words.select("case_id", "doc_ord", "terms").join(sized(written(ends)), ["case_id", "doc_ord"]))
    side = lambda s: ends.withColumnsRenamed({"doc_ord": f"doc_{s}", "terms": f"terms_{s}"})
    shared = pairs.join(side("a"), ["case_id", "doc_a"]).join(side("b"), ["case_id", "doc_b"]).withColumn("term", F.explode(F.array_intersect("terms_a", "terms_b"))).drop("terms_a", "terms_b")
    sums = shared.join(idf, ["case_id", "term"]).groupBy("case_id", "doc_a", "doc_b", "signals_a", "signals_b").agg(F.sum("idf").alias("overlap"))
    return sums.select("case_id", "doc_a", "doc_b", (F.col("overlap") * (1 + 0.5 * lone("signals_a", "signals_b"))).alias("score"))


def seed_pairs(words: DataFrame, k: int, seeds: int) -> DataFrame:
    """(case_id, doc_a, doc_b, signals_a, signals_b), written: of pairs among the ``seeds`` documents of a case with most words, the 2 ``k`` that share most words, lone signals counted."""
    first = Window.partitionBy("case_id").orderBy(F.desc("size"), "doc_ord")
    some = sized(written(words.select("case_id", "doc_ord", "size").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= seeds).drop("size")))
    # Copies share the least of their hashes, and have about as many.
    near = Window.partitionBy("case_id").orderBy(F.array_min("terms"), "size", "doc_ord")
    some = written(words.where("size > 0").join(some, ["case_id", "doc_ord"]).withColumn("at", F.row_number().over(near)))
    side = lambda s: some.select("case_id", *[F.col(c).alias(f"{n}_{s}") for c, n in (("doc_ord", "doc"), ("signals", "signals"), ("terms", "terms"), ("nth", "nth"), ("at", "at"))])
    meet = (F.abs(F.col("at_a") - F.col("at_b")) <= NEAR) | (F.greatest("nth_a", "nth_b") <= LONGEST)
    met = side("a").join(side("b"), "case_id").where(F.expr("doc_a < doc_b") & meet)
    shared = F.size(F.array_intersect("terms_a", "terms_b")) * (1 + 0.5 * lone("signals_a", "signals_b"))
    met = met.select("case_id", "doc_a", "doc_b", "signals_a", "signals_b", shared.alias("shared"))
    top = Window.partitionBy("case_id").orderBy(F.desc("shared"), "doc_a", "doc_b")
    return written(met.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= 2 * k).drop("nth", "shared"))


def keyword_candidates(docs: DataFrame, k: int, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((case_id, doc_a, doc_b, signals_a, signals_b), words, idf): the pairs that may be among the ``k`` best by shared terms.

    ``seed_pairs`` set a case's bar. A pair shares no more than either document weighs, and lone signals raise it by a
    bounded factor: documents that weigh too little for the bar go, first by their number of words, each taken to be
    as rare as a shared one can be, so that only few are weighed. Of documents with the same words and signals only the
    ``k`` + 1 first can be in a best pair. Terms of the others are posted in order of impact, rarest first, only while
    what is left of the document could make up a score at the bar: two documents that reach it share one of these.
    What the posted terms and the rest bound is compared with the bar once more.
    """
    words = hashed_words(docs)
    case = words.groupBy("case_id").agg(F.countDistinct("doc_ord").alias("n"), F.bit_or("signals").alias("any"), F.bit_and("signals").alias("all"), F.max(F.bit_count("signals")).alias("most"))
    case = sized(written(case))
    df = words.select("case_id", F.explode("terms").alias("term")).groupBy("case_id", "term").agg(F.count("*").alias("df")).where("df > 1")
    idf = written(df.join(case.select("case_id", "n"), "case_id").where("df < n").select("case_id", "term", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf")))
    bars = sized(written(bar(overlaps(seed_pairs(words, k, seeds), words, idf), k)))
    # The greatest factor that a pair of this document can have.
    ones = F.bit_count("signals")
    out = F.bit_count(F.expr("signals & ~`all`")) + F.bit_count(F.expr("`any` & ~signals"))
    factor = 1 + 0.5 * F.least(out, ones + F.col("most"))
    live = words.join(case, "case_id").join(bars, "case_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    live = live.withColumn("least", F.greatest(F.lit(0.0), (F.col("bar") - SLACK) / factor * (1 - 1e-9)))
    # Shared terms are in two documents at least.
    live = live.where("size > 0").where(F.col("size") * F.log((F.col("n") + 1) / 3) * (1 + 1e-9) >= F.col("least"))
    same = Window.partitionBy("case_id", "signals", "size", "same").orderBy("doc_ord")
    live = live.select("case_id", "doc_ord", "signals", "terms", "size", "bar", "least", F.xxhash64(F.array_sort("terms")).alias("same"))
    live = live.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("size", "same", "nth")
    terms = live.withColumn("term", F.explode("terms")).drop("terms").join(idf, ["case_id", "term"])
    left = F.sum("idf").over(Window.partitionBy("case_id", "doc_ord").orderBy(F.desc("df"), F.desc("term")))
    posted = terms.withColumn("left", left).where(F.col("left") * (1 + 1e-9) >= F.col("least"))
    posted = written(posted.withColumn("rest", F.col("left") - F.col("idf")).select("case_id", "doc_ord", "term", "idf", "signals", "bar", "rest"))
    posted = posted.join(posted.groupBy("case_id", "term").agg(F.count("*").alias("many")).where("many > 1"), ["case_id", "term"])
    a = posted.select("case_id", "term", "idf", "many", "bar", F.col("doc_ord").alias("doc_a"), F.col("signals").alias("signals_a"), F.col("rest").alias("rest_a"))
    b = posted.select("case_id", "term", "many", F.col("doc_ord").alias("doc_b"), F.col("signals").alias("signals_b"), F.col("rest").alias("rest_b"))
    met = crossed(a, b, ["case_id", "term"], "doc_a", "many").where("doc_a < doc_b")
    met = met.groupBy("case_id", "doc_a", "doc_b", "signals_a", "signals_b", "bar").agg(F.sum("idf").alias("seen"), F.min("rest_a").alias("rest_a"), F.min("rest_b").alias("rest_b"))
    # After the last posted term that both have, neither can share more than it has left.
    most = (F.col("seen") + F.least("rest_a", "rest_b")) * (1 + 1e-9) * (1 + 0.5 * lone("signals_a", "signals_b"))
    return met.where(most >= F.col("bar") - SLACK).select("case_id", "doc_a", "doc_b", "signals_a", "signals_b"), words, idf


def keyword_topk(docs: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
    """``pairs.best`` of ``pairs.keyword_pairs``: the same rows, but only pairs that ``keyword_candidates`` leaves are scored. Documents without terms are in no pair; no documents give none."""
    pairs, words, idf = keyword_candidates(docs, k, seeds)
    return best(overlaps(written(pairs), words, idf), k)


def distance(a: str = "a_", b: str = "b_") -> Column:
    part = lambda f: F.pow((F.col(f"{a}{f}") - F.col(f"{b}{f}")) / F.greatest(F.abs(f"{a}{f}"), F.abs(f"{b}{f}"), F.lit(1.0)), 2)
    return F.sqrt(sum((part(f) for f in FEATURES), F.lit(0.0)))


def sided(features: DataFrame, side: str, *more: str) -> DataFrame:
    return features.select("case_id", *more, F.col("doc_ord").alias(f"doc_{side}"), *[F.col(f).alias(f"{side}_{f}") for f in FEATURES])


def turned(pairs: DataFrame) -> DataFrame:
    """(case_id, doc_a, doc_b, score) with the lesser document first."""
    return pairs.select("case_id", F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), distance().alias("score"))


def cell(width: float) -> Column:
    """The cell of a document's features: of their values up to 1 and of their logarithms beyond, as differences count."""
    return F.array(*[F.floor(F.when(F.col(f) > 1, 1 + F.log(f)).otherwise(F.col(f)) / width) for f in FEATURES])


def boxes(features: DataFrame, level: int) -> DataFrame:
    """The cells of a level with the bounds of their documents and the cell that they lie in on the level above."""
    out = features.groupBy("case_id", cell(WIDTHS[level]).alias("cell")).agg(*[g(f).alias(f"{n}_{f}") for f in FEATURES for n, g in (("low", F.min), ("high", F.max))])
    return out.withColumn("above", F.transform("cell", lambda c: F.floor(c * WIDTHS[level] / WIDTHS[level - 1])) if level else F.lit(None).cast("array<bigint>"))


def farthest(f: str) -> Column:
    """The greatest difference of a feature between two boxes. Features are not negative, so it lies between the least of one and the greatest of the other."""
    apart = lambda x, y: F.abs(F.col(x) - F.col(y)) / F.greatest(F.col(x), F.col(y), F.lit(1.0))
    return F.greatest(apart(f"a_low_{f}", f"b_high_{f}"), apart(f"a_high_{f}", f"b_low_{f}"))


def divergence_cells(features: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((case_id, a, b) pairs of cells that may hold one of the ``k`` best pairs, the bars, the documents that can be in one).

    Of documents with equal features only the ``k`` first can be in a best pair. The pairs of documents that are
    extreme in some feature set a bar. Cells are opened level by level: the bounds of two cells say how far documents
    of them can be apart, and only pairs of cells that could reach the bar are split further.
    """
    same = Window.partitionBy("case_id", *FEATURES).orderBy("doc_ord")
    some = written(features.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k).drop("nth"))
    ends = some.groupBy("case_id", F.pmod(F.xxhash64("doc_ord"), F.lit(4)).alias("part")).agg(F.array_union(F.array(*[F.min_by("doc_ord", f) for f in FEATURES]), F.array(*[F.max_by("doc_ord", f) for f in FEATURES])).alias("docs"))
    ends = ends.select("case_id", F.explode("docs").alias("doc_ord")).distinct()
    seeds = written(some.join(ends, ["case_id", "doc_ord"]))
    bars = written(bar(turned(sided(seeds, "a").join(sided(seeds, "b"), "case_id").where("doc_a < doc_b")), k))
    pairs = None
    for level in range(len(WIDTHS)):
        each = written(boxes(some, level))
        side = lambda s: each.select("case_id", F.col("cell").alias(s), F.col("above").alias(f"above_{s}"), *[F.col(f"{n}_{f}").alias(f"{s}_{n}_{f}") for f in FEATURES for n in ("low", "high")])  # noqa: B023, E731
        if pairs is None:
            met = side("a").join(side("b"), "case_id").where("a <= b")
        else:
            met = pairs.withColumnsRenamed({"a": "above_a", "b": "above_b"}).join(side("a"), ["case_id", "above_a"]).join(side("b"), ["case_id", "above_b"]).where("above_a <> above_b or a <= b")
        most = F.sqrt(sum((F.pow(farthest(f), 2) for f in FEATURES), F.lit(0.0))) * (1 + 1e-9)
        met = met.join(bars, "case_id", "left").where(most >= F.coalesce(F.col("bar"), F.lit(0.0)) - SLACK)
        pairs = written(met.select("case_id", "a", "b"))
    return pairs, bars, some


def divergent_topk(features: DataFrame, k: int) -> DataFrame:
    """``pairs.best`` of ``pairs.divergent_pairs``: the same rows, by opening only the cells that ``divergence_cells`` leaves. Features must not be negative. No documents give none."""
    cells, bars, some = divergence_cells(features, k)
    placed = some.withColumn("cell", cell(WIDTHS[-1]))
    a = sided(placed.withColumnRenamed("cell", "a"), "a", "a")
    b = sided(placed.withColumnRenamed("cell", "b"), "b", "b")
    met = cells.join(a, ["case_id", "a"]).join(b, ["case_id", "b"]).where("a <> b or doc_a < doc_b")
    found = turned(met).join(bars, "case_id", "left").where(F.col("score") >= F.coalesce(F.col("bar"), F.lit(0.0)) - SLACK)
    return best(found.drop("bar"), k)
