"""How five quality filters interact: words as rows, flags of each document, and counts of all 32 combinations of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import sized, table, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
#: Parts over which rows of one document and text are spread, if they repeat.
SPREAD = 64


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n_words, n_distinct) of ``texts`` (key, text): words are exploded, counted by (key, word), then by key.

    Texts are dealt out by key first, so that the words of one need no further shuffle. Rows that repeat a key have
    equal texts: they count their words again, and no more distinct ones. Texts without words have no row.
    """
    dealt = texts.withColumn("spread", F.spark_partition_id() % SPREAD).repartition("key", "spread")
    words = dealt.select("key", "spread", F.explode(F.split("text", "[ \\t-\\r]+")).alias("word")).where("word <> ''")
    each = words.groupBy("key", "spread", "word").agg(F.count("*").alias("n"))
    some = each.groupBy("key", "spread").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))
    return some.groupBy("key").agg(F.sum("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, copies): the filters that each document fails, as bits of A, B, ... E, with the number of equal rows.

    A row's key is a digest of its doc_id and text; equal texts are those of one SHA-256 digest. Null texts are empty,
    null sources and empty ones one part. A null doc_id is smaller and larger than none. Labels that repeat count if
    any of a document does; without a label a document is neither good nor toxic.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws(":", "sha", "doc_id").cast("binary"))))
    counts = word_counts(rows.select("key", "text"))
    capitals = F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * CAPITAL_PERCENT
    slim = rows.select("key", "doc_id", "part", F.unhex("sha").alias("digest"), capitals.alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"))
    slim = written(slim.groupBy(*slim.columns).agg(F.count("*").alias("copies")))
    least = slim.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    total = slim.groupBy("key").agg(F.sum("copies").alias("rows"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    words = counts.join(total, "key").select("key", F.expr("n_words div rows").alias("n_words"), "n_distinct")
    out = slim.join(words, "key", "left").join(sized(written(least)), "digest", "left").join(marks, "doc_id", "left")
    n, distinct = (F.coalesce(c, F.lit(0)) for c in ("n_words", "n_distinct"))
    fails = [n < LEAST_WORDS, distinct * 100 < n * DISTINCT_PERCENT, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return out.select("part", mask.alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "copies")


def combinations(flags: DataFrame) -> DataFrame:
    """A row for each part with arrays of 32 conditional counts: n, good and toxic documents that fail exactly a set of filters."""
    count = lambda k, more: F.coalesce(F.sum(F.when((F.col("mask") == k) & more, F.col("copies"))), F.lit(0))
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    wide = flags.groupBy("part").agg(*[count(k, more).alias(f"{name}_{k}") for name, more in kinds.items() for k in range(MASKS)])
    return wide.select("part", *[F.array(*[f"{name}_{k}" for k in range(MASKS)]).alias(name) for name in kinds])


def orders() -> list[str]:
    """All orders of the filters."""
    found = [""]
    for _ in FILTERS:
        found = [o + f for o in found for f in FILTERS if f not in o]
    return found


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part of ``docs``, order of the filters and step.

    Every row counts, also one that repeats another whole. No documents give no rows; columns besides doc_id, text,
    source and the labels' doc_id, quality and toxic are ignored. See ``flagged`` for nulls.
    """
    steps = combinations(flagged(docs, labels)).withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders())), " ")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = [F.instr("filter_order", f) for f in FILTERS]
    before = sum((F.when(p < F.col("step"), 1 << k).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    own = sum((F.when(p == F.col("step"), 1 << k).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    steps = steps.withColumns({"before": before, "own": own})

    def total(name: str, when, weight=None) -> Column:
        masks = F.sequence(F.lit(0), F.lit(MASKS - 1))
        value = lambda k: F.element_at(name, k + 1) * (weight(k) if weight else F.lit(1))
        return F.aggregate(masks, F.lit(0).cast("long"), lambda s, k: s + F.when(when(k), value(k)).otherwise(F.lit(0).cast("long")))

    fails = lambda k: k.bitwiseAND(F.col("own")) != 0
    earlier = lambda k: k.bitwiseAND(F.col("before")) != 0
    here = lambda k: fails(k) & ~earlier(k)
    # A filter is the first of those that a document fails in an equal share of all orders.
    share = lambda k: F.lit(len(orders())).cast("long") / F.bit_count(k)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda k: ~fails(k) & ~earlier(k)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda k: fails(k) & earlier(k)).alias("redundant"),
        F.element_at("n", F.col("own") + 1).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", fails, lambda k: share(k).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES: dict[str, str] = {
    "op12_filter_audit": r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
    w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as least from d),
    l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
    f as (select part, (len(ws) < 200)::int + 2 * (100 * list_unique(ws) < 50 * len(ws))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l using (doc_id)),
    c as (select part, mask, count(*) as n, sum(good)::bigint as good, sum(toxic)::bigint as toxic from f group by all),
    x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s as (select filter_order, step, substr(filter_order, step, 1) as own, substr(filter_order, 1, step - 1) as before from o, (select unnest([1, 2, 3, 4, 5])::int as step)),
    b as (select filter_order, step, 1 << (ascii(own) - 65) as own, coalesce(list_sum([case when contains(before, y) then 1 << (ascii(y) - 65) else 0 end for y in ['A', 'B', 'C', 'D', 'E']]), 0)::int as before from s)
    select part, filter_order, step,
        coalesce(sum(n) filter (where mask & (own | before) = 0), 0)::bigint as kept,
        coalesce(sum(n) filter (where mask & own <> 0 and mask & before = 0), 0)::bigint as removed,
        coalesce(sum(n) filter (where mask & own <> 0 and mask & before <> 0), 0)::bigint as redundant,
        coalesce(sum(n) filter (where mask = own), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where mask & own <> 0 and mask & before = 0), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (where mask & own <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
        coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) filter (where mask & own <> 0), 0)::bigint as shapley
    from c, b group by part, filter_order, step""",
}
