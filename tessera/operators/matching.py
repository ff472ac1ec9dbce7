"""Detections matched to gold labels one to one, and what follows from the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import written
from tessera.operators.pairs import narrow_and_wide

# The stage that each detectability belongs to.
STAGES = {"single_hop": "claim_extraction", "multi_hop": "cross_reference_identification", "entity_resolution_dependent": "contradiction_detection"}


def exact_matches(detections: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """(key, det_idx, label_idx): each detection in order of description takes the first label left with the same references. Ranked among equals on both sides, these are an equi-join."""
    d = detections.withColumn("rn", F.row_number().over(Window.partitionBy(*key, "refs").orderBy("description", "det_idx")))
    g = gold.withColumn("rn", F.row_number().over(Window.partitionBy(*key, "refs").orderBy("label_idx")))
    return d.select(*key, "refs", "rn", "det_idx").join(g.select(*key, "refs", "rn", "label_idx"), [*key, "refs", "rn"]).select(*key, "det_idx", "label_idx")


def rounded(x: Column) -> Column:
    """To six places, apart from what the order of a sum does to the tenth."""
    return F.round(F.round(x, 10), 6)


def rates(matched: Column, n_det: Column, n_gold: Column) -> list[Column]:
    """Precision, recall and F1, by what is found and what there is: nothing detected gives 0 throughout, no gold gives a precision of 1."""
    p = F.when(n_det == 0, 0.0).when(n_gold == 0, 1.0).otherwise(matched / n_det)
    r = F.when((n_det == 0) | (n_gold == 0), 0.0).otherwise(matched / n_gold)
    f = F.when((n_gold == 0) | (p + r == 0), 0.0).otherwise(2 * p * r / (p + r))
    return [rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f).alias("f1")]


def sizes(detections: DataFrame, gold: DataFrame, key: list[str], gold_key: list[str]) -> DataFrame:
    """Numbers of detections and labels of each key; a key that one side lacks counts 0 there."""
    d = detections.groupBy(*key).agg(F.count("*").alias("n_det"))
    g = gold.groupBy(*gold_key).agg(F.count("*").alias("n_gold"))
    return g.join(d, key, "full").fillna(0, ["n_det", "n_gold"])


def binary_scores(detections: DataFrame, gold: DataFrame, key: list[str], by: str | None = None) -> DataFrame:
    """Precision, recall and F1 of exact matches for each key; with ``by``, all its detections against the labels of each value of that column apart."""
    gold_key = [*key, by] if by else key
    per = gold.groupBy(*gold_key, "refs").agg(F.count("*").alias("g")).join(detections.groupBy(*key, "refs").agg(F.count("*").alias("d")), [*key, "refs"])
    matched = per.groupBy(*gold_key).agg(F.sum(F.least("g", "d")).alias("matched"))
    n = sizes(detections, gold, key, gold_key)
    if by:
        n = n.where(F.col(by).isNotNull())
    out = n.join(matched, gold_key, "left").fillna(0, ["matched"])
    return out.select(*gold_key, "n_det", "n_gold", "matched", *rates(F.col("matched"), F.col("n_det"), F.col("n_gold")))


def staged(gold: DataFrame) -> DataFrame:
    stage = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    return gold.withColumn("stage", stage[F.col("detectability")]).where("stage is not null")


def assigned(pairs: DataFrame, key: list[str]) -> DataFrame:
    """The one-to-one assignment that takes pairs (key, a, b, similarity, order_a, order_b) greedily by similarity, then order.

    In each round the pairs that come first for both their sides are taken and their sides leave; that gives what a
    sequential pass gives. Rounds end when no pair is left; each writes its pairs once, marked as taken, gone or left.
    """
    order = [F.desc("similarity"), "order_a", "order_b", "a", "b"]
    left, taken = pairs, None
    by_a, by_b = Window.partitionBy(*key, "a"), Window.partitionBy(*key, "b")
    while True:
        first = left.withColumn("_a", F.row_number().over(by_a.orderBy(*order))).withColumn("_b", F.row_number().over(by_b.orderBy(*order)))
        first = first.withColumn("_taken", (F.col("_a") == 1) & (F.col("_b") == 1)).drop("_a", "_b")
        done = written(first.withColumn("_gone", F.max("_taken").over(by_b)).withColumn("_gone", F.col("_gone") | F.max("_taken").over(by_a)))
        mutual = done.where("_taken").drop("_taken", "_gone")
        taken = mutual if taken is None else taken.unionByName(mutual)
        left = done.where("not _gone").drop("_taken", "_gone")
        if left.limit(1).count() == 0:
            return taken


def assigned_whole(pairs: DataFrame, key: list[str]) -> DataFrame:
    """What ``assigned`` takes, (key, a, b, similarity), of keys with few pairs: those of a key come to one row and are passed through there, in order. No rounds, nothing written."""
    met = pairs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("unlike"), "order_a", "order_b", "a", "b"))).alias("met"))
    gone = lambda p: lambda t: t["a"].eqNullSafe(p["a"]) | t["b"].eqNullSafe(p["b"])
    taken = F.aggregate("met", F.slice("met", 1, 0), lambda taken, p: F.when(F.exists(taken, gone(p)), taken).otherwise(F.concat(taken, F.array(p))))
    return met.select(*key, F.inline(taken)).select(*key, "a", "b", (-F.col("unlike")).alias("similarity"))


def partial_matches(detections: DataFrame, gold: DataFrame, key: list[str], by: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(key, by, a, b, similarity): detections and labels assigned one to one by the similarity of their references; with ``by``, all detections of a key to its labels of each value of that column apart. ``counts`` (key, n) are the lists of each key, if known."""
    more = [by] if by else []
    d = detections.select(*key, F.col("det_idx").alias("a"), "refs", F.col("description").alias("order_a"))
    g = gold.select(*key, *more, F.col("label_idx").alias("b"), "refs", F.col("rationale").alias("order_b"))
    # The pairs are the same for every value of ``by``: only what is assigned to what is told apart.
    narrow, wide = narrow_and_wide(d, g, key, "order_a", "order_b", *more, counts=counts)
    taken = assigned_whole(narrow, [*key, *more])
    return taken if wide is None else taken.unionByName(assigned(wide, [*key, *more]).select(taken.columns))


def partial_scores(detections: DataFrame, gold: DataFrame, key: list[str], by: str | None = None) -> DataFrame:
    """Precision, recall and F1 with each assigned pair counting its similarity, and that credit's mean over the pairs; with ``by``, all detections of a key against its labels of each value of that column apart."""
    gold_key = [*key, by] if by else key
    if by:
        gold = gold.where(F.col(by).isNotNull())
    n = written(sizes(detections, gold, key, gold_key))
    lists = n.groupBy(*key).agg((F.max("n_det") + F.sum("n_gold")).alias("n"))
    m = partial_matches(detections, gold, key, by, lists).groupBy(*gold_key).agg(F.sum("similarity").alias("credit"), F.count("*").alias("pairs"))
    out = (n.where(F.col(by).isNotNull()) if by else n).join(m, gold_key, "left").fillna(0, ["credit", "pairs"])
    mean = F.when((F.col("n_det") == 0) | (F.col("n_gold") == 0) | (F.col("pairs") == 0), 0.0).otherwise(F.col("credit") / F.col("pairs"))
    return out.select(*gold_key, *rates(F.col("credit"), F.col("n_det"), F.col("n_gold")), rounded(mean).alias("partial_credit"))


def distractor_rate(detections: DataFrame, distractors: DataFrame, key: list[str]) -> DataFrame:
    """Share of distractors whose references some detection has, for each key with distractors."""
    hit = detections.select(*key, "refs").distinct().withColumn("hit", F.lit(1))
    return distractors.join(hit, [*key, "refs"], "left").groupBy(*key).agg(F.count("*").alias("n_distractors"), F.count("hit").alias("n_flagged")).withColumn("rate", F.round(F.col("n_flagged") / F.col("n_distractors"), 6))


def merged(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Two lists of detections (key, ord, refs, confidence) merged by reference set.

    Where one list of a key is empty the other stays as it is. Else the first of the first list's detections of a
    set gives way to the second list's most confident one of that set, if that is strictly more confident; later
    ones of the set stay; sets that only the second list has come with their most confident (earliest) detection.
    """
    tag = lambda x, side: x.withColumn("side", F.lit(side)).withColumn("set", F.array_sort(F.array_distinct("refs")))
    both = tag(first, 1).unionByName(tag(second, 2))
    whole, part = Window.partitionBy(*key), Window.partitionBy(*key, "set")
    both = both.withColumn("lone", F.min("side").over(whole) == F.max("side").over(whole))
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "set", "side").orderBy(F.when(F.col("side") == 2, -F.col("confidence")), "ord")))
    both = both.withColumn("best", F.max(F.when((F.col("side") == 2) & (F.col("nth") == 1), F.struct("confidence", "ord"))).over(part)).withColumn("has", F.max(F.when(F.col("side") == 1, 1)).over(part))
    kept = both.where("lone or side = 1 or (nth = 1 and has is null)")
    swap = ~F.col("lone") & (F.col("side") == 1) & (F.col("nth") == 1) & (F.col("best.confidence") > F.col("confidence"))
    return kept.select(*key, F.when(swap, 2).otherwise(F.col("side")).alias("side"), F.when(swap, F.col("best.ord")).otherwise(F.col("ord")).alias("ord"), F.col("set").alias("refs"), F.when(swap, F.col("best.confidence")).otherwise(F.col("confidence")).alias("confidence"))


def representation(gold: DataFrame, system: DataFrame, key: list[str]) -> DataFrame:
    """Coverage of the gold triples by the system's, and accuracy of the system's sourced triples, for each key."""
    norm = lambda x: [F.lower(F.trim(F.col(c).cast("string"))).alias(c) for c in ("subject", "predicate", "object")]
    g, s = gold.select(*key, *norm(gold)).distinct(), system.select(*key, *norm(system)).distinct()
    gs, ss = gold.select(*key, *norm(gold), "document").distinct(), system.select(*key, *norm(system), "document").distinct()
    count = lambda x, name: x.groupBy(*key).agg(F.count("*").alias(name))
    out = count(g, "g").join(count(g.intersect(s), "both"), key, "full").join(count(ss, "s"), key, "full").join(count(gs.intersect(ss), "sourced"), key, "full").fillna(0)
    return out.select(*key, F.round(F.when(F.col("g") == 0, 0.0).otherwise(F.col("both") / F.col("g")), 6).alias("coverage"), F.round(F.when((F.col("g") == 0) & (F.col("s") == 0), 0.0).when(F.col("s") == 0, 0.0).otherwise(F.col("sourced") / F.col("s")), 6).alias("accuracy"))
