"""Replacement of phrases by a map of any size: phrases meet the words that begin them, and the longest of those that overlap holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import sized, written

#: A word or a single other character, with the white space before it.
PIECE = r"(?U)\s*(?:\w+|[^\w\s])"
SPAN = "array<struct<start: int, many: int, size: int, original: string, anonymized: string>>"


def pieces(text: Column) -> Column:
    """The pieces that make up a text, but for white space at its end."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def plain_pieces(text: Column) -> Column:
    """The pieces of a text, any white space before one as one space."""
    return pieces(F.regexp_replace(text, r"(?U)\s+", " "))


def phrases(mapping: DataFrame) -> DataFrame:
    """(phrase, many, key, original, anonymized): each phrase of a map (original, anonymized) once, with its number of pieces and the first two of them (or the only one). Of entries with one phrase the least holds; empty ones are left out; a null replacement is empty."""
    cut = mapping.select(F.trim("original").alias("original"), F.coalesce("anonymized", F.lit("")).alias("anonymized")).withColumn("p", plain_pieces(F.col("original"))).where("size(p) > 0")
    out = cut.select(F.ltrim(F.array_join("p", "")).alias("phrase"), F.size("p").alias("many"), F.ltrim(F.array_join(F.slice("p", 1, 2), "")).alias("key"), "original", "anonymized")
    return out.groupBy("phrase", "many", "key").agg(F.min(F.struct("original", "anonymized")).alias("x")).select("phrase", "many", "key", "x.*")


def occurrences(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, start, many, size, original, anonymized): where phrases of the map stand in ``docs`` (doc_id, content), by pieces, overlapping or not.

    A place meets the map only if a phrase begins with its first two pieces (or is its first alone), by a join that
    gives the numbers of pieces to look at; what these make up meets the map in a second join. Where the beginnings are
    counted small they go to the documents, whose pieces stay in place; else both sides are shuffled by hashed keys,
    places with as many pieces as the longest phrase. An entry's many occurrences are rows of their documents.
    """
    known = written(phrases(mapping))
    begins = written(known.select("key", "many").distinct())
    small = sized(begins)
    cut = docs.select("doc_id", plain_pieces(F.col("content")).alias("p"))
    if small is begins:
        most = begins.agg(F.max("many")).first()[0]
        starts = cut.select("doc_id", F.posexplode(F.transform("p", lambda x, i: F.slice("p", i + 1, most))).alias("start", "p")).withColumn("at", F.lit(0))
    else:
        starts = cut.select("doc_id", "p", F.posexplode("p").alias("start", "piece")).drop("piece").withColumn("at", F.col("start"))
    first, second = F.ltrim(F.get("p", F.col("at"))), F.coalesce(F.get("p", F.col("at") + 1), F.lit(""))
    # No piece reads as two do, so that no phrase is found by both keys.
    keys = starts.withColumn("key", F.explode(F.when(second == "", F.array(first)).otherwise(F.array(first, F.concat(first, second)))))
    met = keys.join(small, "key").where("size(p) - at >= many")
    found = met.select("doc_id", "start", F.ltrim(F.array_join(F.slice("p", F.col("at") + 1, F.col("many")), "")).alias("phrase")).join(sized(known.drop("key")), "phrase")
    return found.select("doc_id", "start", "many", F.length("original").alias("size"), "original", "anonymized")


def held(found: DataFrame) -> DataFrame:
    """(doc_id, kept): the occurrences that hold, in order of place. Those that overlap one another, at one remove or more, are a cluster, and only clusters are settled as a whole."""
    order = Window.partitionBy("doc_id").orderBy("start", "many", "original")
    before = F.max(F.col("start") + F.col("many")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("opens", (F.coalesce(before, F.lit(0)) <= F.col("start")).cast("long")).withColumn("cluster", F.sum("opens").over(order))
    span = F.struct("start", "many", "size", "original", "anonymized")
    clusters = parted.groupBy("doc_id", "cluster").agg(F.collect_list(span).cast(SPAN).alias("spans"))
    return clusters.select("doc_id", settled(F.col("spans")).alias("kept")).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("kept"))).alias("kept"))


def settled(spans: Column) -> Column:
    """The spans that hold, in order of place: the longest first, then by phrase and place, each unless it overlaps one before it."""
    order = F.transform(spans, lambda s: F.struct((-s["size"]).alias("less"), s["original"].alias("original"), s["start"].alias("start"), s["many"].alias("many"), s["anonymized"].alias("anonymized")))
    kept = F.array().cast("array<struct<start: int, many: int, anonymized: string>>")
    clear = lambda acc, s: ~F.exists(acc, lambda k: (k["start"] < s["start"] + s["many"]) & (s["start"] < k["start"] + k["many"]))
    fold = F.aggregate(F.array_sort(order), kept, lambda acc, s: F.when(clear(acc, s), F.concat(acc, F.array(F.struct(s["start"], s["many"], s["anonymized"]).cast("struct<start: int, many: int, anonymized: string>")))).otherwise(acc))
    return F.array_sort(fold)


def anonymised(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, content, replaced): each document with the map's phrases replaced, and how many were.

    A phrase stands where its words and signs do, whole and in this case, with white space of any length where the
    phrase has some and none where it has none; white space before it stays. Of phrases that overlap the longest (in
    characters) is replaced, then the first by phrase and by place, as if each were replaced in the whole text before
    the next. Null contents stay null; documents have a doc_id that is unique and not null; columns besides doc_id and
    content are dropped; an empty map changes nothing.
    """
    found = held(occurrences(docs, mapping))
    x = docs.select("doc_id", "content").join(found, "doc_id", "left").withColumn("p", F.when(F.size("kept") > 0, pieces(F.col("content"))))
    between = lambda a, b: F.array_join(F.slice("p", a + 1, b - a), "")
    white = lambda i: F.regexp_extract(F.element_at("p", i + 1), r"(?U)^(\s*)", 1)
    # Before each phrase that holds, what follows the one before it.
    after = lambda i: F.coalesce(F.get("kept", i - 1)["start"] + F.get("kept", i - 1)["many"], F.lit(0))
    parts = F.transform("kept", lambda k, i: F.concat(between(after(i), k["start"]), white(k["start"]), k["anonymized"]))
    rest = F.concat(between(after(F.size("kept")), F.size("p")), F.regexp_extract("content", r"(?U)(\s*)\z", 1))
    text = F.concat(F.array_join(parts, ""), rest)
    return x.select("doc_id", F.when(F.size("kept") > 0, text).otherwise(F.col("content")).alias("content"), F.coalesce(F.when(F.size("kept") > 0, F.size("kept")), F.lit(0)).alias("replaced"))
