"""Texts of a docket's files joined with its manifest and assessed, what is kept of that, and notes on entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.profiles import text_quality


def item_number(name: Column) -> Column:
    """The number that a file's name has before its first underscore, else 0."""
    return F.coalesce(F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1)).otherwise(name).try_cast("int"), F.lit(0))


def extracted(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(case_id, name, item_number, title, group, text, word_count, passed) of each of ``files`` (case_id, name, content, error).

    Title and group are those of the case's manifest (``entries``: case_id, pos, item_number, title, group) under the
    number in the file's name, of repeated numbers those of the last; else the name without its ending, and none. A
    file that could not be read has no text, no words and doesn't pass; a null content without an error is blank.
    """
    last = entries.groupBy("case_id", "item_number").agg(F.max_by(F.struct("title", "group"), "pos").alias("entry"))
    x = files.withColumn("item_number", item_number(F.col("name"))).join(last, ["case_id", "item_number"], "left")
    good = F.col("error").isNull()
    x = text_quality(x.withColumn("content", F.when(good, F.coalesce("content", F.lit("")))))
    title = F.when(F.col("entry").isNotNull(), F.col("entry.title")).otherwise(F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""))
    return x.select("case_id", "name", "item_number", title.alias("title"), F.coalesce("entry.group", F.lit("")).alias("group"), F.col("content").alias("text"), F.when(good, F.col("word_count")).otherwise(0).alias("word_count"), F.coalesce(good & F.col("passed"), F.lit(False)).alias("passed"))


def extraction_meta(found: DataFrame) -> DataFrame:
    """(case_id, meta): the JSON object that is kept of a case: files, those that passed and their share, and each file's number, title, words and whether it passed, in order of name."""
    each = F.struct("name", F.struct("item_number", "title", "word_count", "passed").alias("x"))
    per = found.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("clean"), F.transform(F.array_sort(F.collect_list(each)), lambda r: r["x"]).alias("documents"))
    meta = F.struct(F.col("case_id").alias("ntsb_id"), F.col("total").alias("total_pdfs"), F.col("clean").alias("clean_count"), F.bround(F.col("clean") / F.col("total"), 4).alias("clean_rate"), "documents")
    return per.select("case_id", F.to_json(meta).alias("meta"))


def naming_note(variations: DataFrame, most: int = 3) -> DataFrame:
    """(note) on how names vary, by the first ``most`` of ``variations`` (ord, name, aliases); none without any. The wording is fixed."""
    first = variations.orderBy("ord", "name").limit(most)
    example = F.concat(F.lit("'"), "name", F.lit("' appears as: "), F.array_join("aliases", ", "))
    # At most a few rows.
    listed = first.agg(F.array_sort(F.collect_list(F.struct("ord", "name", example.alias("x")))).alias("l")).where("size(l) > 0")
    examples = F.array_join(F.transform("l", lambda r: r["x"]), "; ")
    return listed.select(F.concat(F.lit("Entity naming: real data shows significant naming variation. Examples: "), examples, F.lit(". Templates should use varied entity references to match reality.")).alias("note"))


def connectivity_note(cross: DataFrame) -> DataFrame:
    """(note) on the mean number of cases of a shared entity (``connectivity``), to two places; none where it is 0. The wording is fixed."""
    score = F.format_string("%.2f", "connectivity")
    return cross.where("connectivity > 0").select(F.concat(F.lit("Entity connectivity: observed score of "), score, F.lit(" (avg dockets per shared entity). Use this as baseline for connectivity level 2.")).alias("note"))


def recommendations(templates: DataFrame, variations: DataFrame, cross: DataFrame) -> DataFrame:
    """(ord, note): the notes on templates (document_type, note) in order of type, then those on names and on connectivity."""
    rows = templates.select(F.lit(0).alias("kind"), "document_type", "note")
    rows = rows.union(naming_note(variations).select(F.lit(1), F.lit(""), "note")).union(connectivity_note(cross).select(F.lit(2), F.lit(""), "note"))
    # A row for each type of document and two more.
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("kind", "document_type", "note"))).alias("l"))
    return listed.select(F.posexplode(F.transform("l", lambda r: r["note"])).alias("ord", "note"))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """(report): one JSON object with a list of each part's rows as objects; a part of one row and one column ``value`` is that value. Parts are summaries: rows for cases, types and the first entities."""
    out = None
    for name, df in parts.items():
        row = F.col("value") if df.columns == ["value"] else F.struct(*df.columns)
        listed = df.agg(F.array_sort(F.collect_list(row)).alias(name))
        listed = listed.select(F.get(name, F.lit(0)).alias(name)) if df.columns == ["value"] else listed
        one = listed.withColumn("_k", F.lit(1))
        out = one if out is None else out.join(one, "_k")
    return out.select(F.to_json(F.struct(*parts)).alias("report"))
