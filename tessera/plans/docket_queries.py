"""Queries of extracted dockets and of notes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dockets as K
from tessera.plans import tables as T
from tessera.plans.registry import query
from tessera.plans.text_queries import TYPED


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A file for each document, some unreadable, some without a number; entries for most, some of them twice."""
    d = T.docs(spark, sf_dir)
    k = F.col("doc_ord")
    name = F.concat(F.when(k % 10 == 7, "x").otherwise(F.lpad(k.cast("string"), 6, "0")), F.lit("_T.v"), k.cast("string"), F.lit(".pdf"))
    some = d.select("case_id", name.alias("name"), "content", F.when(k % 17 == 3, "unreadable").alias("error"))
    entries = d.where(k % 5 != 1).select("case_id", F.explode(F.sequence(F.lit(0), (k % 3 == 0).cast("int"))).alias("pos"), k.cast("int").alias("item_number"), "doc_ord")
    return some, entries.select("case_id", "pos", "item_number", F.concat(F.lit("title "), "doc_ord", F.lit("."), "pos").alias("title"), F.concat(F.lit("g"), (F.col("doc_ord") % 4).cast("string")).alias("group"))


FILES = f"""{TYPED}, x as (select case_id, doc_ord as k, case when doc_ord % 10 = 7 then 'x' else lpad(doc_ord::varchar, 6, '0') end || '_T.v' || doc_ord || '.pdf' as name, doc_ord % 17 = 3 as bad, word_count, passed from t),
y as (select *, case when k % 10 = 7 then 0 else k end::int as item_number, k % 10 <> 7 and k % 5 <> 1 and k > 0 as known from x),
z as (select case_id, name, item_number, case when known then 'title ' || k || '.' || (case when k % 3 = 0 then 1 else 0 end) else left(name, length(name) - 4) end as title, case when known then 'g' || (k % 4) else '' end as grp, case when bad then 0 else word_count end as word_count, passed and not bad as passed from y)"""


@query("docket_extraction", f"with {FILES} select case_id, name, item_number, title, grp, word_count, passed from z")
def docket_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents joined with their manifest and assessed. Item 0 is nobody's: documents are numbered from 0, so the entry of the first is left out here."""
    some, entries = files(spark, sf_dir)
    return K.extracted(some, entries.where("item_number > 0")).withColumnRenamed("group", "grp").drop("text")


@query("extraction_meta", f"with {FILES} select case_id, count(*)::varchar as total, count_if(passed)::varchar as clean, round(count_if(passed) / count(*), 4) as rate, count(*)::int as listed, max_by(title, name) as last_title from z group by 1")
def extraction_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    some, entries = files(spark, sf_dir)
    meta = K.extraction_meta(K.extracted(some, entries.where("item_number > 0")))
    shape = "documents array<struct<title: string>>, clean_rate double"
    read = meta.select("case_id", F.get_json_object("meta", "$.total_pdfs").alias("total"), F.get_json_object("meta", "$.clean_count").alias("clean"), F.from_json("meta", shape).alias("m"))
    return read.select("case_id", "total", "clean", F.col("m.clean_rate").alias("rate"), F.size("m.documents").alias("listed"), F.element_at("m.documents.title", -1).alias("last_title"))


@query("recommendation_notes", """with b as (select p_brand, count(*) as n, list_sort(list(distinct p_type)) as types from part group by 1), v as (select p_brand, array_to_string(types[1:2], ', ') as a from b where len(types) > 1 order by p_brand limit 3),
t as (select 0 as kind, p_brand as d, 'Template for ''' || p_brand || ''': ' || n as note from b union all
  select 1, '', 'Entity naming: real data shows significant naming variation. Examples: ' || string_agg('''' || p_brand || ''' appears as: ' || a, '; ' order by p_brand) || '. Templates should use varied entity references to match reality.' from v having count(*) > 0 union all
  select 2, '', 'Entity connectivity: observed score of ' || printf('%.2f', avg(n)) || ' (avg dockets per shared entity). Use this as baseline for connectivity level 2.' from b)
select (row_number() over (order by kind, d) - 1)::int as ord, note from t""")
def recommendation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on brands as types and entities."""
    b = T.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("p_type")).alias("types"))
    templates = b.select(F.col("p_brand").alias("document_type"), F.concat(F.lit("Template for '"), "p_brand", F.lit("': "), F.col("n").cast("string")).alias("note"))
    variations = b.where("size(types) > 1").select(F.lit(0).alias("ord"), F.col("p_brand").alias("name"), F.slice("types", 1, 2).alias("aliases"))
    return K.recommendations(templates, variations, b.agg(F.avg("n").alias("connectivity")))
