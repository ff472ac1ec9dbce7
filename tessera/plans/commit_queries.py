"""Queries over tables that are written and read back: versions, replaced sources, parted rows; and first ranges; with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import folder
from tessera.operators.ranges import first_range
from tessera.plans import tables as T
from tessera.plans.registry import query
from tessera.sources import datasets as D
from tessera.sources import versions as V


@query("replaced_sources", """with m as (select source as source_id, lang, count(*)::bigint as documents from documents where source is not null group by all)
select source_id, lang, case when regexp_extract(source_id, '[0-9]+$')::int % 3 = 0 then documents * 2 else documents end as documents from m where not (regexp_extract(source_id, '[0-9]+$')::int % 3 = 0 and lang = 'en')""")
def replaced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of documents by source in which every third source is replaced: other counts, and no English."""
    m = T.table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("source_id"), "lang").agg(F.count("*").alias("documents"))
    path = folder(spark)
    V.replaced(m, path)
    V.replaced(m.where("cast(regexp_extract(source_id, '[0-9]+$', 0) as int) % 3 = 0 and lang <> 'en'").withColumn("documents", F.col("documents") * 2), path)
    return spark.read.schema("lang string, documents long, source_id string").parquet(path).select("source_id", "lang", "documents")


@query("package_versions", f"""with g as (select * from {T.GOLD_SQL}), v as (select 'v1' as version, null::varchar as base, * from g where label_idx % 2 = 0 union all select 'v2', 'v1', * from g)
select version, base, (select count(*) from documents)::bigint as documents, count_if(scope = 'intra_doc')::bigint as intra_doc, count_if(scope = 'inter_doc')::bigint as inter_doc, sum(label_idx)::bigint as label_sum from v group by 1, 2""")
def package_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a dataset, the second with the first as its base, read back by their markers."""
    path, gold = folder(spark), T.gold(spark, sf_dir).withColumn("mechanism", F.lit("entity_swap"))
    docs = T.docs(spark, sf_dir).select("case_id", "doc_ord")
    for version, base, labels in (("v1", None, gold.where("label_idx % 2 = 0")), ("v2", "v1", gold)):
        D.write_package({"docs": docs, "labels": labels, "distractors": labels.limit(0)}, path, version, base)

    def told(version: str) -> DataFrame:
        manifest = V.read_version(spark, path, version, "dataset_manifest").select("version", F.col("document_count").alias("documents"), "intra_doc", "inter_doc")
        sums = V.read_version(spark, path, version, "labels").agg(F.sum("label_idx").alias("label_sum")).withColumn("version", F.lit(version))
        return manifest.join(sums, "version")

    return V.markers(spark, path).select("version", "base").join(reduce(DataFrame.unionByName, map(told, ("v1", "v2"))), "version")


@query("parted_labels", f"""with g as (select label_idx, not scope in ('intra_doc') as s, label_idx % 4 = 0 as d, label_idx % 5 = 0 as c from {T.GOLD_SQL})
select unnest(['rows', 'sound', 'faulty', 'scope', 'difficulty', 'char_start']) as kind, unnest([count(*), count_if(not (s or d or c)), count_if(s or d or c), count_if(s), count_if(d), count_if(c)])::bigint as n, unnest([count(*), count_if(not (s or d or c)), count_if(s or d or c), 0, 0, 0])::bigint as written from g""")
def parted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of sound and faulty labels from the pass that writes them apart, beside those of what was written."""
    g = T.gold(spark, sf_dir)
    kinds = {"scope": F.col("scope") != "intra_doc", "difficulty": F.col("label_idx") % 4 == 0, "char_start": F.col("label_idx") % 5 == 0}
    good, bad, counts = V.parted(g.select("label_idx", "scope"), F.array_compact(F.array(*[F.when(c, k) for k, c in kinds.items()])), list(kinds), folder(spark))
    n = {"sound": good.count(), "faulty": bad.count()}
    n["rows"] = n["sound"] + n["faulty"]
    return spark.createDataFrame([(k, v, n.get(k, 0)) for k, v in counts.items()], "kind string, n long, written long")


@query("first_open_sale", """with s as (select sale_id, sold_at::date as a, sold_at::date + (sale_id % 45 - 2)::int as b from sales), d as (select day, min(sale_id) as sale_id from (select distinct valid_at::date as day from client_changes) left join s on day between a and b group by day)
select change_id, sale_id from client_changes left join d on d.day = valid_at::date""")
def first_open_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sale that was open, for up to 42 days, when a client changed."""
    sales = T.table(spark, sf_dir, "sales").select("sale_id", F.to_date("sold_at").alias("start"), F.expr("date_add(to_date(sold_at), cast(sale_id % 45 - 2 as int))").alias("end"))
    return first_range(T.table(spark, sf_dir, "client_changes").select("change_id", "valid_at"), sales, "valid_at", "sale_id").select("change_id", "sale_id")
