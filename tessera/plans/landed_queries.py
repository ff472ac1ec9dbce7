"""Queries of a landed API and of urls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import folder
from tessera.plans import tables as T
from tessera.plans.registry import query
from tessera.sources import corpus as C
from tessera.sources import landed as L

WHERE = "o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderdate < '1998-01-01'"


@query("api_listing", f"select o_orderkey::varchar as o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders where {WHERE.replace('o_orderdate <', "strftime(o_orderdate, '%Y-%m-%d') <")}")
def api_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call's selection from orders that were landed as pages of JSON."""
    o = T.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    # A page has a thousand rows.
    pages = o.groupBy((F.col("o_orderkey") / 1000).cast("long")).agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"))).alias("body"))
    path = folder(spark)
    L.land(pages, path, ["o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"], ["o_orderstatus", "o_orderpriority"], "o_orderdate")
    return L.listed(spark, path, ["o_orderkey", "o_orderdate", "o_orderpriority"], WHERE)


@query("absolute_links", """with l as (select page_id, url, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) as href from pages)
select page_id, href, case when starts_with(href, '/') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || href when not starts_with(href, 'http') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || '/' || href else href end as target from l""")
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.table(spark, sf_dir, "pages")
    return C.links_in(pages).join(pages.select("page_id", "url"), "page_id").select("page_id", "href", L.absolute(F.col("href"), F.col("url")).alias("target"))


@query("url_parameters", """select event_id, props as name, url_decode(url_encode(props)) as value, 'x' as first from events where props is not null and props <> ''""")
def url_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a url's parameters hold, for urls made of events."""
    e = T.table(spark, sf_dir, "events").where("props <> ''")
    url = F.concat(F.lit("https://x.org/a?first=y&"), F.url_encode("props"), F.lit("="), F.url_encode("props"), F.lit("&first=x#end"))
    return e.select("event_id", L.parameters(url).alias("m"), F.col("props").alias("name")).select("event_id", "name", F.col("m")[F.col("name")].alias("value"), F.col("m")["first"].alias("first"))
