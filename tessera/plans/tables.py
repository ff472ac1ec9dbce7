"""The engine's tables, derived from the driver's: documents by case, gold labels and detections from orders, claims from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each source; documents in order of id."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("doc_ord"), F.col("text").alias("content"), "lang")


def order_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order with the sorted list of its suppliers, repeats kept."""
    # Lines of an order lie far apart: lists of parts of it, made before the shuffle, would cost more than they save.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey")
    refs = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_suppkey")).alias("refs"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice").join(refs, "o_orderkey")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Detections and labels of the same orders, whose suppliers are gathered once."""
    orders = written(order_refs(spark, sf_dir).drop("o_totalprice"))
    return detections(spark, sf_dir, orders), gold(spark, sf_dir, orders)


def gold(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """A label for each order, in the report of its customer; ``orders`` are its ``order_refs`` where these are there already."""
    return (order_refs(spark, sf_dir) if orders is None else orders).select(
        F.col("o_custkey").alias("report_id"),
        F.col("o_orderkey").alias("label_idx"),
        "refs",
        F.when(F.col("o_orderstatus") == "F", "intra_doc").otherwise("inter_doc").alias("scope"),
        F.element_at(F.array(*map(F.lit, ("single_hop", "multi_hop", "entity_resolution_dependent"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("detectability"),
        F.concat(F.lit("because "), "o_orderpriority").alias("rationale"),
    )


def detections(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """The same orders as detected: a third as they are, a third without the first supplier, a third with one that is not there; every seventh is missing."""
    third = F.col("o_orderkey") % 3
    refs = F.when(third == 0, F.col("refs")).when(third == 1, F.slice("refs", 2, 100)).otherwise(F.concat("refs", F.array(F.lit(-1).cast("bigint"))))
    return (order_refs(spark, sf_dir) if orders is None else orders).where("o_orderkey % 7 <> 0").select(
        F.col("o_custkey").alias("report_id"),
        F.col("o_orderkey").alias("det_idx"),
        F.sort_array(refs).alias("refs"),
        F.concat(F.lit("found "), "o_orderpriority").alias("description"),
        (F.col("o_orderkey") % 100 / 100.0).alias("confidence"),
    )


ORDER_SQL = "(select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, refs from orders join (select l_orderkey as o_orderkey, list_sort(list(l_suppkey)) as refs from lineitem group by all) using (o_orderkey))"
GOLD_SQL = f"""(select o_custkey as report_id, o_orderkey as label_idx, refs, case when o_orderstatus = 'F' then 'intra_doc' else 'inter_doc' end as scope,
    ['single_hop', 'multi_hop', 'entity_resolution_dependent'][o_orderkey % 3 + 1] as detectability, 'because ' || o_orderpriority as rationale from {ORDER_SQL})"""
DET_SQL = f"""(select o_custkey as report_id, o_orderkey as det_idx, list_sort(case o_orderkey % 3 when 0 then refs when 1 then refs[2:] else list_append(refs, -1) end) as refs,
    'found ' || o_orderpriority as description, o_orderkey % 100 / 100.0 as confidence from {ORDER_SQL} where o_orderkey % 7 <> 0)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each line item: part and quantity (subject), return flag (predicate), line status (object), order (document)."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
        (F.col("l_partkey") * 50 + F.col("l_quantity").cast("bigint")).alias("subject"),
        F.col("l_returnflag").alias("predicate"),
        F.col("l_linestatus").alias("object"),
        F.col("l_orderkey").alias("document"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("category"),
    )


CLAIM_SQL = "(select l_orderkey * 10 + l_linenumber as claim_id, l_partkey * 50 + l_quantity::bigint as subject, l_returnflag as predicate, l_linestatus as object, l_orderkey as document, 'c' || (l_suppkey % 5) as category from lineitem)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link for the claims of one supplier and day that are two or more; relation and rationale from the key."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"))
    return rows.groupBy("l_suppkey", "day").agg(F.sort_array(F.collect_list("claim_id")).alias("claim_ids")).where("size(claim_ids) > 1").select(
        (F.datediff("day", F.lit("1970-01-01")).cast("bigint") * 1000000 + F.col("l_suppkey")).alias("link_id"), F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string")).alias("relation"), "claim_ids"
    )


LINK_SQL = """(select date_diff('day', date '1970-01-01', day) * 1000000 + l_suppkey as link_id, 'r' || (l_suppkey % 3) as relation, claim_ids from
    (select l_suppkey, l_shipdate::date as day, list_sort(list(l_orderkey * 10 + l_linenumber)) as claim_ids from lineitem group by all having count(*) > 1))"""
