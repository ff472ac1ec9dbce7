"""Queries over the graphs of claims, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import written
from tessera.operators import graph as G
from tessera.plans import tables as T
from tessera.plans.registry import query

C = f"c as materialized (select * from {T.CLAIM_SQL})"


def pairs_sql(name: str, group: str, member: str = "document") -> str:
    on = " and ".join(f"x.{g} = y.{g}" for g in group.split(", "))
    return f"{name}_ as (select distinct {group}, {member} as m from c), {name} as materialized (select x.m as a, y.m as b, count(*)::bigint as weight from {name}_ x join {name}_ y on {on} and x.m < y.m group by all)"


FACTS, ENTITIES = pairs_sql("facts", "subject, predicate"), pairs_sql("ents", "subject")
EDGES = f"{C}, {FACTS}, {ENTITIES}, e as materialized (select a, b, weight, 'shared_fact' as kind from facts union all select a, b, weight, 'shared_entity' from ents anti join facts using (a, b)), both_ as materialized (select a, b from e union all select b, a from e)"
TOP = "select {k}, first(category order by n desc, first, category desc) as top_category from (select {k}, category, count(*) as n, min(claim_id) as first from c group by all) group by 1"


@query("doc_nodes", f"with {C} select document, claims, top_category from (select document, count(*)::bigint as claims from c group by 1) join ({TOP.format(k='document')}) using (document)")
def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.document_nodes(T.claims(spark, sf_dir))


@query("doc_shared_entity_edges", f"with {C}, {ENTITIES} select * from ents")
def doc_shared_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.co_members(T.claims(spark, sf_dir), ["subject"], "document")


@query("doc_shared_fact_edges", f"with {C}, {FACTS} select * from facts")
def doc_shared_fact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.co_members(T.claims(spark, sf_dir), ["subject", "predicate"], "document")


@query("doc_graph_edges", f"with {EDGES} select * from e")
def doc_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.document_edges(T.claims(spark, sf_dir))


@query("entity_nodes", f"""with {C} select subject, claims, documents, predicates, top_category from (select subject, count(*)::bigint as claims, count(distinct document)::bigint as documents, array_to_string(list_sort(list(distinct predicate))[1:5], ',') as predicates from c group by 1 having count(*) >= 3)
join ({TOP.format(k='subject')}) using (subject)""")
def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entity_nodes(T.claims(spark, sf_dir))


def link_sql(member: str) -> str:
    return f"r as (select distinct link_id, relation, m from (select link_id, relation, unnest(claim_ids) as claim_id from {T.LINK_SQL}) join (select claim_id, {member} as m from c) using (claim_id)), le as (select x.m as a, y.m as b, min(x.link_id) as link_id, arg_min(x.relation, x.link_id) as relation from r x join r y on x.link_id = y.link_id and x.m < y.m group by all)"


@query("entity_link_edges", f"with {C}, {link_sql('subject')} select * from le")
def entity_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.link_edges(T.links(spark, sf_dir), T.claims(spark, sf_dir).select("claim_id", F.col("subject").alias("member")))


@query("claim_graph_edges", f"with {C}, {link_sql('claim_id')} select * from le")
def claim_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.link_edges(T.links(spark, sf_dir), T.claims(spark, sf_dir).select("claim_id", F.col("claim_id").alias("member")))


@query("entity_cooccurrence", f"with {C}, {pairs_sql('co', 'document', 'subject')}, {link_sql('subject')} select co.* from co anti join le using (a, b) where weight >= 2")
def entity_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.claims(spark, sf_dir)
    seen = G.link_edges(T.links(spark, sf_dir), c.select("claim_id", F.col("subject").alias("member")))
    return G.co_members(c, ["document"], "subject").where("weight >= 2").join(seen, ["a", "b"], "left_anti")


@query("node_annotations", f"""with {C}, l as (select l_suppkey as label_idx, l_orderkey as document from lineitem where l_linenumber = 1)
select subject, count(distinct label_idx)::bigint as labels from (select distinct subject, document from c) left join l using (document) group by 1""")
def node_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that reach each entity through the documents that they refer to."""
    labels = T.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("label_idx"), F.col("l_orderkey").alias("document"))
    return T.claims(spark, sf_dir).select("subject", "document").distinct().join(labels, "document", "left").groupBy("subject").agg(F.countDistinct("label_idx").alias("labels"))


@query("node_degree", f"with {EDGES}, d as (select a as node, count(*)::bigint as degree from both_ group by 1) select node, degree, round(sqrt(degree / (select max(degree) from d)), 6) as size, degree >= 10 as hub from d")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(G.document_edges(T.claims(spark, sf_dir))).withColumn("size", F.round("size", 6))


KIND = "'c' || (document % 4)"


@query("graph_filter", f"with {EDGES} select e.* from e where kind = 'shared_entity' and 'c' || (a % 4) <> 'c0' and 'c' || (b % 4) <> 'c0' and a in (select document from c) and b in (select document from c)")
def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.claims(spark, sf_dir)
    nodes = c.select(F.col("document").alias("node")).distinct().withColumn("kind", F.concat(F.lit("c"), (F.col("node") % 4).cast("string")))
    return G.filtered(nodes, G.document_edges(c), exclude=["c0"], edge_include=["shared_entity"])[1].select("a", "b", "weight", "kind")


@query("graph_search", "select p_partkey, p_name from part where contains(lower(p_name), '12') or contains(p_partkey::varchar, '12')")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part")
    return p.where(G.matches(F.col("p_name"), F.col("p_partkey").cast("string"), " 12 ")).select("p_partkey", "p_name")


@query("khop_neighborhood", f"""with {EDGES}, h0 as (select min(a) as node from both_), h1 as (select distinct b as node from both_ where a in (select node from h0) and b not in (select node from h0)),
h2 as (select distinct b as node from both_ where a in (select node from h1) and b not in (select node from h0) and b not in (select node from h1))
select node, 0 as hops from h0 union all select node, 1 from h1 union all select node, 2 from h2""")
def khop_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = written(G.document_edges(T.claims(spark, sf_dir)))
    return G.k_hops(e, G.ends(e).agg(F.min("a").alias("node")), 2)


@query("bfs_depth", f"""with recursive {EDGES}, root as (select a as node from both_ group by 1 order by count(*) desc, a limit 1),
w as (select node, 0 as depth from root union select b, depth + 1 from w join both_ on a = node where depth < 40), s as (select node, min(depth) as depth from w group by 1)
select document as node, coalesce(depth, (select max(depth) + 1 from s))::int as depth from (select distinct document from c) left join s on node = document""")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.claims(spark, sf_dir)
    return G.depths(G.document_edges(c), c.select(F.col("document").alias("node")).distinct())


@query("connected_components", f"with recursive {C}, {ENTITIES}, b2 as materialized (select a, b from ents where weight >= 2 union all select b, a from ents where weight >= 2), r as (select distinct a as node, a as component from b2 union select b, component from r join b2 on a = node) select node, min(component) as component from r group by 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(G.co_members(T.claims(spark, sf_dir), ["subject"], "document").where("weight >= 2"))


@query("communities")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Louvain is iterative and not SQL; tests hold it against known partitions."""
    return G.communities(G.co_members(T.claims(spark, sf_dir), ["subject"], "document").where("weight >= 2"))


@query("grid_layout", "with n as (select p_partkey as node, row_number() over (order by p_partkey) - 1 as i, greatest(1, ceil(sqrt(count(*) over ())))::bigint as columns from part) select node, (i % columns * 40.0)::double as x, (floor(i / columns) * 40.0)::double as y from n")
def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grid(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@query("circle_layout", "with n as (select p_partkey as node, row_number() over (order by p_partkey) - 1 as i, count(*) over () as n from part) select node, round(sqrt(n) * 30.0 * cos(2 * pi() * i / n), 4) + 0.0 as x, round(sqrt(n) * 30.0 * sin(2 * pi() * i / n), 4) + 0.0 as y from n")
def circle_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.circle(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))
    return x.select("node", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query("note_export", f"""with {EDGES}, n as (select a as node, string_agg('- [[' || b || ']]', chr(10) order by b) as near from (select distinct a, b from both_) group by 1)
select 'notes/' || document || '.md' as path, md5('---' || chr(10) || 'id: ' || document || chr(10) || '---' || chr(10) || '# order ' || document || chr(10) || chr(10) || coalesce(near, '')) as digest from (select distinct document from c) left join n on node = document""")
def note_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.claims(spark, sf_dir)
    nodes = c.select(F.col("document").alias("node")).distinct().withColumn("title", F.concat(F.lit("order "), F.col("node").cast("string")))
    return G.note_bodies(nodes, G.document_edges(c)).select("path", F.md5("body").alias("digest"))
