"""Queries of notes, layouts, filters, gates, totals and metered calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import written
from tessera.operators import audit as A
from tessera.operators import classify as K
from tessera.operators import graph as G
from tessera.operators import notes as N
from tessera.operators import profiles as P
from tessera.plans import tables as T
from tessera.plans import text_queries as Q
from tessera.plans.graph_queries import EDGES, C, link_sql
from tessera.plans.registry import query
from tessera.sources import datasets as D

VAULT = f"""{C}, d as (select o_orderkey as document, 'text of ' || o_orderkey as content from orders where o_orderkey % 5 <> 0),
lab as (select label_idx as label_id, case when label_idx % 2 = 0 then 'contradiction' else 'distractor' end as kind, scope, detectability, rationale, case when label_idx % 6 = 0 then [label_idx, label_idx] else [label_idx] end as refs from {T.GOLD_SQL}),
lk as (select link_id, len(claim_ids) > 2 as cluster, relation, case when link_id % 2 = 0 then 'theme: ' || relation else '' end as theme, case when link_id % 7 = 0 then list_append(claim_ids, -1) else claim_ids end as claim_ids from {T.LINK_SQL}),
ats as (select link_id, cluster, relation, theme, i as pos, claim_ids[i] as claim_id from lk, range(1, len(claim_ids) + 1) r(i)),
dc as (select document, count(*) as n, string_agg('- [[' || claim_id || ']]', E'\\n' order by claim_id) as l from c group by 1),
dl as (select document, kind, count(*) as n, string_agg('- [[' || label_id || ']]', E'\\n' order by label_id) as l from (select kind, label_id, unnest(refs) as document from lab) group by all),
dn as (select 'documents/' || a.document || '.md' as path, E'---\\ntype: document\\ndocument_id: ' || a.document || E'\\nclaim_count: ' || coalesce(dc.n, 0) || E'\\ncontradiction_count: ' || coalesce(x.n, 0) || E'\\ndistractor_count: ' || coalesce(y.n, 0)
  || E'\\ntags:\\n  - document' || case when x.n > 0 then E'\\n  - contradiction-host' else '' end || case when y.n > 0 then E'\\n  - distractor-host' else '' end || E'\\n---\\n\\n# ' || a.document || E'\\n\\n'
  || coalesce(E'## Claims sourced from this document\\n\\n' || dc.l || E'\\n\\n', '') || coalesce(E'## Contradictions involving this document\\n\\n' || x.l || E'\\n\\n', '') || coalesce(E'## Distractors involving this document\\n\\n' || y.l || E'\\n\\n', '')
  || coalesce(E'## Original content\\n\\n' || content, '') as body
  from (select document from d union select document from c) a left join d on d.document = a.document left join dc on dc.document = a.document left join dl x on x.document = a.document and x.kind = 'contradiction' left join dl y on y.document = a.document and y.kind = 'distractor'),
cx as (select claim_id, string_agg('- [[' || link_id || ']] (' || relation || ')', E'\\n' order by link_id, pos) as l from ats where not cluster group by 1),
cc as (select claim_id, string_agg('- [[' || link_id || ']] — ' || case when theme = '' then relation else theme end, E'\\n' order by link_id, pos) as l from ats where cluster group by 1),
cn as (select 'claims/' || c.claim_id || '.md' as path, E'---\\ntype: claim\\nclaim_id: ' || c.claim_id || E'\\nsubject: ' || subject || E'\\npredicate: ' || predicate || E'\\nobject: ' || object || E'\\ncategory: ' || category || E'\\nsource_document: ' || document || E'\\nconfidence: 0.9'
  || E'\\ntags:\\n  - claim\\n  - category/' || category || E'\\n  - predicate/' || predicate || E'\\n  - doc/' || document || E'\\n---\\n\\n# ' || c.claim_id || ' — ' || subject || ' `' || predicate || '` ' || object || E'\\n\\nSource: [[' || document || E']]\\n\\n'
  || coalesce(E'## Cross-references\\n\\n' || cx.l || E'\\n\\n', '') || coalesce(E'## Clusters\\n\\n' || cc.l, '') as body from c left join cx on cx.claim_id = c.claim_id left join cc on cc.claim_id = c.claim_id),
lm as (select link_id, count(*) as n, string_agg(case when claim_id = -1 then '- `-1` (claim not found)' else '- [[' || claim_id || ']]' end, E'\\n' order by pos) as l from ats group by 1),
ln as (select case when cluster then 'clusters/' else 'xrefs/' end || link_id || '.md' as path, case when cluster
  then E'---\\ntype: cluster\\ncluster_id: ' || link_id || E'\\nrelation: ' || relation || E'\\ntheme: ' || case when theme = '' then '""' else '"' || theme || '"' end || E'\\nmember_count: ' || n || E'\\ntags:\\n  - cluster\\n  - rel/' || relation || E'\\n---\\n\\n# ' || link_id || ' — ' || case when theme = '' then relation || E'\\n\\n' else theme || E'\\n\\nRelation: `' || relation || E'`\\n\\n' end
  else E'---\\ntype: xref\\nxref_id: ' || link_id || E'\\nrelationship_type: ' || relation || E'\\nmember_count: ' || n || E'\\ntags:\\n  - xref\\n  - rel/' || relation || E'\\n---\\n\\n# ' || link_id || ' — ' || relation || E'\\n\\n' || case when theme = '' then '' else '> ' || theme || E'\\n\\n' end end || E'## Members\\n\\n' || l as body from lk join lm using (link_id)),
an as (select kind || 's/' || label_id || '.md' as path, E'---\\ntype: ' || kind || E'\\nlabel_id: ' || label_id || E'\\nscope: ' || scope || E'\\ndetectability: ' || detectability || E'\\ntags:\\n  - ' || kind || E'\\n  - scope/' || scope || E'\\n  - detectability/' || detectability || E'\\n---\\n\\n# ' || label_id || E'\\n\\n> ' || rationale || E'\\n\\n'
  || case kind when 'contradiction' then E'## Texts\\n\\n**Modified:** as said\\n\\n' else E'**modified_text:** as said\\n\\n' end || E'## Documents involved\\n\\n' || array_to_string(list_transform(refs, lambda r: '- [[' || r || ']]'), E'\\n') as body from lab)"""


@query("note_vault", f"with {VAULT} select path, md5(rtrim(body, E' \\n') || E'\\n') as digest from (from dn union all from cn union all from ln union all from an)")
def note_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of orders as documents, line items as claims, their links, and labels of both kinds."""
    docs = T.table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("document"), F.concat(F.lit("text of "), F.col("o_orderkey").cast("string")).alias("content"))
    idx = F.col("label_idx")
    labels = T.gold(spark, sf_dir).select(
        idx.alias("label_id"), idx.alias("ord"), F.when(idx % 2 == 0, "contradiction").otherwise("distractor").alias("kind"), "scope", F.lit(None).cast("string").alias("mechanism"), "detectability", "rationale",
        F.lit("").alias("original_text"), F.lit("as said").alias("modified_text"), F.when(idx % 6 == 0, F.array(idx, idx)).otherwise(F.array(idx)).alias("refs"),
    )
    links = T.links(spark, sf_dir).select(
        "link_id", (F.size("claim_ids") > 2).alias("cluster"), "relation", F.when(F.col("link_id") % 2 == 0, F.concat(F.lit("theme: "), "relation")).otherwise("").alias("theme"),
        F.when(F.col("link_id") % 7 == 0, F.concat("claim_ids", F.array(F.lit(-1).cast("bigint")))).otherwise(F.col("claim_ids")).alias("claim_ids"),
    )
    claims = T.claims(spark, sf_dir).withColumn("confidence", F.lit(0.9))
    return N.vault(docs, claims, links, labels).select("path", F.md5("body").alias("digest"))


@query("rings_layout", f"""with recursive {EDGES}, root as (select a as node from both_ group by 1 order by count(*) desc, a limit 1),
w as (select node, 0 as depth from root union select b, depth + 1 from w join both_ on a = node where depth < 40), s as (select node, min(depth) as depth from w group by 1), m as (select max(depth) as deepest from s),
x as (select document as node, coalesce(depth, deepest + 1) as depth, deepest from (select distinct document from c) left join s on node = document, m),
y as (select node, depth / (greatest(deepest, 1) + 0.5) as r, 2 * pi() * (row_number() over (partition by depth order by node::varchar) - 1) / count(*) over (partition by depth) as t from x)
select node, round(r * cos(t), 6) + 0.0 as x, round(r * sin(t), 6) + 0.0 as y from y""")
def rings_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.claims(spark, sf_dir)
    found = G.rings(G.document_edges(c), c.select(F.col("document").alias("node")).distinct())
    return found.select("node", (F.round("x", 6) + F.lit(0.0)).alias("x"), (F.round("y", 6) + F.lit(0.0)).alias("y"))


@query("edge_widths", f"with {EDGES} select a, b, round(greatest(0.5, least(2.0, 0.5 + log2(weight + 1) * 0.5)), 6)::double as width from e")
def edge_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.document_edges(T.claims(spark, sf_dir)).select("a", "b", F.round(G.edge_width(F.col("weight")), 6).alias("width"))


@query("edge_lookup", f"with {EDGES} select x.a, x.b, kind from (select b as a, a as b from e where a % 3 = 0 union all select a, b from e where a % 3 = 1) x join e on least(x.a, x.b) = e.a and greatest(x.a, x.b) = e.b")
def edge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges looked up by their ends, a third of them turned round and a third not asked for."""
    e = written(G.document_edges(T.claims(spark, sf_dir)))
    asked = e.where("a % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")).union(e.where("a % 3 = 1").select("a", "b"))
    return G.edges_between(e, asked).select("a", "b", "kind")


@query("visible_counts", f"""with {EDGES}, n as (select distinct document as node from c where document % 4 <> 0 and document % 7 > 0 and document % 2 = 1)
select (select count(*) from n)::bigint as nodes, (select count(*) from n where contains(node::varchar, '12'))::bigint as matches, (select count(*) from e where kind = 'shared_entity' and a in (from n) and b in (from n))::bigint as edges""")
def visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an overlay, a focus and filters of kinds leave, and how much of it a search finds."""
    c = T.claims(spark, sf_dir)
    key = F.col("node")
    nodes = c.select(F.col("document").alias("node")).distinct().withColumns({"kind": F.concat(F.lit("c"), (key % 4).cast("string")), "label": F.concat(F.lit("order "), key.cast("string")), "contradictions": key % 7})
    return G.visible(nodes, G.document_edges(c), ["contradictions"], nodes.where("node % 2 = 1"), " 12 ", exclude=["c0"], edge_include=["shared_entity"])[2]


@query("claim_loops", f"""with {C}, {link_sql('claim_id')}, l as (select min(link_id) as link_id, arg_min(relation, link_id) as relation, claim_ids[1] as x from {T.LINK_SQL} where link_id % 2 = 0 group by claim_ids[1])
select a, b, link_id, relation from le union all select x, x, link_id, relation from l""")
def claim_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of claims where every other link names its first claim twice, and each a claim that is not there."""
    twice = F.when(F.col("link_id") % 2 == 0, F.concat("claim_ids", F.slice("claim_ids", 1, 1))).otherwise(F.col("claim_ids"))
    links = T.links(spark, sf_dir).withColumn("claim_ids", F.concat(twice, F.array(F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint"))))
    return G.claim_edges(links, T.claims(spark, sf_dir))


GATES = Q.quality_gates_sql()
TOLD = {i: "case gate " + " ".join(f"when '{k}' then '{v[i]}'" for k, v in P.ACTIONS.items()) + " end" for i in (0, 1)}


@query("gate_actions", f"select *, {TOLD[0]} as metric, case when passed then '' else {TOLD[1]} end as action from ({GATES})")
def gate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gate_report(Q.quality_gates(spark, sf_dir))


@query("gates_failed", f"select bool_and(passed) as passed, coalesce(string_agg(gate, ',' order by gate) filter (where not passed), '') as failed from ({GATES})")
def gates_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.failed_gates(Q.quality_gates(spark, sf_dir)).withColumn("failed", F.array_join("failed", ","))


@query("taxonomy_notes", f"""with {Q.TYPED}, k as (select unnest([{', '.join(repr(x) for x in K.CANONICAL_TYPES)}]) as t, unnest(range({len(K.CANONICAL_TYPES)})) as i), g as (select string_agg(t, ', ' order by i) as gone, bool_or(t = 'press_coverage') as press from k where t not in (select document_type from t where document_type is not null) having count(*) > 0)
select 'Types not found in scraped data: ' || gone as note from g union all select 'press_coverage is expected absent: such sources don''t hold press articles' from g where press""")
def taxonomy_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.taxonomy_notes(P.taxonomy(Q.typed(spark, sf_dir)))


SHARES = "(select string_agg({f} || '=' || round(n / s, 6), ',' order by {f}) from (select {f}, count(*) as n, sum(count(*)) over () as s from m group by 1))"


@query("dataset_totals", f"""with g as (select *, case label_idx % 3 when 0 then 'numeric_drift' when 1 then 'entity_swap' else 'unknown' end as mechanism from {T.GOLD_SQL}), m as (select * from g where label_idx % 5 <> 0)
select (select count(distinct source) from documents)::bigint as case_count, (select count(*) from documents)::bigint as document_count, (select count_if(scope = 'intra_doc') from m)::bigint as intra_doc, (select count_if(scope = 'inter_doc') from m)::bigint as inter_doc, (select count(*) from g where label_idx % 5 = 0)::bigint as distractor_count,
  {SHARES.format(f='mechanism')} as mechanism, {SHARES.format(f='detectability')} as detectability""")
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's manifest: every fifth label is a distractor, every third has no mechanism."""
    idx = F.col("label_idx")
    g = T.gold(spark, sf_dir).withColumn("mechanism", F.when(idx % 3 == 0, "numeric_drift").when(idx % 3 == 1, "entity_swap"))
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 6).cast("string"))), ",").alias(c)
    found = D.manifest(T.docs(spark, sf_dir), g.where("label_idx % 5 <> 0"), g.where("label_idx % 5 = 0"))
    return found.select("case_count", "document_count", "intra_doc", "inter_doc", "distractor_count", told("mechanism"), told("detectability"))


PARTS = "(select p_brand as source_id, p_size as case_id, p_type as document_type from part)"


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents of sources and cases."""
    return T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_id"), F.col("p_size").alias("case_id"), F.col("p_type").alias("document_type"))


@query("corpus_totals", f"select count(distinct source_id)::bigint as total_sources, count(distinct source_id || '/' || case_id)::bigint as total_cases, count(*)::bigint as total_documents, string_agg(distinct document_type, ',' order by document_type) as types from {PARTS}")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.corpus_totals(part_documents(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


@query("case_types", f"select source_id, case_id, sum(n)::bigint as documents, string_agg(document_type || '=' || n, ',' order by document_type) as types from (select source_id, case_id, document_type, count(*) as n from {PARTS} group by all) group by all")
def case_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return D.case_types(part_documents(spark, sf_dir)).withColumn("types", told)


@query("dry_run_estimates", "select doc_id, 'Dry run: ' || (length(text) // 4) || ' input tokens, $' || round((length(text) // 4)::decimal(18,0) * 0.000003::decimal(18,9), 4) as estimate from documents")
def dry_run_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dry_run(T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))).select("doc_id", "estimate")


def shouted(prompt: str) -> tuple[str | None, int, int]:
    """A stand-in for a model: short prompts have no answer, others one of half their tokens."""
    return (prompt.upper() if len(prompt) >= 200 else None, len(prompt) // 4, len(prompt) // 8)


@query("call_usage", "select sum(length(text) // 4)::bigint as prompt_tokens, sum(length(text) // 8)::bigint as completion_tokens, (sum(length(text) // 4) + sum(length(text) // 8))::bigint as total_tokens, round(sum(length(text) // 4) / 1000000.0 * 3.0 + sum(length(text) // 8) / 1000000.0 * 15.0, 6) as cost from documents where length(text) >= 200")
def call_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of a call for each document; calls without an answer have none."""
    return A.usage_summary(A.metered(T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt")), A.Client(shouted)))
