"""Queries of summaries, indexes and plans over labels, claims, links and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matching as M
from tessera.operators import reports as R
from tessera.operators import sampling as A
from tessera.operators import stats as S
from tessera.operators import text as X
from tessera.plans import tables as T
from tessera.plans.pair_queries import KEY_TERM_SQL, assigned_sql, rates
from tessera.plans.registry import query
from tessera.plans.stat_queries import rounded, unit
from tessera.sources import corpus as C

G, D = T.GOLD_SQL, T.DET_SQL


@query("facets", f"select distinct 'node' as side, category as value from {T.CLAIM_SQL} union select distinct 'edge', relation from {T.LINK_SQL}")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.facets(T.claims(spark, sf_dir).select(F.col("category").alias("kind")), T.links(spark, sf_dir).select(F.col("relation").alias("kind")))


@query("payload_totals", f"""with c as (select * from {T.CLAIM_SQL}) select 'documents' as name, count(distinct document)::bigint as n from c union all select 'claims', count(*) from c union all select 'links', count(*) from {T.LINK_SQL}
union all select 'entities', count(*) from (select subject from c group by 1 having count(*) >= 3) union all select 'labels', count(*) from {G} where label_idx % 2 = 0 union all select 'distractors', count(*) from {G} where label_idx % 2 = 1 union all select 'unique_documents', count(*) from (select document from c union select doc_id from documents)""")
def payload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, g = T.claims(spark, sf_dir), T.gold(spark, sf_dir)
    files = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"))
    return R.totals({
        "documents": c.select("document").distinct(), "claims": c, "links": T.links(spark, sf_dir), "entities": c.groupBy("subject").count().where("count >= 3"),
        "labels": g.where("label_idx % 2 = 0"), "distractors": g.where("label_idx % 2 = 1"), "unique_documents": R.unique_documents(files, c),
    })


@query("category_breakdown", f"select document, string_agg(category || '=' || n, ',' order by category) as breakdown from (select document, category, count(*) as n from {T.CLAIM_SQL} group by all) group by 1")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.breakdown(T.claims(spark, sf_dir), "document", "category")
    return found.select("document", F.array_join(F.transform(F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("breakdown"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that refer to orders: those of a customer's orders, the first one twice."""
    o = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("label_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("refs"))
    return o.select("label_id", F.concat("refs", F.slice("refs", 1, 1)).alias("refs"))


LABEL_SQL = "(select o_custkey as label_id, list_append(list_sort(list(o_orderkey)), min(o_orderkey)) as refs from orders group by 1)"
JOINED = "array_to_string(list_sort(list({0})), ',')"


def joined(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ","))


@query("document_annotations", f"select node, {JOINED.format('label_id')} as label_ids, count(*)::bigint as n from (select label_id, unnest(refs) as node from {LABEL_SQL}) group by 1")
def document_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(R.annotations(labels(spark, sf_dir)), "label_ids")


@query("entity_annotations", f"select node, {JOINED.format('label_id')} as label_ids, count(*)::bigint as n from (select distinct label_id, subject as node from (select label_id, unnest(refs) as document from {LABEL_SQL}) join {T.CLAIM_SQL} using (document)) group by 1")
def entity_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(R.annotations(labels(spark, sf_dir), T.claims(spark, sf_dir).select("document", F.col("subject").alias("node"))), "label_ids")


@query("claim_links", f"select claim_id, {JOINED.format('link_id')} as link_ids from (select link_id, unnest(claim_ids) as claim_id from {T.LINK_SQL}) group by 1")
def claim_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(R.link_index(T.links(spark, sf_dir)), "link_ids")


@query("traced_nodes", f"select label_id, {JOINED.format('node')} as nodes from (select distinct label_id, claim_id as node from (select label_id, unnest(refs) as document from {LABEL_SQL}) join {T.CLAIM_SQL} using (document)) group by 1")
def traced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(R.traced(labels(spark, sf_dir), T.claims(spark, sf_dir).select("document", F.col("claim_id").alias("node"))), "nodes")


@query("edges_both_ways", "select c_custkey as node, 'in' as relation, c_nationkey as other from customer union all select c_nationkey, '<- in', c_custkey from customer")
def edges_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.both_ways(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.lit("in").alias("relation"), F.col("c_nationkey").alias("b")))


@query("merged_links", """select case p_partkey % 5 when 0 then 'a' || p_partkey || ',b' when 1 then 'c' || p_partkey || ',d' when 2 then 'a' || p_partkey when 3 then '' else 'x,y' || p_partkey end as claim_ids,
  case when p_partkey % 3 = 0 then 'supports' when p_partkey % 3 = 1 then 'contradicts' else 'cross_reference' end as relation, case when p_partkey % 2 = 0 then p_name end as rationale from part
union all select 'k' || s_suppkey || ',m', case when s_suppkey % 2 = 0 then 'theme' else 'cross_reference' end, null from supplier""")
def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in each of their shapes, with empty strings in place of what is missing, and clusters."""
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    refs = T.table(spark, sf_dir, "part").select(
        F.when(k % 5 == 4, F.array(F.lit("x"), F.concat(F.lit("y"), s))).otherwise(F.when(k % 2 == 0, F.array().cast("array<string>"))).alias("claim_ids"),
        F.when(k % 5 == 0, F.concat(F.lit("a"), s)).when(k % 5 == 2, F.concat(F.lit("a"), s)).otherwise("").alias("source_claim"),
        F.when(k % 5 == 0, "b").when(k % 5 == 3, "z").otherwise("").alias("target_claim"),
        F.when(k % 5 == 1, F.concat(F.lit("c"), s)).alias("from_claim"), F.when(k % 5 == 1, "d").alias("to_claim"),
        F.when(k % 3 == 0, "supports").otherwise("").alias("relationship_type"), F.when(k % 3 == 1, "contradicts").otherwise("").alias("relationship"),
        F.lit("").alias("rationale"), F.when(k % 2 == 0, F.col("p_name")).alias("description"),
    )
    u = F.col("s_suppkey")
    clusters = T.table(spark, sf_dir, "supplier").select(F.array(F.concat(F.lit("k"), u.cast("string")), F.lit("m")).alias("claim_ids"), F.when(u % 2 == 0, "theme").otherwise("").alias("relation"), F.lit("").alias("theme"))
    return joined(R.merged_links(refs, clusters), "claim_ids")


@query("limit_per_group", "select p_size, p_partkey, nth::int as nth from (select p_size, p_partkey, row_number() over (partition by p_size order by p_partkey) as nth from part) where nth <= 3")
def limit_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_of_group(T.table(spark, sf_dir, "part").select("p_size", "p_partkey"), "p_size", ["p_partkey"], 3)


@query("palette_search", "select node, name from (select * from (select p_partkey as node, p_name as name, p_type as alias from part order by 1 limit 500) where contains(lower(name || ' ' || node || ' ' || alias), '1') order by name, node limit 60)")
def palette_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.array("p_type").alias("aliases"))
    return R.searched(p, " 1 ").select("node", "name")


@query("titled_files", """with f as (select p_partkey, (case when p_partkey % 3 = 0 then '' else (p_partkey % 40) || '_' end) || 'file_' || p_partkey || '.txt' as name, p_name as content from part),
m as (select distinct p_size % 25 as item, 'Title ' || p_size % 25 as t, case when p_size % 25 % 2 = 0 then p_size % 25 end as w from part)
select p_partkey, regexp_replace(name, '\\.txt$', '') as plain, coalesce(t, trim(regexp_replace(regexp_replace(regexp_replace(name, '^\\d+[-_ ]+', ''), '\\.[A-Za-z0-9]+$', ''), '_', ' ', 'g'))) as title, (case when item is not null then coalesce(w, 0) else len(regexp_extract_all(content, '\\S+')) end)::bigint as word_count
from f left join m on item = nullif(try_cast(regexp_extract(name, '^(\\d+)_', 1) as int), 0)""")
def titled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and word counts by the number before a file's name, else from the name and the text."""
    p, k = T.table(spark, sf_dir, "part"), F.col("p_partkey")
    files = p.select("p_partkey", F.concat(F.when(k % 3 == 0, "").otherwise(F.concat((k % 40).cast("string"), F.lit("_"))), F.lit("file_"), k.cast("string"), F.lit(".txt")).alias("name"), F.col("p_name").alias("content"))
    item = (F.col("p_size") % 25).cast("int")
    meta = p.select(item.alias("item_number"), F.concat(F.lit("Title "), item.cast("string")).alias("title"), F.when(item % 2 == 0, item).alias("word_count")).distinct()
    return R.titled(files, meta, X.plain_title(F.col("name"))).select("p_partkey", R.plain_id(F.col("name")).alias("plain"), "title", "word_count")


@query("facts_for_mechanism", """with m as (select *, case mechanism when 'numeric_drift' then type = 'numeric' when 'entity_swap' then type = 'entity' when 'temporal_revision_conflict' then type in ('revision', 'temporal') else false end as suits
  from (select l_orderkey, l_linenumber, ['numeric_drift', 'entity_swap', 'temporal_revision_conflict', 'other'][l_orderkey % 4 + 1] as mechanism, ['numeric', 'entity', 'temporal', 'causal', 'revision'][l_partkey % 5 + 1] as type from lineitem))
select l_orderkey, l_linenumber, type from (select *, bool_or(suits) over (partition by l_orderkey) as suited from m) where suits or not suited""")
def facts_for_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    facts = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", of(["numeric_drift", "entity_swap", "temporal_revision_conflict", "other"], F.col("l_orderkey")).alias("mechanism"), of(["numeric", "entity", "temporal", "causal", "revision"], F.col("l_partkey")).alias("type"))
    return R.facts_for(facts, "l_orderkey").select("l_orderkey", "l_linenumber", "type")


@query("sharing_matrix", """with p as (select p_name as name, p_size, list_sort(list(distinct l_suppkey)) as cases from lineitem join (select p_partkey, 'n' || p_partkey % 90 as p_name, p_size % 3 as p_size from part) on l_partkey = p_partkey group by all)
select name, array_to_string(arg_max(cases, p_size), ',') as cases from p group by 1""")
def sharing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each name; of a name's profiles by size the last holds."""
    p = T.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("n"), (F.col("p_partkey") % 90).cast("string")).alias("name"), (F.col("p_size") % 3).alias("ord"))
    profiles = T.table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("name", "ord").agg(F.sort_array(F.collect_set("l_suppkey")).alias("cases"))
    return joined(R.sharing(profiles), "cases")


@query("rate_notes", """with s as (select source as case_id, count(*) as total, count_if(n_chars >= 1000) as clean from documents group by 1)
select null::varchar as case_id, 'Overall extraction: ' || sum(clean) || '/' || sum(total) || ' documents passed quality (' || round_even(sum(clean) / sum(total) * 100, 0)::int || '%)' as note from s having sum(total) > 0
union all select case_id, 'Docket ' || case_id || ': low clean rate (' || round_even(round_even(clean / total, 4) * 100, 0)::int || '%)' from s where round_even(clean / total, 4) < 0.8""")
def rate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("case_id")).agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") >= 1000).alias("clean"))
    return R.rate_notes(s.withColumn("clean_rate", F.bround(F.col("clean") / F.col("total"), 4)))


@query("structural_notes", f"""with d as (select lang as document_type, text, row_number() over (partition by lang order by doc_id) as nth from documents), f as (select * from d where nth <= 5),
s as (select document_type, count(*) filter (where text <> '') as texts, bool_or(text <> '' and (contains(left(text, 500), '1.') or contains(left(text, 500), '1)'))) as numbered, bool_or(text <> '' and contains(text, '  ') and contains(text, '|')) as tables,
  bool_or(text <> '' and len(list_filter(string_split(text, chr(10))[1:20], lambda l: upper(l) = l and lower(l) <> l and length(l) > 3 and len(regexp_extract_all(l, '[^\\s\\p{{Z}}]+')) <= 8)) > 0) as headers, avg(len(regexp_extract_all(text, '[^\\s\\p{{Z}}]+'))) filter (where text <> '') as words from f group by 1)
select document_type, array_to_string(case when texts = 0 then ['{R.NO_TEXT}'] else list_filter([case when numbered then '{R.NUMBERED}' end, case when headers then '{R.HEADERS}' end, case when tables then '{R.TABULAR}' end,
  case when words > 5000 then '{R.LENGTH_NOTES[0][1]}' when words > 1000 then '{R.LENGTH_NOTES[1][1]}' else '{R.LENGTH_NOTES[2][1]}' end], lambda x: x is not null) end, ' | ') as notes from s""")
def structural_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select(F.col("lang").alias("document_type"), F.col("doc_id").alias("doc_ord"), F.col("text").alias("content"))
    return R.structural_notes(d).select("document_type", F.array_join("notes", " | ").alias("notes"))


@query("annotation_summary", f"""with g as (select *, label_idx % 3 = 0 as valid from {G}), d as (select report_id, count(*) as distractors from g where label_idx % 2 = 1 group by 1)
select report_id, labels::bigint as labels, intra_doc::bigint as intra_doc, inter_doc::bigint as inter_doc, passed::bigint as passed, failed::bigint as failed, coalesce(distractors, 0)::bigint as distractors
from (select report_id, count(*) as labels, count_if(scope = 'intra_doc') as intra_doc, count_if(scope = 'inter_doc') as inter_doc, count_if(valid) as passed, count_if(not valid) as failed from g group by 1) left join d using (report_id)""")
def annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.gold(spark, sf_dir)
    return R.annotation_summary(g, g.select("label_idx", (F.col("label_idx") % 3 == 0).alias("valid")), g.where("label_idx % 2 = 1"), "report_id")


@query("distractor_plan", f"""with c as (select source as case_id, count(*) as docs, sum(doc_id % 3)::bigint as labels from documents group by 1), i as (select case_id, docs, i::int as i, '7:' || case_id || ':distractor:' || i as k from c, range(0, round_even(labels * 0.5, 0)::int) r(i))
select case_id, row_number() over (partition by case_id order by md5(k))::int as place, [{', '.join(f"'{v}'" for v in A.DIVERGENCES)}][i % 4 + 1] as divergence, case when {unit("k || ':scope'")} < 0.5 or docs < 2 then 'intra_doc' else 'inter_doc' end as scope from i""")
def distractor_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = T.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("case_id")).agg(F.count("*").alias("docs"), F.sum(F.col("doc_id") % 3).alias("labels"))
    return A.distractor_plan(cases, 0.5, 7)


@query("target_pairs", f"""with x as (select source as case_id, doc_id, list_distinct(list_transform(regexp_extract_all(text, '{KEY_TERM_SQL}'), lambda x: lower(trim(x)))) as r from documents),
w as (select a.case_id, a.doc_id as doc_a, b.doc_id as doc_b, len(list_intersect(a.r, b.r)) / (len(a.r) + len(b.r) - len(list_intersect(a.r, b.r))) as w from x a join x b on a.case_id = b.case_id and a.doc_id < b.doc_id where len(list_intersect(a.r, b.r)) > 0),
t as (select *, '9:' || draw || ':' || doc_a || ':' || doc_b as k from w, range(0, 4) r(draw)), f as (select *, row_number() over (partition by case_id, draw order by -ln((('0x' || right(sha256(k || ':t'), 8))::bigint + 1) / 4294967296.0) / w, doc_a, doc_b) as nth, {unit("k || ':r'")} < 0.5 as turned from t)
select case_id, draw::int as draw, case when turned then doc_b else doc_a end as source, case when turned then doc_a else doc_b end as target from f where nth = 1""")
def target_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs drawn in proportion to the key terms that they share."""
    return A.chosen_pairs(A.choosable_pairs(T.docs(spark, sf_dir), 4, 9), 4, 9)


def scope_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all detections of a report against its labels of each scope apart."""
    return M.partial_scores(*T.sides(spark, sf_dir), ["report_id"], "scope")


SCOPES = f"""g0 as (select * from {G} where scope is not null), d as (select x.report_id || '|' || scope as report_id, det_idx, refs, description, confidence from {D} x join (select distinct report_id, scope from g0) using (report_id)),
g as (select report_id || '|' || scope as report_id, label_idx, refs, rationale from g0), {assigned_sql()},
n as (select report_id, coalesce(n_det, 0) as n_det, coalesce(n_gold, 0) as n_gold from (select report_id, count(*) as n_gold from g group by all) full join (select report_id, count(*) as n_det from d group by all) using (report_id)),
ps as (select report_id, {rates('coalesce(credit, 0)')}, round(round(case when n_det = 0 or n_gold = 0 or coalesce(pairs, 0) = 0 then 0.0 else credit / pairs end, 10), 6) as partial_credit from n left join (select report_id, sum(similarity) as credit, count(*) as pairs from m group by all) using (report_id))"""


@query("score_partial_by_scope", f"with {SCOPES} select * from ps")
def score_partial_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scope_scores(spark, sf_dir)
    return r.select(F.concat_ws("|", F.col("report_id").cast("string"), "scope").alias("report_id"), *[c for c in r.columns if c not in ("report_id", "scope")])


OPTIONAL = ["partial_credit", "distractor_fpr"]


@query("seed_optional_by_scope", f"""with {SCOPES}, r as (select split_part(report_id, '|', 1)::bigint as run, split_part(report_id, '|', 2) as scope, partial_credit from ps), f as (select run, scope, coalesce(partial_credit, 0.0) as value from (select distinct run from r) cross join (select distinct scope from r) left join r using (run, scope))
select scope, 'partial_credit' as metric, count(value)::bigint as n, round(avg(value), 8) as mean, round(coalesce(stddev_samp(value), 0), 8) as std, round(coalesce(stddev_samp(value), 0) / sqrt(count(value)), 8) as se from f group by 1""")
def seed_optional_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial credit of each scope over all runs; a run without the scope counts 0."""
    r = scope_scores(spark, sf_dir).select(F.col("report_id").alias("run"), "scope", "partial_credit")
    return rounded(S.summary(S.long_form(S.filled(r, r, "run", "scope", ["partial_credit"]), ["scope"], ["partial_credit"]), ["scope", "metric"]), "mean", "std", "se")


@query("seed_distractor_rate", f"""with f as (select report_id, round(count(hit) / count(*), 6) as value from (select * from {G} where label_idx % 2 = 1) left join (select distinct report_id, refs, 1 as hit from {D}) using (report_id, refs) group by 1), r as (select distinct report_id from {G})
select count(*)::bigint as runs, count(value)::bigint as n, round(avg(value), 8) as mean, round(coalesce(stddev_samp(value), 0), 8) as std from r left join f using (report_id)""")
def seed_distractor_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of flagged distractors over the runs that have any; the others have none to average."""
    g = T.gold(spark, sf_dir)
    rate = M.distractor_rate(T.detections(spark, sf_dir), g.where("label_idx % 2 = 1"), ["report_id"]).select("report_id", F.col("rate").alias("value"))
    rows = g.select("report_id").distinct().join(rate, "report_id", "left").withColumn("all", F.lit(1))
    return rounded(S.summary(rows, ["all"]).join(rows.groupBy("all").agg(F.count("*").alias("runs")), "all").select("runs", "n", "mean", "std"), "mean", "std")


@query("change_contexts", "select doc_id, true as clean, true as told from documents where length(text) > 500")
def change_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a word put in at 300, whose surroundings stay; the same with a letter changed within reach is not clean."""
    d = T.table(spark, sf_dir, "documents").where("length(text) > 500").withColumns({"edited": F.expr("concat(left(text, 300), '<new>', substring(text, 301))"), "spoilt": F.expr("concat(left(text, 299), '\u0001', '<new>', substring(text, 301))")})
    return d.select("doc_id", X.same_context("text", "edited", "300", "300", "300", "305").alias("clean"), (~X.same_context("text", "spoilt", "300", "300", "300", "305")).alias("told"))


@query("verify_label_schema", f"""with g as (select label_idx, list_extract(refs, 1) % 300 as doc_id from {G}), x as (select label_idx, g.doc_id, text from g left join documents d on d.doc_id = g.doc_id)
select label_idx, text is not null and doc_id % 3 = 0 and label_idx % 4 <> 0 as passed, case when text is null then 'missing document' when doc_id % 3 <> 0 then 'no difference' when label_idx % 4 = 0 then 'invalid label' else '' end as reason from x""")
def verify_label_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification of labels some of which have a value that their schema has not; every third document was edited."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    m = d.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    g = T.gold(spark, sf_dir).withColumns({"mechanism": F.lit("entity_swap"), "difficulty": F.when(F.col("label_idx") % 4 == 0, "odd").otherwise("easy"), "char_start": F.lit(3), "char_end": F.lit(5)})
    g = C.label_errors(g).select("label_idx", "errors").join(g.select("label_idx", F.array(F.col("refs")[0] % 300).alias("refs"), "char_start", "char_end"), "label_idx")
    return X.verified(g, d, m).select("label_idx", "passed", F.coalesce("reason", F.lit("")).alias("reason"))
