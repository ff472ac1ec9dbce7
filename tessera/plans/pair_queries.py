"""Queries over document pairs and matches of detections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matching as M
from tessera.operators import pairs as P
from tessera.operators import toppairs as O
from tessera.plans import tables as T
from tessera.plans.registry import query

TOKENS = "words as (select source as case_id, doc_id as doc_ord, text as content, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents)"
TERMS = f"{TOKENS}, terms as (select distinct case_id, doc_ord, unnest(w) as term from words), n as (select case_id, count(distinct doc_ord) as n from words group by 1)"
IDF = "idf as (select case_id, term, count(*)::bigint as df, ln((max(n) + 1) / (count(*) + 1)) as idf from terms join n using (case_id) group by 1, 2)"
BEST = "select case_id, rank, doc_a, doc_b, score, round(least(score / best, 1.0), 6) as confidence from (select *, row_number() over (partition by case_id order by score desc, doc_a, doc_b)::int as rank, max(score) over (partition by case_id) as best from (select case_id, doc_a, doc_b, round(score, 6) as score from scored) where score > 0) where rank <= 10"
SIGNALS = "[" + ", ".join(f"'{s}'" for s in P.SIGNALS) + "]"


@query("pair_keyword_topk", f"""
with {TERMS}, {IDF},
shared as (select a.case_id, a.doc_ord as doc_a, b.doc_ord as doc_b, sum(idf) as overlap from terms a join terms b on a.case_id = b.case_id and a.term = b.term and a.doc_ord < b.doc_ord
           join idf on idf.case_id = a.case_id and idf.term = a.term group by all),
s as (select case_id, doc_ord, list_filter({SIGNALS}, lambda x: list_contains(w, x)) as s from words),
scored as (select shared.case_id, doc_a, doc_b, overlap * (1 + 0.5 * (len(list_filter(x.s, lambda v: not list_contains(y.s, v))) + len(list_filter(y.s, lambda v: not list_contains(x.s, v))))) as score
           from shared join s x on x.doc_ord = doc_a and x.case_id = shared.case_id join s y on y.doc_ord = doc_b and y.case_id = shared.case_id)
{BEST}""")
def pair_keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.keyword_topk(T.docs(spark, sf_dir), 10)


FEATURES = f"""{TOKENS}, f as (select case_id, doc_ord, len(w)::double as word_count, len(list_distinct(w)) / greatest(1, len(w)) as unique_ratio, length(array_to_string(w, '')) / greatest(1, len(w)) as avg_word_length,
  len(w) / greatest(1, len(regexp_extract_all(content, '[.!?]+'))) as avg_sentence_length, (len(regexp_extract_all(content, '\\n\\n')) + 1)::double as paragraph_count,
  len(regexp_extract_all(content, '\\p{{Nd}}')) / greatest(1, length(content)) as digit_ratio, len(regexp_extract_all(content, '\\p{{Lu}}')) / greatest(1, length(content)) as upper_ratio from words)"""
DISTANCE = " + ".join(f"pow((a.{f} - b.{f}) / greatest(abs(a.{f}), abs(b.{f}), 1.0), 2)" for f in P.FEATURES)


@query("pair_surface_divergence_topk", f"with {FEATURES}, scored as (select a.case_id, a.doc_ord as doc_a, b.doc_ord as doc_b, sqrt({DISTANCE}) as score from f a join f b on a.case_id = b.case_id and a.doc_ord < b.doc_ord) {BEST}")
def pair_surface_divergence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.divergent_topk(P.surface_features(T.docs(spark, sf_dir)), 10)


@query("doc_surface_features", f"with {FEATURES} select case_id, doc_ord, {', '.join(f'round({f}, 6) as {f}' for f in P.FEATURES)} from f")
def doc_surface_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.surface_features(T.docs(spark, sf_dir)).select("case_id", "doc_ord", *[F.round(f, 6).alias(f) for f in P.FEATURES])


@query("term_frequencies", f"with {TOKENS} select case_id, doc_ord, term, count(*)::bigint as tf from (select case_id, doc_ord, unnest(w) as term from words) group by all")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.term_frequencies(T.docs(spark, sf_dir))


@query("term_idf", f"with {TERMS}, {IDF} select case_id, term, df, round(idf, 6) as idf from idf")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.inverse_frequencies(T.docs(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query("jaccard_pairs", f"""
with x as (select report_id, det_idx as a, list_distinct(refs) as ra from {T.DET_SQL}), y as (select report_id, label_idx as b, list_distinct(refs) as rb from {T.GOLD_SQL})
select report_id, a, b, round(len(list_intersect(ra, rb)) / (len(ra) + len(rb) - len(list_intersect(ra, rb))), 6) as similarity from x join y using (report_id) where len(list_intersect(ra, rb)) > 0""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, g = T.sides(spark, sf_dir)
    pairs = P.set_pairs(d.withColumnRenamed("det_idx", "a"), g.withColumnRenamed("label_idx", "b"), ["report_id"])
    return pairs.withColumn("similarity", F.round("similarity", 6))


KEY_TERM_SQL = P.KEY_TERM.replace("'", "''")


@query("key_term_pairs", f"""
with x as (select source as case_id, doc_id, list_distinct(list_transform(regexp_extract_all(text, '{KEY_TERM_SQL}'), lambda x: lower(trim(x)))) as r from documents)
select a.case_id, a.doc_id as doc_a, b.doc_id as doc_b, round(len(list_intersect(a.r, b.r)) / (len(a.r) + len(b.r) - len(list_intersect(a.r, b.r))), 6) as similarity
from x a join x b on a.case_id = b.case_id and a.doc_id < b.doc_id where len(list_intersect(a.r, b.r)) > 0""")
def key_term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_term_pairs(T.docs(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def rates(matched: str) -> str:
    p = f"case when n_det = 0 then 0.0 when n_gold = 0 then 1.0 else {matched}::double / n_det end"
    r = f"case when n_det = 0 or n_gold = 0 then 0.0 else {matched}::double / n_gold end"
    return f"round(round({p}, 10), 6) as precision, round(round({r}, 10), 6) as recall, round(round(case when n_gold = 0 or ({p}) + ({r}) = 0 then 0.0 else 2 * ({p}) * ({r}) / (({p}) + ({r})) end, 10), 6) as f1"


BASE = f"d as (select * from {T.DET_SQL}), g as (select * from {T.GOLD_SQL})"


def binary_sql(by: str = "", gold: str = "g") -> str:
    k = f"report_id, {by}" if by else "report_id"
    nn = f"(select report_id{', ' + by if by else ''}, coalesce(n_det, 0) as n_det, coalesce(n_gold, 0) as n_gold from (select {k}, count(*) as n_gold from {gold} group by all) full join (select report_id, count(*) as n_det from d group by all) using (report_id){' where ' + by + ' is not null' if by else ''})"
    return f"""select {k}, n_det::bigint as n_det, n_gold::bigint as n_gold, coalesce(matched, 0)::bigint as matched, {rates('coalesce(matched, 0)')} from {nn}
      left join (select {k}, sum(least(x, y)) as matched from (select {k}, refs, count(*) as x from {gold} group by all) join (select report_id, refs, count(*) as y from d group by all) using (report_id, refs) group by all) using ({k})"""


@query("score_binary", f"with {BASE} {binary_sql()}")
def score_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.binary_scores(T.detections(spark, sf_dir), T.gold(spark, sf_dir), ["report_id"])


@query("score_by_scope", f"with {BASE} {binary_sql('scope')}")
def score_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.binary_scores(T.detections(spark, sf_dir), T.gold(spark, sf_dir), ["report_id"], "scope")


STAGE_SQL = "case detectability " + " ".join(f"when '{k}' then '{v}'" for k, v in M.STAGES.items()) + " end"


@query("score_by_stage", f"with {BASE}, gs as (select *, {STAGE_SQL} as stage from g) {binary_sql('stage', 'gs')}")
def score_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.binary_scores(T.detections(spark, sf_dir), M.staged(T.gold(spark, sf_dir)), ["report_id"], "stage")


@query("score_binary_matches", f"""with {BASE}
select report_id, det_idx, label_idx from (select report_id, refs, det_idx, row_number() over (partition by report_id, refs order by description, det_idx) as rn from d)
join (select report_id, refs, label_idx, row_number() over (partition by report_id, refs order by label_idx) as rn from g) using (report_id, refs, rn)""")
def score_binary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_matches(T.detections(spark, sf_dir), T.gold(spark, sf_dir), ["report_id"])


#: More rounds than the widest report needs.
ROUNDS = 12


def assigned_sql() -> str:
    out = ["""p0 as (select report_id, det_idx as a, label_idx as b, len(list_intersect(list_distinct(d.refs), list_distinct(g.refs))) / (len(list_distinct(d.refs)) + len(list_distinct(g.refs)) - len(list_intersect(list_distinct(d.refs), list_distinct(g.refs)))) as similarity, description as oa, rationale as ob
        from d join g using (report_id) where len(list_intersect(d.refs, g.refs)) > 0)"""]
    o = "order by similarity desc, oa, ob, a, b"
    for i in range(ROUNDS):
        out.append(f"m{i} as materialized (select report_id, a, b, similarity from (select *, row_number() over (partition by report_id, a {o}) as ra, row_number() over (partition by report_id, b {o}) as rb from p{i}) where ra = 1 and rb = 1)")
        out.append(f"p{i + 1} as materialized (select * from p{i} where (report_id, a) not in (select report_id, a from m{i}) and (report_id, b) not in (select report_id, b from m{i}))")
    return ", ".join(out) + ", m as (" + " union all ".join(f"select * from m{i}" for i in range(ROUNDS)) + ")"


@query("partial_matches", f"with {BASE}, {assigned_sql()} select report_id, a, b, round(similarity, 6) as similarity from m")
def partial_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.partial_matches(*T.sides(spark, sf_dir), ["report_id"]).withColumn("similarity", F.round("similarity", 6))


@query("score_partial", f"""with {BASE}, {assigned_sql()},
n as (select report_id, coalesce(n_det, 0) as n_det, coalesce(n_gold, 0) as n_gold from (select report_id, count(*) as n_gold from g group by all) full join (select report_id, count(*) as n_det from d group by all) using (report_id))
select report_id, {rates('coalesce(credit, 0)')}, round(round(case when n_det = 0 or n_gold = 0 or coalesce(pairs, 0) = 0 then 0.0 else credit / pairs end, 10), 6) as partial_credit
from n left join (select report_id, sum(similarity) as credit, count(*) as pairs from m group by all) using (report_id)""")
def score_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.partial_scores(*T.sides(spark, sf_dir), ["report_id"])


@query("distractor_fpr", f"""with {BASE}
select report_id, count(*)::bigint as n_distractors, count(hit)::bigint as n_flagged, round(count(hit) / count(*), 6) as rate
from (select * from g where label_idx % 2 = 1) left join (select distinct report_id, refs, 1 as hit from d) using (report_id, refs) group by all""")
def distractor_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distractor_rate(T.detections(spark, sf_dir), T.gold(spark, sf_dir).where("label_idx % 2 = 1"), ["report_id"])


@query("merge_detections", f"""with d as (select *, list_sort(list_distinct(refs)) as k from {T.DET_SQL}),
b as (select report_id, 1 as side, det_idx as ord, k as refs, confidence from d where det_idx % 3 <> 2 union all select report_id, 2, det_idx, k, (det_idx * 7 % 100) / 100.0 from d where det_idx % 2 = 0),
l as (select *, min(side) over (partition by report_id) = max(side) over (partition by report_id) as lone,
  row_number() over (partition by report_id, refs, side order by case when side = 2 then -confidence end, ord) as nth, max(case when side = 1 then 1 end) over (partition by report_id, refs) as has from b),
best as (select report_id, refs, ord as bo, confidence as bc from l where side = 2 and nth = 1)
select report_id, array_to_string(refs, ',') as refs, case when swap then 2 else side end::int as side, case when swap then bo else ord end as ord, case when swap then bc else confidence end::double as confidence
from (select l.*, bo, bc, coalesce(not lone and side = 1 and nth = 1 and bc > confidence, false) as swap from l left join best using (report_id, refs)) where lone or side = 1 or (nth = 1 and has is null)""")
def merge_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.detections(spark, sf_dir).select("report_id", F.col("det_idx").alias("ord"), "refs", "confidence")
    second = d.where("ord % 2 = 0").withColumn("confidence", F.col("ord") * 7 % 100 / 100.0)
    return M.merged(d.where("ord % 3 <> 2"), second, ["report_id"]).withColumn("refs", F.array_join("refs", ","))


TRIPLE = "lower(trim(subject::varchar)) as s, lower(trim(predicate)) as p, lower(trim(object)) as o"


@query("representation_quality", f"""with c as (select document % 50 as report_id, * from {T.CLAIM_SQL}), gold as (select * from c where claim_id % 4 <> 0), sys as (select * from c where claim_id % 3 <> 0),
g as (select distinct report_id, {TRIPLE} from gold), s as (select distinct report_id, {TRIPLE} from sys), gs as (select distinct report_id, {TRIPLE}, document from gold), ss as (select distinct report_id, {TRIPLE}, document from sys)
select report_id, round(a::double / ng, 6) as coverage, round(b::double / nss, 6) as accuracy from (select report_id, count(*) as ng from g group by all) join (select report_id, count(*) as a from (from g intersect from s) group by all) using (report_id)
join (select report_id, count(*) as nss from ss group by all) using (report_id) join (select report_id, count(*) as b from (from gs intersect from ss) group by all) using (report_id)""")
def representation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.claims(spark, sf_dir).withColumn("report_id", F.col("document") % 50)
    return M.representation(c.where("claim_id % 4 <> 0"), c.where("claim_id % 3 <> 0"), ["report_id"])
