"""Queries of chunks, edits, verification and manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import text as X
from tessera.plans import tables as T
from tessera.plans.registry import query

S = "[^\\s\\p{Z}]+"


def n(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{S}'))"


def chunk_sql() -> str:
    """Lines are paragraphs' only level in these texts; the fold is a recursive walk over segments."""
    return f"""d as (select source as case_id, doc_id as doc_ord, text as content, {n('text')} as total from documents),
    l as (select case_id, doc_ord, i, list_extract(ls, i) || (case when i < len(ls) then chr(10) else '' end) as line from (select *, string_split(content, chr(10)) as ls from d where total > 800), range(1, len(ls) + 1) r(i)),
    b as (select case_id, doc_ord, i, 0 as j, line as seg from l where {n('line')} <= 800
      union all select case_id, doc_ord, i, j, array_to_string(ws[j * 800 + 1 : j * 800 + 800], ' ') || (case when (j + 1) * 800 < len(ws) then ' ' else '' end) from (select *, string_split(line, ' ') as ws from l where {n('line')} > 800), range(0, ((len(ws) + 799) // 800)) r(j)),
    s as (select case_id, doc_ord, row_number() over (partition by case_id, doc_ord order by i, j) as pos, seg, {n('seg')} as words, sum(length(seg)) over (partition by case_id, doc_ord order by i, j) as e from b where seg <> ''),
    w as (select case_id, doc_ord, pos, 0 as k, words as fill from s where pos = 1
      union all select s.case_id, s.doc_ord, s.pos, case when fill > 0 and fill + words > 800 then k + 1 else k end, case when fill > 0 and fill + words > 800 then words else fill + words end from w join s on s.case_id = w.case_id and s.doc_ord = w.doc_ord and s.pos = w.pos + 1),
    c as (select case_id, doc_ord, k as chunk_index, min(e - length(seg))::bigint as char_start, max(e)::bigint as char_end from w join s using (case_id, doc_ord, pos) group by all
      union all select case_id, doc_ord, 0, 0, length(content) from d where total <= 800)"""


@query("chunk_offsets", f"with recursive {chunk_sql()} select c.case_id, c.doc_ord, chunk_index::int as chunk_index, char_start, char_end, {n('substr(content, char_start + 1, char_end - char_start)')}::bigint as word_count, md5(substr(content, char_start + 1, char_end - char_start)) as digest from c join d using (case_id, doc_ord)")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunks(T.docs(spark, sf_dir)).select("case_id", "doc_ord", "chunk_index", "char_start", "char_end", F.col("word_count").cast("bigint").alias("word_count"), F.md5("text").alias("digest"))


@query("chunk_manifest", f"with recursive {chunk_sql()}, p as (select case_id, doc_ord, count(*) as n from c group by all) select case_id, count(*)::bigint as documents, sum(n)::bigint as chunks, count_if(n = 1)::bigint as single, count_if(n > 1)::bigint as multiple from p group by 1")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunk_manifest(X.chunks(T.docs(spark, sf_dir)))


NAME = "(select p_partkey, p_partkey || '_' || replace(p_name, ' ', '_') || '.pdf' as name from part)"


@query("names", f"""select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(name, '^\\d+[-_ ]+', ''), '\\.[A-Za-z0-9]+$', ''), '_', ' ', 'g')) as title, left(regexp_replace(trim(name), '[^A-Za-z0-9._-]+', '_', 'g'), 100) as safe,
  regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, case when length(name) > 20 then left(name, 17) || '…' else name end as short from {NAME}""")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".pdf")).alias("name"))
    return x.select("p_partkey", X.plain_title(F.col("name")).alias("title"), X.safe_name(F.col("name")).alias("safe"), X.slug(F.col("name")).alias("slug"), X.shortened(F.col("name"), 20).alias("short"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of each document (the second, if there is one) is to become another."""
    return T.docs(spark, sf_dir).withColumn("old", F.coalesce(F.get(F.split("content", " "), F.lit(1)), F.lit("none"))).withColumn("new", F.concat(F.lit("<"), F.col("doc_ord").cast("string"), F.lit(">")))


EDITS = "(select source as case_id, doc_id as doc_ord, text as content, coalesce(string_split(text, ' ')[2], 'none') as old, '<' || doc_id || '>' as new from documents)"


@query("apply_edits", f"""select case_id, doc_ord, ok, md5(edited) as digest, (case when ok then instr(edited, new) - 1 else -1 end)::int as char_start, (case when ok then instr(edited, new) - 1 + length(new) else -1 end)::int as char_end
from (select *, instr(content, old) > 0 as ok, case when instr(content, old) > 0 then substr(content, 1, instr(content, old) - 1) || new || substr(content, instr(content, old) + length(old)) else content end as edited from {EDITS})""")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.replaced_first(edits(spark, sf_dir)).select("case_id", "doc_ord", "ok", F.md5("edited").alias("digest"), F.coalesce("char_start", F.lit(-1)).alias("char_start"), F.coalesce("char_end", F.lit(-1)).alias("char_end"))


@query("insert_lines", """select doc_id as doc_ord, s::int as char_start, (s + length(pad))::int as char_end, md5(substr(text, 1, s) || pad || substr(text, s + 1)) as digest
from (select *, ' ' || '<' || doc_id || '>' || ' ' as pad, least(length(array_to_string(string_split(text, chr(10))[1 : least(doc_id % 5, len(string_split(text, chr(10))) - 1) + 1], chr(10))) + 1, length(text)) as s from documents)""")
def insert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.inserted_after_line(edits(spark, sf_dir).withColumn("line", (F.col("doc_ord") % 5).cast("int"))).select("doc_ord", "char_start", "char_end", F.md5("edited").alias("digest"))


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels of an order's lines as references to documents (some missing); every third document was edited."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    m = d.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    refs = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("label_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"] % 1100).alias("refs"))
    return refs.withColumn("modified_text", F.concat(F.lit("changed"), F.when(F.col("label_idx") % 2 == 0, "!").otherwise(""))), d, m


LABELS = "(select l_orderkey as label_idx, list(l_partkey % 1100 order by l_linenumber, l_partkey) as refs, 'changed' || (case when l_orderkey % 2 = 0 then '!' else '' end) as modified_text from lineitem group by l_orderkey)"


@query("first_modified_doc", f"""with r as (select label_idx, i as pos, refs[i] as doc_id from {LABELS}, range(1, len(refs) + 1) t(i)),
x as (select label_idx, pos, r.doc_id, d.doc_id is null as gone, d.doc_id is not null and r.doc_id % 3 = 0 as hit from r left join documents d on d.doc_id = r.doc_id)
select label_idx, coalesce(min_by(doc_id, pos) filter (where hit), -1) as doc_id, bool_or(gone) as missing from x group by 1""")
def first_modified_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_modified(*corpus(spark, sf_dir)).fillna(-1, ["doc_id"])


@query("label_crossvalidate", f"""with r as (select label_idx, modified_text, unnest(refs) as doc_id from {LABELS})
select label_idx, bool_or(contains(coalesce(text, '') || (case when text is not null and r.doc_id % 3 = 0 then ' changed' else '' end), modified_text)) as valid from r left join documents d on d.doc_id = r.doc_id group by 1""")
def label_crossvalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, _, m = corpus(spark, sf_dir)
    return X.cross_validated(labels, m)


@query("diff_opcodes")
def diff_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character diff of every document and its edit; SQL has no such diff."""
    x = X.replaced_first(edits(spark, sf_dir))
    return X.diff_opcodes(x.select(F.col("doc_ord").alias("id"), F.col("content").alias("original"), F.col("edited").alias("modified"))).select("id", F.explode_outer("ops").alias("op")).select("id", "op.*")


@query("verify_labels", f"""with r as (select label_idx, i as pos, refs[i] as doc_id from {LABELS}, range(1, len(refs) + 1) t(i)),
x as (select label_idx, pos, r.doc_id, d.doc_id is null as gone, d.doc_id is not null and r.doc_id % 3 = 0 as hit, length(text) as n from r left join documents d on d.doc_id = r.doc_id),
f as (select label_idx, min_by(n, pos) filter (where hit) as n, bool_or(gone) as missing from x group by 1)
select label_idx, n is not null as passed, case when n is null then case when missing then 'missing document' else 'no difference' end else '' end as reason, coalesce(n, -1)::int as diff_start, coalesce(n + 8, -1)::int as diff_end from f""")
def verify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, d, m = corpus(spark, sf_dir)
    labels = labels.withColumns({"char_start": F.lit(0), "char_end": F.lit(0)})
    return X.verified(labels, d, m).drop("discrepancy").fillna(-1, ["diff_start", "diff_end"]).fillna("", ["reason"])


@query("verify_summary", f"""with v as (select label_idx % 50 as case_id, bool_or(doc_id % 3 = 0 and exists(from documents d where d.doc_id = r.doc_id)) as passed from (select label_idx, unnest(refs) as doc_id from {LABELS}) r group by label_idx)
select coalesce(case_id, -1) as case_id, count(*)::bigint as labels, count_if(passed)::bigint as passed, count_if(not passed)::bigint as rejected from v group by rollup (case_id)""")
def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, passed and rejected of each case, and of all."""
    f = X.first_modified(*corpus(spark, sf_dir)).select((F.col("label_idx") % 50).alias("case_id"), F.col("doc_id").isNotNull().alias("ok"))
    return f.rollup("case_id").agg(F.count("*").alias("labels"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("rejected")).fillna(-1, ["case_id"])


@query("dataset_manifest", f"""with g as (select * from {T.GOLD_SQL}) select 'scope' as kind, scope as value, count(*)::bigint as n, round(count(*) / sum(count(*)) over (), 6) as share from g group by scope
union all select 'detectability', detectability, count(*), round(count(*) / sum(count(*)) over (), 6) from g group by detectability""")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by scope and by detectability, with their shares."""
    g = T.gold(spark, sf_dir)
    long = g.select(F.inline(F.array(F.struct(F.lit("scope").alias("kind"), F.col("scope").alias("value")), F.struct(F.lit("detectability").alias("kind"), F.col("detectability").alias("value")))))
    counted = long.groupBy("kind", F.coalesce("value", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("kind").agg(F.sum("n").alias("all"))
    return counted.join(totals, "kind").select("kind", "value", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("corpus_manifest", """select source as case_id, count(*)::bigint as documents, sum(n_chars)::bigint as chars, count(distinct lang)::bigint as langs, string_agg(distinct lang, ',' order by lang) as lang_list from documents group by 1""")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("case_id")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("lang_list"))
