"""Queries of planned edits and their labels, facts and distractors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import injection as I
from tessera.plans import tables as T
from tessera.plans.registry import query


def plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and up to six edits of each: words of it, what earlier edits put in, and every fourth an insertion; every ninth document is missing."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    rows = docs.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 6)))
    word = lambda n: F.get(F.split("content", " ", -1), n.cast("int"))
    old = F.when(F.col("place") % 3 == 0, word(F.col("place") + 1)).when(F.col("place") % 3 == 1, word(F.col("place") * 2)).otherwise("<")
    new = F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit("."), F.col("place").cast("string"), F.lit(">"))
    edits = rows.select("doc_id", "place", old.alias("old"), new.alias("new"), F.when(F.col("place") % 4 == 3, F.col("place")).alias("line"))
    return docs.where("doc_id % 9 <> 8"), edits.where("old <> '' or old is null")


PLAN = """p as (select *, row_number() over (partition by doc_id order by place) as k from (select doc_id, i as place, case i % 3 when 0 then w[i + 2] when 1 then w[i * 2 + 1] else '<' end as old, '<' || doc_id || '.' || i || '>' as new, case when i % 4 = 3 then i end as line
      from (select doc_id, string_split(coalesce(text, ''), ' ') as w from documents), range(0, 6) t(i) where i <= doc_id % 6) where old <> '' or old is null),
    r as (select doc_id, 0::bigint as k, coalesce(text, '') as t, []::struct(place bigint, ok boolean, s bigint, e bigint, a bigint, b bigint)[] as spans from documents where doc_id % 9 <> 8
      union all select doc_id, k, case when pos < 0 then t else left(t, pos) || ins || substr(t, pos + size + 1) end,
        list_append(list_transform(spans, lambda x: case when pos < 0 then x else {'place': x.place, 'ok': x.ok, 's': x.s, 'e': x.e,
          'a': case when x.a >= pos + size then x.a + length(ins) - size when x.b <= pos then x.a end, 'b': case when x.a >= pos + size then x.b + length(ins) - size when x.b <= pos then x.b end} end),
          {'place': place, 'ok': pos >= 0, 's': case when pos < 0 then null when line is null then instr(left(t, pos) || ins || substr(t, pos + size + 1), ins) - 1 else pos end,
           'e': case when pos < 0 then null when line is null then instr(left(t, pos) || ins || substr(t, pos + size + 1), ins) - 1 + length(ins) else pos + length(ins) end,
           'a': case when pos >= 0 then pos end, 'b': case when pos >= 0 then pos + length(ins) end})
      from (select r.doc_id, p.k, t, spans, place, line, case when line is null then new else ' ' || trim(new) || ' ' end as ins, case when line is null then length(old) else 0 end as size,
        case when line is not null then least(length(array_to_string(string_split(t, chr(10))[1:line + 1], chr(10))) + 1, length(t)) when old is null then -1 else instr(t, old) - 1 end as pos from r join p on p.doc_id = r.doc_id and p.k = r.k + 1)),
    last as (select * from (select *, max(k) over (partition by doc_id) as m from r) where k = m)"""


@query("injected_labels", f"with recursive {PLAN} select doc_id, x.place as place, x.s as char_start, x.e as char_end, x.a as last_start, x.b as last_end, not (x.s is not distinct from x.a and x.e is not distinct from x.b) as stale from (select doc_id, unnest(spans) as x from last) where x.ok")
def injected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a plan's edits, each made in the text that the ones before it left."""
    labels = I.injected(*plan(spark, sf_dir))[1]
    return labels.select("doc_id", "place", "char_start", "char_end", "last_start", "last_end", "stale")


@query("injected_documents", f"with recursive {PLAN} select doc_id, length(t)::bigint as chars, md5(t) as digest from last")
def injected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after all edits of a plan."""
    texts = I.injected(*plan(spark, sf_dir))[0]
    return texts.select("doc_id", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"))


@query("injection_failures", f"with recursive {PLAN} select p.doc_id, p.place, case when last.doc_id is null then 'missing document' else 'original_text not found in document' end as reason from p left join last using (doc_id) where last.doc_id is null or not list_filter(spans, lambda x: x.place = p.place)[1].ok")
def injection_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, edits = plan(spark, sf_dir)
    return I.failures(I.applied(docs, edits), docs)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about documents as a model would write them: some in fences, some broken, some errors."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("case_id"), F.substring(F.coalesce("text", F.lit("")), 1, 20).alias("old"))
    k = F.col("doc_id")
    body = F.to_json(F.struct(F.when(k % 4 != 1, F.col("old")).alias("original_text"), F.when(k % 7 != 3, F.concat(F.lit("new "), "old")).alias("modified_text"), F.when(k % 3 == 0, k % 5).alias("insertion_paragraph"), F.when(k % 6 != 2, F.col("old")).alias("description")))
    text = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 11 == 5, "none").otherwise(body)
    return d.select("doc_id", "case_id", k.alias("place"), F.when(k % 3 == 0, "inter_doc").otherwise("intra_doc").alias("scope"), F.lit("expert_opinion").alias("divergence"), F.array(k, k + 1).alias("refs"), F.when(k % 13 != 4, text).alias("answer"), F.when(k % 13 == 4, "no answer").alias("error"))


ANSWERS = "a as (select doc_id, source as case_id, left(coalesce(text, ''), 20) as old, doc_id % 3 = 0 as inter, doc_id % 13 = 4 as error, doc_id % 2 = 1 and doc_id % 11 = 5 as broken from documents)"


@query("planned_edits", f"""with {ANSWERS}, x as (select *, not error and not broken and doc_id % 7 <> 3 and (inter or doc_id % 4 <> 1) as sound from a)
select doc_id, case when sound and not inter then old end as old, case when sound then 'new ' || old end as new, case when sound and inter then doc_id % 5 end as line, case when error then 'no answer' when not sound then 'no edit in the answer' end as reason from x""")
def planned_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits, lost = I.planned(answers(spark, sf_dir))
    return edits.drop("place").unionByName(lost.drop("place"), allowMissingColumns=True)


@query("distractor_labels", f"with {ANSWERS} select case_id, doc_id as place, case when inter then 'inter_doc' else 'intra_doc' end as scope, doc_id || ',' || (doc_id + 1) as refs, old as description from a where not error and not broken and doc_id % 6 <> 2")
def distractor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = I.distractors(answers(spark, sf_dir))[0]
    return labels.select("case_id", "place", "scope", F.array_join("document_references", ",").alias("refs"), "description")
