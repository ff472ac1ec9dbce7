"""Queries of sources: links of pages, dated file names in ranges, validation and the audit boundary, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators.ranges import first_range
from tessera.plans import tables as T
from tessera.plans.registry import query
from tessera.sources import corpus as C
from tessera.sources import html as H

MODULES = [(1, "1992-01-01", "1994-06-30"), (2, "1994-07-01", "1996-12-31"), (3, "1997-01-01", "1998-12-31")]


@query("page_links", """select page_id, pos::int as pos, href from (select page_id, unnest(h) as href, unnest(range(len(h))) as pos from
  (select page_id, list_transform(list_sort(list_transform(list_distinct(l), lambda x: {'i': list_position(l, x), 'x': x})), lambda s: s.x) as h from (select page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) as l from pages)))""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.links_in(T.table(spark, sf_dir, "pages"))


@query("date_ranges", f"""select o_orderkey, coalesce(min(m), -1)::int as module from orders left join (values {', '.join(f"({m}, date '{a}', date '{b}')" for m, a, b in MODULES)}) t(m, a, b) on o_orderdate::date between a and b group by 1""")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module whose range holds an order's day."""
    modules = spark.createDataFrame(MODULES, "module int, a string, b string").select("module", F.to_date("a").alias("start"), F.to_date("b").alias("end"))
    found = first_range(T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), modules, "o_orderdate", "module")
    return found.select("o_orderkey", F.coalesce("module", F.lit(-1)).alias("module"))


@query("label_validation", f"select label_idx, case when scope in ('intra_doc', 'inter_doc') and detectability in ('single_hop', 'multi_hop', 'entity_resolution_dependent') then '' else 'x' end || case when label_idx % 4 = 0 then 'difficulty' else '' end || case when label_idx % 5 = 0 then 'char_start' else '' end as errors from {T.GOLD_SQL}")
def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.gold(spark, sf_dir).withColumns({
        "mechanism": F.lit("entity_swap"), "difficulty": F.when(F.col("label_idx") % 4 == 0, "odd").otherwise("easy"), "char_start": F.when(F.col("label_idx") % 5 == 0, -1).otherwise(3), "char_end": F.lit(5),
    })
    return C.label_errors(g).select("label_idx", F.array_join("errors", "").alias("errors"))


@query("docket_rows", f"""select p_partkey % 50 as page_id, p_partkey::int as item_number, 'Group ' || p_size || ' ' || p_name as title, (case when p_partkey % 7 = 0 then 0 else p_size end)::int as page_count, case when p_partkey % 2 = 0 then 'txt' else 'pdf' end as file_type,
  '/doc?id=' || p_partkey || case when p_partkey % 2 = 0 then '&FileExtension=TXT&x=1' else '' end as href from part where p_partkey % 11 <> 0 and p_partkey % 5 <> 0 and p_partkey % 13 <> 0""")
def docket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents listed in pages made of parts: the larger of two tables counts; rows with too few cells, no number or no link don't."""
    p, k = T.table(spark, sf_dir, "part"), F.col("p_partkey")
    text = lambda x: F.concat(F.lit("<td> "), x, F.lit(" </td>"))
    key = k.cast("string")
    href = F.concat(F.lit("/doc?id="), key, F.when(k % 2 == 0, "&amp;FileExtension=TXT&amp;x=1").otherwise(""))
    link = F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit('<a class="x" href="'), href, F.lit('">View</a>')))
    cells = [F.when(k % 11 == 0, "n/a").otherwise(key), F.concat(F.lit("Group "), F.col("p_size").cast("string"), F.lit(" "), "p_name"), F.when(k % 7 == 0, "?").otherwise(F.col("p_size").cast("string")), F.lit("0"), F.lit("PDF")]
    row = F.concat(F.lit("<tr>"), *map(text, cells), F.when(k % 13 == 0, "").otherwise(text(link)), F.lit("</tr>\n"))
    head = "<html><table><tr><td>1</td></tr></table><table><tr><th>Item</th><th>Title</th></tr>"
    pages = p.select((k % 50).alias("page_id"), k.alias("k"), row.alias("row")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "").alias("rows"))
    return H.docket_rows(pages.select("page_id", F.concat(F.lit(head), "rows", F.lit("</table>")).alias("html"))).drop("group")


def stub(prompt: str):
    """Answers a question about one text with its first words as a claim; of comparisons and lists it flags nothing."""
    words = prompt.split("\n", 1)[-1].split()
    if not prompt.startswith("List") or len(words) < 3:
        return "[]", None
    quote = lambda w: w.replace("\\", "").replace('"', "")
    return f'```json\n[{{"subject": "{quote(words[0])}", "predicate": "{quote(words[1])}", "object": "{quote(words[2])}", "confidence": 1.5}}]\n```', None


@query("model_claims", """with w as (select source as case_id, doc_id as doc_ord, list_filter(regexp_split_to_array(text, '[\\s]+'), lambda x: x <> '') as w from documents)
select case_id, doc_ord, 'claim_' || lpad((row_number() over (partition by case_id order by doc_ord) - 1)::varchar, 4, '0') as claim_id, replace(replace(w[1], '\\', ''), '"', '') as subject, 1.0::double as confidence from w where len(w) >= 3""")
def model_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by a deterministic stand-in for a model."""
    return A.claims(T.docs(spark, sf_dir), stub).select("case_id", "doc_ord", "claim_id", "subject", "confidence")
