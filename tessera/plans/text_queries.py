"""Queries of classification, text quality, profiles and entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import written
from tessera.operators import classify as C
from tessera.operators import profiles as P
from tessera.plans import tables as T
from tessera.plans.registry import query

HEADS = ["Witness statement", "FAA letter", "Order of Hearing", "Weather study", "quality alert", "opening remarks", "Party submission", "Group Chair factual report", "plain notes", "10-A CVR", "3 survival factors", "Final Summary", "Tactical log", "arrest", "Powerplant", "15 lab"]
GROUPS = ["Operational Factors", "Recorders", "Materials", "Human Performance", "Hearing", "Party", "Regulatory", "Misc"]
SOURCES = ["ntsb", "grenfell", "copa", "other"]
# Entities of the tables' invented texts: frequent syllables stand in for organisations and equipment.
ORGS = {"The Heon Ther": ["heon", "ther heon"], "A Reer": ["reer"], "Stat": ["stat", "stst"], "Der Verein": ["der verein", "verein"], "Leaux": ["leaux"]}
GEAR = ["[A-Z][a-z]{2,5}eaux", "th[a-z]{2,6}tion", "[a-z]{3,6}heit"]


def pick(values: list[str], n: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(n) % len(values) + 1).cast("int"))


def pick_sql(values: list[str], n: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({n}) % {len(values)} + 1]"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat(pick(HEADS, "p_partkey"), F.lit(" "), "p_name").alias("title"), pick(GROUPS, "p_size").alias("grp"), pick(SOURCES, "p_size").alias("source"))


TITLED = f"(select p_partkey, {pick_sql(HEADS, 'p_partkey')} || ' ' || p_name as title, {pick_sql(GROUPS, 'p_size')} as grp, {pick_sql(SOURCES, 'p_size')} as source from part)"


def ladder(x: str, rules: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, '(?i){p}') then '{v}'" for p, v in rules) + f" else {default} end"


HINT = "case " + " ".join(f"when regexp_matches(lower(grp), '{'|'.join(w)}') then '{v}'" for w, v in C.GROUP_HINTS) + f" else '{C.DEFAULT_TYPE}' end"


@query("classify_titles", f"select p_partkey, {ladder('title', C.TITLE_RULES, HINT)} as document_type from {TITLED}")
def classify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir).select("p_partkey", C.document_type(F.col("title"), F.col("grp")).alias("document_type"))


SOURCE = "case source " + " ".join(f"when '{n}' then {ladder('title', r, repr(d))}" for n, (r, d) in C.SOURCE_RULES.items()) + " else 'document' end"


@query("classify_by_source", f"select p_partkey, {SOURCE} as document_type from {TITLED}")
def classify_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir).select("p_partkey", C.source_type(F.col("title"), F.col("source")).alias("document_type"))


NUMBER = f"regexp_extract(title, '{C.GROUP_PREFIX}', 1)"
NAMES = f"case {NUMBER} " + " ".join(f"when '{k}' then '{v}'" for k, v in C.GROUP_NUMBERS.items()) + f" else 'Group ' || {NUMBER} end"
WORDS = "case " + " ".join(f"when contains(upper(title), '{k}') then '{v}'" for k, v in C.GROUP_KEYWORDS) + " else 'Other' end"


@query("infer_group", f"select p_partkey, case when {NUMBER} <> '' then {NAMES} else {WORDS} end as grp from {TITLED}")
def infer_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir).select("p_partkey", C.document_group(F.col("title")).alias("grp"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a title from their first line, quality and type."""
    docs = T.docs(spark, sf_dir).withColumn("title", F.concat(pick(HEADS, "doc_ord"), F.lit(" "), F.substring_index("content", "\n", 1)))
    return P.text_quality(docs).withColumn("document_type", C.document_type(F.col("title"), pick(GROUPS, "doc_ord")))


S = "[^\\s\\p{Z}]+"
TYPED = f"""q as (select source as case_id, doc_id as doc_ord, text as content, {pick_sql(HEADS, 'doc_id')} || ' ' || split_part(text, chr(10), 1) as title, {pick_sql(GROUPS, 'doc_id')} as grp, len(regexp_extract_all(text, '{S}')) as words from documents),
t0 as (select *, case when words = 0 then 0.0 else len(regexp_extract_all(content, '[\\t-\\r -~]')) / length(content) end as char_ratio, case when words = 0 then 0.0 else length(array_to_string(regexp_extract_all(content, '{S}'), '')) / words end as avg_word_length,
  words::bigint as word_count, case when words = 0 then 0 else len(regexp_extract_all(content, '\\n')) + 1 end::bigint as line_count from q),
t as (select *, char_ratio >= 0.85 and word_count >= 100 and avg_word_length between 2.5 and 12.0 as passed, {ladder('title', C.TITLE_RULES, HINT)} as document_type from t0)"""


@query("doc_text_quality", f"with {TYPED} select case_id, doc_ord, round(char_ratio, 6) as char_ratio, round(avg_word_length, 6) as avg_word_length, word_count, line_count, passed from t")
def doc_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).select("case_id", "doc_ord", F.round("char_ratio", 6).alias("char_ratio"), F.round("avg_word_length", 6).alias("avg_word_length"), "word_count", "line_count", "passed")


@query("type_profiles", f"""with {TYPED}, g as (select *, row_number() over (partition by document_type order by doc_ord) as nth from t where passed)
select document_type, count(*)::bigint as count, min(word_count) as word_count_min, max(word_count) as word_count_max, round_even(avg(word_count), 1) as word_count_mean, round_even(avg(line_count), 1) as avg_line_count,
  string_agg(left(title, 100), ' | ' order by nth) filter (where nth <= 5) as example_titles from g group by document_type""")
def type_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.type_profiles(typed(spark, sf_dir))


@query("docket_summaries", f"with {TYPED} select case_id, count(*)::bigint as total, count_if(passed)::bigint as clean, round_even(count_if(passed) / count(*), 4) as clean_rate, count(distinct document_type)::bigint as types from t group by 1")
def docket_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.case_summaries(typed(spark, sf_dir))


@query("type_distribution", f"with {TYPED} select case_id, document_type, count(*)::bigint as n from t group by all")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.type_distribution(typed(spark, sf_dir))


@query("taxonomy", f"with {TYPED}, c as (select unnest([{', '.join(repr(x) for x in C.CANONICAL_TYPES)}]) as document_type) select document_type, count(doc_ord)::bigint as n, count(doc_ord) > 0 as present from c left join t using (document_type) group by 1")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.taxonomy(typed(spark, sf_dir))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.entity_mentions(typed(spark, sf_dir).where("passed"), ORGS, GEAR)


MENTIONS = (
    f"{TYPED}, m as ("
    + " union all ".join(
        [f"select case_id, doc_ord, '{n}' as name, 'organization' as entity_type from t where passed and ({' or '.join(f'contains(lower(content), {chr(39)}{f.lower()}{chr(39)})' for f in [n, *fs])})" for n, fs in ORGS.items()]
        + [f"select case_id, doc_ord, regexp_extract(content, '{p}', 0), 'equipment' from t where passed and regexp_extract(content, '{p}', 0) <> ''" for p in GEAR]
        + [f"select case_id, doc_ord, unnest(regexp_extract_all(content, '(?i){P.REGULATION}')[1:10] || regexp_extract_all(content, '(?i){P.DIRECTIVE}')), 'regulation' from t where passed"]
    )
    + ")"
)
PROFILES = f"{MENTIONS}, p as (select regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^the ', ''), '^a ', ''), '\\s+', ' ', 'g') as key, entity_type, count(distinct name)::bigint as n_aliases, string_agg(distinct name, ' | ' order by name) as aliases, count(distinct case_id)::bigint as n_cases, count(*)::bigint as mentions from m group by 1, 2)"


@query("entity_mentions", f"with {MENTIONS} select * from m")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir)


@query("entity_profiles", f"with {PROFILES} select key as name, * exclude key from p")
def entity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.entity_profiles(mentions(spark, sf_dir))


@query("entities_by_type", f"with {PROFILES} select entity_type, rank, key as name, n_cases, mentions from (select *, row_number() over (partition by entity_type order by n_cases desc, mentions desc, key)::int as rank from p) where rank <= 20")
def entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_by_type(P.entity_profiles(mentions(spark, sf_dir)))


@query("cross_case_sharing", f"with {PROFILES} select count_if(n_cases >= 2)::bigint as shared, coalesce(round_even(avg(n_cases) filter (where n_cases >= 2), 4), 0.0) as connectivity, count_if(n_aliases > 1)::bigint as with_variations from p")
def cross_case_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cross_case(P.entity_profiles(mentions(spark, sf_dir)))


def quality_gates_sql() -> str:
    return f"""with {PROFILES}, s as (select case_id, count(*) as total, round_even(count_if(passed) / count(*), 4) as clean_rate from t group by 1),
x as (select 'G1' as gate, (select count_if(total >= 10) from s)::double as actual, 5.0::double as threshold union all select 'G2', (select count_if(clean_rate < 0.8) from s), 0.0
  union all select 'G3', (select count(distinct document_type) from t), 6.0 union all select 'G4', (select count(distinct key) from p where n_cases >= 2), 10.0)
select gate, actual, threshold, case when gate = 'G2' then actual = 0 else actual >= threshold end as passed from x"""


@query("quality_gates", quality_gates_sql())
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once: a document leaves its case, quality and type, and the entities found in it."""
    docs = typed(spark, sf_dir)
    found = P.mentioned(F.col("content"), ORGS, GEAR)
    slim = written(docs.select("case_id", "doc_ord", "document_type", "passed", F.when(F.col("passed"), found).alias("found")))
    mentions_ = slim.select("case_id", "doc_ord", F.inline("found"))
    return P.quality_gates(P.case_summaries(slim), slim, P.entity_profiles(mentions_))
