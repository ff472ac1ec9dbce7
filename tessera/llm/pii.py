"""Personal data: base patterns by position, and terms that disclose them by corpus co-occurrence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import sized, table, written

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns with starts pinned to where a leftmost match can begin, so that no run is scanned twice. A
#: card's run of digits is matched only where it has 16 to 19, which drops the same matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
HINTS = {"email": r"text like '%@%'", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9][0-9 -]{14}'", "phone": r"text like '%+%'"}
DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
LUHN = f"""aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + case when (length({DIGITS}) - i) % 2 = 0 then cast(substring({DIGITS}, i, 1) as int)
    else cast(substring('0246813579', 1 + cast(substring({DIGITS}, i, 1) as int), 1) as int) end) % 10 = 0"""
TESTS = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> cast(p as double) <= 255)",
    "card": f"length({DIGITS}) between 16 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 8 and 15",
}
#: The entities that a span x stands for: its value, and the wider classes that it backs off to.
ENTITIES = {
    "email": ["'email:' || lower(x.v)", "'domain:' || lower(substring_index(x.v, '@', -1))"],
    "ip": ["'ip:' || x.v", "'network:' || substring_index(x.v, '.', 2)"],
    "card": [f"'card:' || {DIGITS}", f"'issuer:' || left({DIGITS}, 6)"],
    "phone": [f"'phone:' || {DIGITS}", f"'area:' || left({DIGITS}, 4)"],
}
#: Distinct texts that an entity and a term must share, and shares of the entity's information at which a term is generalised and removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.9, 0.98
WORD = r"(?<!\p{L})\p{L}{3,}(?!\p{L})"


def literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(pattern: str, text: str = "text") -> str:
    """SQL for the array of (s, e, v) of the pattern's leftmost non-overlapping matches: the pieces between matches and the matches give the positions, in code points."""
    return f"""aggregate(
        zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (p, m) -> struct(p, m)),
        struct(0 as at, cast(array() as array<struct<s: int, e: int, v: string>>) as found),
        (a, x) -> if(x.m is null, a, struct(a.at + length(x.p) + length(x.m) as at,
            concat(a.found, array(struct(a.at + length(x.p) as s, a.at + length(x.p) + length(x.m) as e, x.m as v))) as found)),
        a -> a.found)"""


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of (s, e, v) for each kind; none in a null text."""
    none = "cast(array() as array<struct<s: int, e: int, v: string>>)"
    return docs.withColumns({k: F.expr(f"case when {HINTS[k]} then filter({spans(literal(PATTERNS[k]))}, x -> {TESTS[k]}) else {none} end") for k in KINDS})


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def based(docs: DataFrame) -> DataFrame:
    """``docs`` with the base spans, the text's ``_key`` and its ``_entities``, written once for all that reads them."""
    entities = ", ".join(f"transform({k}, x -> {e})" for k in KINDS for e in ENTITIES[k]) + ", " + ", ".join(f"if(size({k}) > 0, array('kind:{k}'), array())" for k in KINDS)
    return written(with_base(docs).withColumn("_key", text_key()).withColumn("_entities", F.expr(f"array_distinct(concat({entities}))")))


def disclosures(found: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """(entity, term, ratio) of the terms that tell of a protected entity, from what ``based`` gives.

    An entity is a value that the base patterns find, or a class that it backs off to where values are too rare to
    count: its domain, network, issuer or area, and its kind. Terms are the distinct words of whole texts. In counts of
    documents, an entity's information is IC(c) = log2(N / n(c)) and a term discloses PMI(c; t) = log2(N n(c,t) /
    (n(c) n(t))) of it. Terms are kept whose ratio PMI / IC is ``threshold`` at least and that share ``support``
    distinct texts with the entity, so that a text and its copies prove nothing.
    """
    hits = found.where("size(_entities) > 0")
    # A row for each text; its copies are counted with it.
    once = hits.select("_key", "_entities", words(F.col("text")).alias("terms")).groupBy("_key").agg(F.count("*").alias("copies"), F.first("_entities").alias("entities"), F.first("terms").alias("terms"))
    once = written(once.select("copies", "entities", "terms"))
    entities = once.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("of_entity"))
    entities = written(entities.where(F.col("texts") >= support).select("entity", "of_entity"))
    pairs = once.select("copies", "terms", F.explode("entities").alias("entity")).join(sized(entities.select("entity")), "entity")
    terms = pairs.select("entity", "copies", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("both"))
    terms = written(terms.where(F.col("texts") >= support).select("entity", "term", "both"))
    wanted = written(terms.select("term").distinct())
    # Counted first: a join before would have a row for each document of each frequent term.
    everywhere = found.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("of_term")).join(sized(wanted), "term")
    information = F.log2(F.lit(float(max(found.count(), 1))) / F.col("of_entity"))
    ratio = 1 + F.log2(F.col("both") / F.col("of_term")) / information
    return terms.join(sized(entities), "entity").join(everywhere, "term").where(information > 0).select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= threshold)


def sanitised(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with the base spans (``email``, ``ip``, ``card``, ``phone``), ``term`` spans (s, e, v, removed) and ``clean_text``.

    A text's terms are those it has that disclose an entity, by ``disclosures``, whether or not it has the entity
    too; all their occurrences, apart from base spans, are replaced by [TERM], or taken out where they disclose
    ``remove`` of some entity. Base spans are replaced by their kind; of spans that overlap the one that starts first
    (then the longer) covers the other. Null texts have no spans and stay null; empty tables give none; other columns
    are kept unless of the names added or used here (``_key``, ``_entities``); repeated rows are treated alike.
    """
    docs = docs.drop(*KINDS, "term", "clean_text", "_key", "_entities", "_told")
    found = based(docs)
    told = written(disclosures(found, support, generalise))
    if told.limit(1).count():
        terms = written(told.groupBy("term").agg((F.max("ratio") >= remove).alias("removed")))
        has = found.select("_key", F.explode(words(F.col("text"))).alias("term")).join(sized(terms), "term")
        by_text = written(has.groupBy("_key").agg(F.collect_set(F.struct("term", "removed")).alias("_told")))
        found = found.join(sized(by_text), "_key", "left")
    else:
        found = found.withColumn("_told", F.lit(None).cast("array<struct<term: string, removed: boolean>>"))
    pattern = "concat('(?iu)(?<!\\\\p{L})(?:', array_join(array_sort(array_distinct(transform(_told, t -> t.term))), '|'), ')(?!\\\\p{L})')"
    base = "concat(" + ", ".join(KINDS) + ")"
    term = f"""transform(filter({spans(pattern)}, x -> not exists({base}, b -> b.s < x.e and x.s < b.e)),
        x -> struct(x.s as s, x.e as e, x.v as v, exists(_told, t -> t.removed and t.term = lower(x.v)) as removed))"""
    found = found.withColumn("term", F.expr(f"case when size(_told) > 0 then {term} else cast(array() as array<struct<s: int, e: int, v: string, removed: boolean>>) end")).drop("_told", "_key", "_entities")
    masks = "array_sort(concat(" + ", ".join(f"transform({k}, x -> struct(x.s as s, -x.e as e, '[{k.upper()}]' as mask))" for k in KINDS) + ", transform(term, x -> struct(x.s as s, -x.e as e, if(x.removed, '', '[TERM]') as mask))))"
    clean = f"""aggregate({masks}, struct(0 as at, cast(array() as array<string>) as parts),
        (a, x) -> if(x.s < a.at, struct(greatest(a.at, -x.e) as at, a.parts as parts), struct(-x.e as at, concat(a.parts, array(substring(text, a.at + 1, x.s - a.at), x.mask)) as parts)),
        a -> concat(array_join(a.parts, ''), substring(text, a.at + 1)))"""
    return found.withColumn("clean_text", F.expr(f"case when {' + '.join(f'size({k})' for k in [*KINDS, 'term'])} > 0 then {clean} else text end"))


def digest(kinds: list[str]) -> Column:
    return F.array_join(F.expr("concat(" + ", ".join(f"transform({k}, x -> '{k}:' || x.s || ':' || x.e)" for k in kinds) + ")"), ",")


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitised(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(digest(KINDS), 256).alias("base_sha256"), digest([*KINDS, "term"]).alias("spans"), F.expr(" + ".join(f"size({k})" for k in [*KINDS, "term"])).cast("long").alias("n_spans"))


QUERIES = {"op10_pii_sanitisation": op10_pii_sanitisation}
ORACLES: dict[str, str] = {}
