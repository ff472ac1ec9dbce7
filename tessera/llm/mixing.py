"""Mixing sources to target weights: hierarchical budgets and token prefixes of seeded epochs. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import sized, table, written

SEED = 17
MAX_EPOCHS = 2
#: Domains of the tables at hand: source numbers modulo 4.
DOMAIN = "coalesce('d' || cast(try_cast(regexp_extract(source, '[0-9]+$', 0) as int) % 4 as string), 'unknown')"
DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
LEAF = ["domain", "lang", "source"]
#: Hex digits of a document's place that make its bucket, so that no window holds a whole leaf.
BUCKET = 3


def weight(name: str, weights: Mapping[str, float]) -> Column:
    """The node's weight; 1 where none is given."""
    out = F.lit(1.0)
    for k, w in sorted(weights.items()):
        out = F.when(F.col(name) == k, F.lit(float(w))).otherwise(out)
    return out


def filled(nodes: DataFrame, parent: list[str], node: str, budget: str) -> DataFrame:
    """``nodes`` with ``share``: the parent's budget dealt by ``weight`` among siblings, none above its ``capacity``; what one cannot hold goes to the others by weight.

    In order of capacity for a weight, a node is full if the level that is left for it and those after it reaches that; the rest share at the level of the first that is not.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), node)
    before = F.coalesce(F.sum("capacity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.where("weight > 0").withColumn("level", (F.col(budget) - before) / rest).withColumn("full", F.col("capacity") / F.col("weight") <= F.col("level"))
    nodes = nodes.withColumn("at", F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent)))
    return nodes.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.greatest(F.lit(0.0), F.col("weight") * F.col("at")))).drop("level", "full", "at")


def budgets(leaves: DataFrame, target: float | None, max_epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget``: the target dealt down the tree. A node's capacity is that of its leaves, so a shortage stays among siblings while they can hold it and goes up only then."""
    leaves = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight("lang", weights.get("lang", {})))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", weight("domain", weights.get("domain", {})))
    root = domains.withColumn("root", F.lit(0)).withColumn("all", F.lit(float(target)) if target is not None else F.sum("tokens").over(Window.partitionBy("root")).cast("double"))
    a = filled(root, ["root"], "domain", "all").select("domain", F.col("share").alias("domain_budget"))
    b = filled(langs.join(a, "domain"), ["domain"], "lang", "domain_budget").select("domain", "lang", F.col("share").alias("lang_budget"))
    c = filled(leaves.withColumn("weight", weight("source", weights.get("source", {}))).join(b, ["domain", "lang"]), ["domain", "lang"], "source", "lang_budget")
    return c.select(*LEAF, "tokens", F.floor(F.col("share") + 1e-6).alias("budget"))


def place(seed: int, epoch: Column) -> Column:
    """A document's place in the order of an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leafed(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """``docs`` with a struct ``leaf`` and the number of words, ``n_tokens``."""
    return docs.withColumn(
        "leaf", F.struct(F.expr(domain).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"))
    ).withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit("[^ \t\n\r\f]+")), F.lit(0)).cast("long"))


def mixed(docs: DataFrame, target: float | None = None, domain: str = DOMAIN, weights: Mapping[str, Mapping[str, float]] | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The chosen rows of ``docs`` with ``leaf``, ``n_tokens``, ``epoch`` and the leaf's ``budget`` added, once for each epoch they are chosen in.

    ``target`` tokens (words; as many as there are, if not given) are dealt over domains, their languages and their
    sources. A leaf gives whole epochs while its budget lasts and then, of an epoch in seeded order of its own, the
    documents whose running sum of tokens is within what is left; equal places (repeated rows) go together. Null
    lang and source are ``unknown``; null and empty texts have no tokens, and leaves without tokens give nothing; a
    null doc_id has a place like any other. Columns of the added names are replaced. No rows give none.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANGUAGE_WEIGHTS}
    docs = docs.drop("leaf", "n_tokens", "epoch", "budget")
    slim = written(leafed(docs.select("doc_id", "text", "lang", "source"), domain).select("doc_id", "leaf.*", "n_tokens"))
    leaves = budgets(slim.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), target, max_epochs, weights)
    leaves = leaves.withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs)))
    leaves = written(leaves.withColumn("over", F.when(F.col("epochs") < max_epochs, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0))))
    placed = slim.join(sized(leaves.where("over > 0").select(*LEAF, "epochs", "over")), LEAF).withColumn("place", place(seed, F.col("epochs")))
    placed = written(placed.select(*LEAF, "n_tokens", "over", "place", F.substring("place", 1, BUCKET).alias("bucket")))
    sums = placed.groupBy(*LEAF, "over", "bucket").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket")))
    edge = written(sums.where("upto > over").groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("edge")).select(*LEAF, "edge.*"))
    inside = placed.join(sized(edge), [*LEAF, "bucket"])
    inside = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF, "bucket").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)))
    cut = inside.where("upto <= over").groupBy(*LEAF).agg(F.max("place").alias("cut"))
    plan = leaves.join(edge.select(*LEAF, "bucket"), LEAF, "left").join(cut, LEAF, "left")
    plan = written(plan.select(F.struct(*LEAF).alias("leaf"), "budget", "epochs", F.coalesce("cut", "bucket", F.lit("")).alias("cut")))
    chosen = leafed(docs, domain).join(sized(plan), "leaf")
    partial = F.when(place(seed, F.col("epochs")) <= F.col("cut"), F.array(F.col("epochs"))).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)).otherwise(F.array().cast("array<bigint>"))
    return chosen.select(*docs.columns, "leaf", "n_tokens", F.explode(F.concat(whole, partial)).alias("epoch"), "budget")


def op7_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("leaf.domain").alias("domain"), F.col("leaf.lang").alias("lang"), F.col("leaf.source").alias("source"), "n_tokens", "epoch", "budget")


def _case(name: str, weights: Mapping[str, float]) -> str:
    return f"(case {name} " + " ".join(f"when '{k}' then {w}::double" for k, w in sorted(weights.items())) + " else 1.0::double end)"


def _fill(source: str, parent: str, node: str, budget: str) -> str:
    return f"""
      select *, case when filled then capacity else greatest(0.0, weight * max(case when not filled then level end) over (partition by {parent})) end as share
      from (select *, capacity / weight <= level as filled
            from (select *, ({budget} - coalesce(sum(capacity) over (partition by {parent} order by capacity / weight, {node} rows between unbounded preceding and 1 preceding), 0.0))
                            / sum(weight) over (partition by {parent} order by capacity / weight, {node} rows between current row and unbounded following) as level
                  from {source} where weight > 0))"""


SQL = f"""
with slim as (
  select doc_id, coalesce('d' || cast(try_cast(regexp_extract(source, '[0-9]+$', 0) as int) % 4 as varchar), 'unknown') as domain,
         coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::bigint as n_tokens
  from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::double * {MAX_EPOCHS} as capacity, 1.0::double as weight from slim group by all having sum(n_tokens) > 0),
langs as (select domain, lang, sum(capacity) as capacity, {_case("lang", LANGUAGE_WEIGHTS)} as weight from leaves group by domain, lang),
domains as (select domain, 0 as root, sum(capacity) as capacity, {_case("domain", DOMAIN_WEIGHTS)} as weight, sum(sum(tokens)) over ()::double as everything from leaves group by domain),
a as ({_fill("domains", "root", "domain", "everything")}),
b0 as (select langs.*, a.share as parent_budget from langs join a using (domain)),
b as ({_fill("b0", "domain", "lang", "parent_budget")}),
c0 as (select leaves.*, b.share as parent_budget from leaves join b using (domain, lang)),
c as ({_fill("c0", "domain, lang", "source", "parent_budget")}),
plan as (select domain, lang, source, tokens, floor(share + 1e-6)::bigint as budget, least(floor(floor(share + 1e-6) / tokens), {MAX_EPOCHS})::bigint as epochs from c),
ranked as (
  select slim.*, budget, epochs, case when epochs < {MAX_EPOCHS} then budget - epochs * tokens else 0 end as over,
         sum(n_tokens) over (partition by domain, lang, source order by md5('{SEED}:' || epochs || ':' || coalesce(doc_id::varchar, '')) range between unbounded preceding and current row) as upto
  from slim join plan using (domain, lang, source))
select doc_id, domain, lang, source, n_tokens, epoch, budget from (
  select *, unnest(range(epochs + (case when over > 0 and upto <= over then 1 else 0 end)::bigint)) as epoch from ranked)
"""

QUERIES = {"op7_hierarchical_mixing": op7_hierarchical_mixing}
ORACLES = {"op7_hierarchical_mixing": SQL}
