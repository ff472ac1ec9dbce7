"""Summaries, indexes and plans over labels, claims, links and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fact types that suit a mechanism.
FACT_TYPES = {
    "numeric_drift": ["numeric"],
    "entity_swap": ["entity"],
    "causal_inversion": ["causal"],
    "temporal_contradiction": ["temporal"],
    "omission_based_implicit": ["qualification"],
    "temporal_revision_conflict": ["revision", "temporal"],
}
# Notes of structure, their bounds, and a note for each type.
NUMBERED, HEADERS, TABULAR = "Contains numbered sections/subsections", "Contains uppercase section headers", "Contains tabular data"
NO_TEXT = "No text available for structural analysis"
LENGTH_NOTES = [(5000, "Long-form document (>5000 words typical)"), (1000, "Medium-length document (1000-5000 words)"), (None, "Short document (<1000 words)")]
TYPE_NOTES = {
    "investigation_report": "Formal factual report with structured sections and findings",
    "technical_analysis": "Detailed technical data with specialized terminology",
    "witness_testimony": "Narrative/Q&A format, first-person accounts",
    "regulatory_filing": "Formal regulatory language, references to CFR/FAR",
    "expert_deposition": "Argumentative structure, evidence-based reasoning",
    "internal_memo": "Organizational communication, process-oriented",
    "preliminary_report": "Summary format, initial findings and procedural content",
}


def facets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, value): the distinct kinds of nodes (kind) and of edges (kind)."""
    side = lambda x, name: x.where("kind is not null").select(F.lit(name).alias("side"), F.col("kind").alias("value")).distinct()
    return side(nodes, "node").union(side(edges, "edge"))


def totals(parts: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the number of rows of each part, in one aggregate a part."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


def unique_documents(files: DataFrame, claims: DataFrame) -> DataFrame:
    """(document): the documents that have a file or a claim; an empty name is none."""
    return files.select("document").union(claims.select("document")).where("document is not null and cast(document as string) <> ''").distinct()


def breakdown(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, breakdown): a map from each value of a key to its count; a missing value counts as unknown."""
    counted = rows.groupBy(key, F.coalesce(value, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("breakdown"))


def annotations(labels: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(node, label_ids, n): the labels (label_id, refs) that reach each node. Without ``members`` nodes are the documents themselves and a document referred to twice counts twice; with them (document, node) each label counts once a node."""
    rows = labels.select("label_id", F.explode("refs").alias("document"))
    if members is None:
        rows = rows.withColumnRenamed("document", "node")
    else:
        rows = rows.distinct().join(members.distinct(), "document").select("label_id", "node").distinct()
    return rows.groupBy("node").agg(F.sort_array(F.collect_list("label_id")).alias("label_ids"), F.count("*").alias("n"))


def link_index(links: DataFrame) -> DataFrame:
    """(claim_id, link_ids): the links (link_id, claim_ids) that each claim takes part in."""
    return links.select("link_id", F.explode("claim_ids").alias("claim_id")).groupBy("claim_id").agg(F.sort_array(F.collect_list("link_id")).alias("link_ids"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, relation, other): each edge (a, b, relation) at its source, and at its target with the relation turned round."""
    back = edges.select(F.col("b").alias("node"), F.concat(F.lit("<- "), "relation").alias("relation"), F.col("a").alias("other"))
    return edges.select(F.col("a").alias("node"), "relation", F.col("b").alias("other")).union(back)


def traced(labels: DataFrame, members: DataFrame) -> DataFrame:
    """(label_id, nodes): the distinct nodes (document, node) that a label's documents touch."""
    rows = labels.select("label_id", F.explode("refs").alias("document")).distinct().join(members.distinct(), "document")
    return rows.groupBy("label_id").agg(F.sort_array(F.collect_set("node")).alias("nodes"))


def merged_links(cross_refs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(claim_ids, relation, rationale) of pairwise references in any of their shapes and of clusters. Empty strings and lists count as missing; a reference that names its source alone has one claim, one without a source none."""
    some = lambda x, *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in x.columns], F.lit(None).cast("string"))
    listed = lambda x: F.coalesce(F.col("claim_ids"), F.array().cast("array<string>")) if "claim_ids" in x.columns else F.array().cast("array<string>")
    a, b = some(cross_refs, "source_claim", "from_claim"), some(cross_refs, "target_claim", "to_claim")
    named = F.when(a.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(a, b)))
    pairs = cross_refs.select(
        F.when(F.size(listed(cross_refs)) > 0, listed(cross_refs)).otherwise(named).alias("claim_ids"),
        F.coalesce(some(cross_refs, "relationship_type", "relationship"), F.lit("cross_reference")).alias("relation"),
        some(cross_refs, "rationale", "description").alias("rationale"),
    )
    return pairs.union(clusters.select(listed(clusters).alias("claim_ids"), F.coalesce(some(clusters, "relation"), F.lit("cross_reference")).alias("relation"), some(clusters, "theme").alias("rationale")))


def first_of_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in an order; Spark cuts groups before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= n)


def plain_id(name: Column) -> Column:
    """A document's id without the ending of its text file."""
    return F.regexp_replace(name, r"\.txt$", "")


def searched(nodes: DataFrame, q: str, first: int = 500, most: int = 60) -> DataFrame:
    """The first ``most`` by name of the first ``first`` nodes (node, name, aliases) whose name, id or alias holds the query."""
    text = F.lower(F.concat_ws(" ", "name", F.col("node").cast("string"), F.array_join("aliases", " ")))
    return nodes.orderBy("node").limit(first).where(F.contains(text, F.lit(q.strip().lower()))).orderBy("name", "node").limit(most)


def titled(files: DataFrame, metadata: DataFrame, derived: Column) -> DataFrame:
    """Adds title and word_count to files (name, content): those of the metadata (item_number, title, word_count) under the number that the name begins with, else the ``derived`` title and the words counted. Number 0 is no number; a missing word_count is 0."""
    number = F.regexp_extract("name", r"^(\d+)_", 1).try_cast("int")
    m = metadata.select(F.col("item_number").alias("_item"), F.col("title").alias("_title"), F.coalesce("word_count", F.lit(0)).alias("_words"))
    joined = files.withColumn("_number", F.when(number != 0, number)).join(m, F.col("_number") == F.col("_item"), "left")
    words = F.regexp_count("content", F.lit(r"(?U)\S+"))
    found = F.col("_item").isNotNull()
    return joined.withColumns({"title": F.when(found, F.col("_title")).otherwise(derived), "word_count": F.when(found, F.col("_words")).otherwise(words).cast("bigint")}).drop("_number", "_item", "_title", "_words")


def facts_for(facts: DataFrame, key: str) -> DataFrame:
    """The facts (key, mechanism, type) whose type suits the mechanism; all of a key's where none does or the mechanism names none."""
    types = F.create_map(*[x for m, t in FACT_TYPES.items() for x in (F.lit(m), F.array(*map(F.lit, t)))])
    suits = F.coalesce(F.array_contains(types[F.col("mechanism")], F.col("type")), F.lit(False))
    return facts.withColumn("_suits", suits).withColumn("_any", F.max("_suits").over(Window.partitionBy(key))).where("_suits or not _any").drop("_suits", "_any")


def sharing(profiles: DataFrame) -> DataFrame:
    """(name, cases): each name's cases from its profiles (ord, name, cases); of several profiles of a name the last holds."""
    return profiles.groupBy("name").agg(F.max_by("cases", "ord").alias("cases"))


def percent(x: Column) -> Column:
    """A share as whole per cent, halves to even."""
    return F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))


def rate_notes(summaries: DataFrame, least: float = 0.8) -> DataFrame:
    """(case_id, note): the share of documents that passed over all cases (case_id null; none without documents), and of each case under ``least``."""
    all_ = summaries.agg(F.sum("total").alias("total"), F.sum("clean").alias("clean")).where("total > 0")
    head = all_.select(F.lit(None).cast("string").alias("case_id"), F.concat(F.lit("Overall extraction: "), "clean", F.lit("/"), "total", F.lit(" documents passed quality ("), percent(F.col("clean") / F.col("total")), F.lit(")")).alias("note"))
    low = summaries.where(F.col("clean_rate") < least)
    return head.union(low.select(F.col("case_id").cast("string"), F.concat(F.lit("Docket "), "case_id", F.lit(": low clean rate ("), percent(F.col("clean_rate")), F.lit(")"))))


def template_notes(profiles: DataFrame) -> DataFrame:
    """(document_type, note): the length that a template aims at, with the first two notes of structure (notes)."""
    p = profiles
    note = F.concat(F.lit("Template for '"), "document_type", F.lit("': target "), p["word_count_min"].cast("string"), F.lit("-"), p["word_count_max"].cast("string"), F.lit(" words (mean "), p["word_count_mean"].cast("string"), F.lit("). "), F.array_join(F.slice("notes", 1, 2), "; "))
    return p.select("document_type", note.alias("note"))


def structural_notes(docs: DataFrame, sample: int = 5) -> DataFrame:
    """(document_type, notes) from the first ``sample`` documents (document_type, doc_ord, content) of each type: patterns of their beginnings, a length, and what holds for the type. Texts that are null or empty are passed over; a type without any text says so."""
    first = docs.withColumn("_nth", F.row_number().over(Window.partitionBy("document_type").orderBy("doc_ord"))).where(F.col("_nth") <= sample)
    t = F.when(F.col("content") != "", F.col("content"))
    head = F.substring(t, 1, 500)
    upper = lambda line: (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) > 3) & (F.regexp_count(line, F.lit(r"(?U)\S+")) <= 8)
    seen = first.groupBy("document_type").agg(
        F.count(t).alias("texts"),
        F.bool_or(F.contains(head, F.lit("1.")) | F.contains(head, F.lit("1)"))).alias("numbered"),
        F.bool_or(F.exists(F.slice(F.split(t, "\n", -1), 1, 20), upper)).alias("headers"),
        F.bool_or(F.contains(t, F.lit("  ")) & F.contains(t, F.lit("|"))).alias("tables"),
        F.avg(F.regexp_count(t, F.lit(r"(?U)\S+"))).alias("words"),
    )
    size = F.lit(LENGTH_NOTES[-1][1])
    for bound, note in reversed(LENGTH_NOTES[:-1]):
        size = F.when(F.col("words") > bound, note).otherwise(size)
    types = F.create_map(*[F.lit(x) for kv in TYPE_NOTES.items() for x in kv])
    notes = F.array_compact(F.array(F.when(F.col("numbered"), NUMBERED), F.when(F.col("headers"), HEADERS), F.when(F.col("tables"), TABULAR), size, types[F.col("document_type")]))
    return seen.select("document_type", F.when(F.col("texts") > 0, notes).otherwise(F.array(F.lit(NO_TEXT))).alias("notes"))


def annotation_summary(labels: DataFrame, valid: DataFrame, distractors: DataFrame, key: str) -> DataFrame:
    """Labels by scope, distractors, and labels whose validation (label_idx, valid) passed or failed, of each key."""
    a = labels.join(valid, "label_idx", "left").groupBy(key).agg(
        F.count("*").alias("labels"), F.count_if(F.col("scope") == "intra_doc").alias("intra_doc"), F.count_if(F.col("scope") == "inter_doc").alias("inter_doc"), F.count_if("valid").alias("passed"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("failed")
    )
    return a.join(distractors.groupBy(key).agg(F.count("*").alias("distractors")), key, "full").fillna(0)
