"""Linked notes in Markdown of a dataset: a note for each document, claim, link, cluster and label, with back-links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import written

# What a plain scalar of a note's head may not hold, begin with or be.
SPECIAL = r"[:#\[\]{},&*?|<>=!%@`\n\t]"
LEADING = r"^[-?:\"'!%@`&*]"
RESERVED = ["true", "false", "null", "yes", "no", "~", "on", "off"]
#: Folder of each kind of label's notes and the mark on a document that hosts one.
LABEL_KINDS = ("contradiction", "distractor")
#: Names and scalars that need no look at the rules above: most are of these.
PLAIN_NAME = r"^[A-Za-z0-9\-](?:[A-Za-z0-9_.\-]*[A-Za-z0-9\-])?\z"
PLAIN_SCALAR = r"^(?!(?i:true|false|null|yes|no|on|off)\z)[A-Za-z0-9_](?:[A-Za-z0-9_.\- ]*[A-Za-z0-9_.\-])?\z"


def integral(v: Column) -> Column:
    """Whether a column's type is one of whole numbers, which the planner knows."""
    return F.typeof(v).isin("tinyint", "smallint", "int", "bigint")


def safe(name: Column) -> Column:
    """A name that files and links can bear: runs of other signs become one underscore; never empty."""
    given = name.cast("string")
    s = F.regexp_replace(F.regexp_replace(given, r"(?U)[^\w\-.]+", "_"), r"^[_.]+|[_.]+$", "")
    return F.when(integral(name) | given.rlike(PLAIN_NAME), given).when(s == "", "_").otherwise(s)


def linked(name: Column) -> Column:
    return F.concat(F.lit("[["), safe(name), F.lit("]]"))


def scalar(v: Column) -> Column:
    """A value of a note's head, quoted where it could be read as something else; null stays null."""
    s = v.cast("string")
    odd = s.rlike(SPECIAL) | s.rlike(LEADING) | F.lower(s).isin(*RESERVED) | s.rlike(r"(?U)^\s|\s$")
    escaped = F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))
    whole = F.when(F.startswith(s, F.lit("-")), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s)
    return F.when(integral(v), whole).when(s.rlike(PLAIN_SCALAR), s).when(s == "", '""').when(odd, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(s)


def trimmed(text: Column, tail: int = 16) -> Column:
    """A text without white space at its end, looked for in its last signs only, unless these are all white."""
    white = lambda t: F.regexp_replace(t, r"(?U)\s+$", "")
    end = white(F.right(text, F.lit(tail)))
    return F.when(end != "", F.concat(F.left(text, F.length(text) - tail), end)).otherwise(white(text))


def note(folder: str, name: Column, props: dict[str, Column], tags: list[Column], body: list[Column]) -> list[Column]:
    """(path, body) columns. Null properties, tags and lines are left out; an array is a run of lines; tags come once each."""
    head = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in props.items()]
    marks = F.transform(F.array_distinct(F.array_compact(F.array(*tags))), lambda t: F.concat(F.lit("  - "), t))
    text = F.concat_ws("\n", F.lit("---"), *head, F.lit("tags:"), marks, F.lit("---"), F.lit(""), *body)
    return [F.concat(F.lit(f"{folder}/"), safe(name), F.lit(".md")).alias("path"), F.concat(trimmed(text), F.lit("\n")).alias("body")]


def section(title: str, items: Column) -> Column:
    """Lines of a part of a note; without items there is no such part."""
    lines = F.concat(F.array(F.lit(f"## {title}"), F.lit("")), F.array_compact(items), F.array(F.lit("")))
    return F.when(F.size(items) > 0, lines)


def quoted(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.array(F.concat(F.lit("> "), text), F.lit("")))


def document_notes(docs: DataFrame, claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Notes of the documents (document, content) and of those that only claims name: their claims in order of id, the labels (label_id, kind, ord, refs) that refer to them in order of labels, a label that refers twice twice, and the text."""
    refs = labels.where(F.col("kind").isin(*LABEL_KINDS)).select("kind", "ord", "label_id", F.posexplode("refs").alias("pos", "document"))
    # Lines of all kinds are grouped at once.
    lines = claims.select("document", F.lit("claims").alias("kind"), "claim_id", F.concat(F.lit("- "), linked(F.col("claim_id"))).alias("line"))
    lines = lines.unionByName(refs.select("document", "kind", "ord", "pos", F.concat(F.lit("- "), linked(F.col("label_id"))).alias("line")), allowMissingColumns=True)
    order = ["kind", "claim_id", "ord", "pos"]
    grouped = lines.where("document is not null").groupBy("document").agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("lines"))
    of = lambda kind: F.transform(F.filter("lines", lambda x: x["kind"] == kind), lambda x: x["line"])
    x = docs.where("document is not null").select("document", "content", F.lit(True).alias("given")).join(grouped, "document", "full")
    none = F.array().cast("array<string>")
    x = x.withColumns({c: F.coalesce(of(c), none) for c in ("claims", *LABEL_KINDS)}).where("given or size(claims) > 0")
    title = F.col("document").cast("string")
    count = lambda c: F.size(c).cast("string")
    props = {"type": F.lit("document"), "document_id": scalar(title), "claim_count": count("claims")} | {f"{k}_count": count(k) for k in LABEL_KINDS}
    tags = [F.lit("document"), *[F.when(F.size(k) > 0, f"{k}-host") for k in LABEL_KINDS]]
    parts = [section("Claims sourced from this document", F.col("claims")), *[section(f"{k.capitalize()}s involving this document", F.col(k)) for k in LABEL_KINDS]]
    content = F.when(F.coalesce("content", F.lit("")) != "", F.array(F.lit("## Original content"), F.lit(""), F.col("content")))
    return x.select(*note("documents", title, props, tags, [F.concat(F.lit("# "), title), F.lit(""), *parts, content]))


def claim_notes(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Notes of claims (claim_id, subject, predicate, object, category, document, confidence) with the links (link_id, cluster, relation, theme, claim_ids) that they take part in; a link without an id has no line."""
    at = links.select("link_id", "cluster", "relation", "theme", F.posexplode("claim_ids").alias("pos", "claim_id"))
    named = F.coalesce(F.col("link_id").cast("string"), F.lit("")) != ""
    xref = F.when(named, F.concat(F.lit("- "), linked(F.col("link_id")), F.lit(" ("), "relation", F.lit(")")))
    group = F.when(named, F.concat(F.lit("- "), linked(F.col("link_id")), F.lit(" — "), F.coalesce(F.nullif("theme", F.lit("")), F.col("relation"))))
    found = at.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("link_id", "pos", "cluster", F.when(F.col("cluster"), group).otherwise(xref).alias("line")))).alias("found"))
    of = lambda keep: F.transform(F.filter("found", keep), lambda x: x["line"])
    x = claims.join(found, "claim_id", "left").withColumns({"xrefs": of(lambda x: ~x["cluster"]), "clusters": of(lambda x: x["cluster"])})
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # As of an empty text, but told by the column's own type.
    name, value = lambda c: F.coalesce(safe(F.col(c)), F.lit("_")), lambda c: F.coalesce(scalar(F.col(c)), F.lit('""'))
    category = F.coalesce(F.col("category").cast("string"), F.lit("unknown"))
    props = {"type": F.lit("claim"), "claim_id": scalar(F.col("claim_id"))} | {c: value(c) for c in ("subject", "predicate", "object")}
    props |= {"category": scalar(category), "source_document": value("document"), "confidence": F.col("confidence").cast("string")}
    tags = [F.lit("claim"), F.concat(F.lit("category/"), safe(category)), F.concat(F.lit("predicate/"), name("predicate")), F.concat(F.lit("doc/"), name("document"))]
    head = F.concat(F.lit("# "), text("claim_id"), F.lit(" — "), text("subject"), F.lit(" `"), text("predicate"), F.lit("` "), text("object"))
    body = [head, F.lit(""), F.concat(F.lit("Source: [["), name("document"), F.lit("]]")), F.lit(""), section("Cross-references", F.col("xrefs")), section("Clusters", F.col("clusters"))]
    return x.select(*note("claims", F.col("claim_id"), props, tags, body))


def link_notes(links: DataFrame, claims: DataFrame) -> DataFrame:
    """Notes of links and of clusters with their members in order, claims that are not there named as such; links without an id have none."""
    given = links.where("coalesce(cast(link_id as string), '') <> ''")
    at = given.select("link_id", "cluster", F.posexplode("claim_ids").alias("pos", "claim_id")).join(claims.select("claim_id", F.lit(True).alias("known")).distinct(), "claim_id", "left")
    line = F.when(F.col("known"), F.concat(F.lit("- "), linked(F.col("claim_id")))).otherwise(F.concat(F.lit("- `"), F.col("claim_id").cast("string"), F.lit("` (claim not found)")))
    members = at.groupBy("link_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]).alias("members"))
    x = given.join(members, ["link_id", "cluster"], "left").withColumn("members", F.coalesce("members", F.array().cast("array<string>")))
    theme, count = F.coalesce("theme", F.lit("")), F.size("members").cast("string")
    tail = [F.lit("## Members"), F.lit(""), F.col("members")]
    rel = F.concat(F.lit("rel/"), safe(F.col("relation")))
    lines = [F.concat(F.lit("# "), F.col("link_id").cast("string"), F.lit(" — "), "relation"), F.lit(""), quoted(F.col("theme"))]
    pairs = F.struct(*note("xrefs", F.col("link_id"), {"type": F.lit("xref"), "xref_id": scalar(F.col("link_id")), "relationship_type": scalar(F.col("relation")), "member_count": count}, [F.lit("xref"), rel], lines + tail))
    title = F.concat(F.lit("# "), F.col("link_id").cast("string"), F.lit(" — "), F.when(theme != "", theme).otherwise(F.col("relation")))
    about = F.when(theme != "", F.array(F.concat(F.lit("Relation: `"), "relation", F.lit("`")), F.lit("")))
    props = {"type": F.lit("cluster"), "cluster_id": scalar(F.col("link_id")), "relation": scalar(F.col("relation")), "theme": scalar(theme), "member_count": count}
    clusters = F.struct(*note("clusters", F.col("link_id"), props, [F.lit("cluster"), rel], [title, F.lit(""), about, *tail]))
    return x.where("cluster is not null").select(F.when(F.col("cluster"), clusters).otherwise(pairs).alias("x")).select("x.*")


def label_notes(labels: DataFrame) -> DataFrame:
    """Notes of labels (label_id, kind, scope, mechanism, detectability, rationale, original_text, modified_text, refs): empty fields are left out."""
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    out = None
    for kind in LABEL_KINDS:
        names = {"original_text": "Original", "modified_text": "Modified"} if kind == "contradiction" else {c: c for c in ("original_text", "modified_text")}
        texts = [F.when(some(c).isNotNull(), F.array(F.concat(F.lit(f"**{n}:** "), some(c)), F.lit(""))) for c, n in names.items()]
        if kind == "contradiction":
            texts = [F.lit("## Texts"), F.lit(""), *texts]
        tags = [F.lit(kind), *[F.when(some(c).isNotNull(), F.concat(F.lit(f"{c}/"), safe(some(c)))) for c in ("scope", "mechanism", "detectability")]]
        props = {"type": F.lit(kind), "label_id": scalar(F.col("label_id"))} | {c: scalar(some(c)) for c in ("scope", "mechanism", "detectability")}
        refs = F.transform("refs", lambda r: F.concat(F.lit("- "), linked(F.regexp_replace(r.cast("string"), r"\.txt$", ""))))
        body = [F.concat(F.lit("# "), F.col("label_id").cast("string")), F.lit(""), quoted(F.col("rationale")), *texts, section("Documents involved", refs)]
        rows = labels.where(F.col("kind") == kind).select(*note(f"{kind}s", F.col("label_id"), props, tags, body))
        out = rows if out is None else out.union(rows)
    return out


def vault(docs: DataFrame, claims: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, body) of every note of a dataset."""
    # Both are read several times.
    links, labels = written(links), written(labels)
    return document_notes(docs, claims, labels).union(claim_notes(claims, links)).union(link_notes(links, claims)).union(label_notes(labels))
