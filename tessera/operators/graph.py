"""Graphs of documents, entities and claims: edges from shared facts and links, filters, neighbourhoods, components, communities."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import numbered, written
from tessera.operators.pairs import crossed, measured


def document_nodes(claims: DataFrame) -> DataFrame:
    """Claims of each document and its commonest category, the first seen of equals."""
    per = claims.groupBy("document", "category").agg(F.count("*").alias("n"), F.min("claim_id").alias("first"))
    return per.groupBy("document").agg(F.sum("n").alias("claims"), F.max_by("category", F.struct("n", -F.col("first"), "category")).alias("top_category"))


def co_members(rows: DataFrame, group: list[str], member: str) -> DataFrame:
    """(a, b, weight) with a < b: unordered pairs of members and the number of groups that they share. A large group is many tasks' work."""
    rows = measured(written(rows.select(*group, member).distinct()), group)
    a, b = rows.withColumnRenamed(member, "a"), rows.withColumnRenamed(member, "b")
    return crossed(a, b, group, "a", "n").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def first_of(*edges: DataFrame) -> DataFrame:
    """Edges of several kinds, each pair from the first kind that has it."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e.join(out.select("a", "b"), ["a", "b"], "left_anti"))
    return out


def document_edges(claims: DataFrame) -> DataFrame:
    """Documents that share a fact (subject and predicate), else a subject."""
    # Facts are read twice, as edges and as what is no longer an edge by subject.
    facts = written(co_members(claims, ["subject", "predicate"], "document").withColumn("kind", F.lit("shared_fact")))
    return first_of(facts, co_members(claims, ["subject"], "document").withColumn("kind", F.lit("shared_entity")))


def entity_nodes(claims: DataFrame, least: int = 3) -> DataFrame:
    """Subjects of ``least`` claims or more: claims, commonest category, number of documents, first five predicates."""
    per = claims.groupBy("subject", "category").agg(F.count("*").alias("n"), F.min("claim_id").alias("first"))
    top = per.groupBy("subject").agg(F.max_by("category", F.struct("n", -F.col("first"), "category")).alias("top_category"))
    out = claims.groupBy("subject").agg(F.count("*").alias("claims"), F.countDistinct("document").alias("documents"), F.array_join(F.slice(F.sort_array(F.collect_set("predicate")), 1, 5), ",").alias("predicates"))
    return out.where(F.col("claims") >= least).join(top, "subject")


def link_edges(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, link_id, relation): pairs of distinct members (claim_id, member) of a link; the first link of a pair wins."""
    rows = links.select("link_id", "relation", F.explode("claim_ids").alias("claim_id")).join(members, "claim_id").select("link_id", "relation", "member").distinct()
    rows = measured(rows, ["link_id"])
    pairs = crossed(rows.withColumnRenamed("member", "a"), rows.select("link_id", F.col("member").alias("b"), "n"), ["link_id"], "a", "n").where("a < b")
    return pairs.groupBy("a", "b").agg(F.min(F.struct("link_id", "relation")).alias("x")).select("a", "b", "x.*")


def claim_edges(links: DataFrame, claims: DataFrame) -> DataFrame:
    """(a, b, link_id, relation) between the claims (claim_id) of a link that are there; a claim that a link names twice has an edge to itself. The first link of a pair wins."""
    own = links.select("link_id", "relation", F.explode("claim_ids").alias("claim_id")).groupBy("link_id", "relation", "claim_id").agg(F.count("*").alias("n"))
    own = own.where("n > 1").join(claims.select("claim_id").distinct(), "claim_id", "left_semi")
    loops = own.groupBy(F.col("claim_id").alias("a")).agg(F.min(F.struct("link_id", "relation")).alias("x")).select("a", F.col("a").alias("b"), "x.*")
    return link_edges(links, claims.select("claim_id", F.col("claim_id").alias("member")).distinct()).unionByName(loops)


def unified_links(raw: DataFrame) -> DataFrame:
    """Links of several shapes (source_claim and target_claim, from_claim and to_claim, relationship or relation) as (a, b, relation); empty strings count as missing."""
    some = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns])
    return raw.select(some("source_claim", "from_claim").alias("a"), some("target_claim", "to_claim").alias("b"), F.coalesce(some("relationship", "relation"), F.lit("cross_reference")).alias("relation"))


def simple_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected edges between known nodes, without loops, once each: the first by ``ord``."""
    e = edges.where("a <> b").join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in edges.columns if c not in ("a", "b")])
    return e.withColumn("nth", F.row_number().over(Window.partitionBy("a", "b").orderBy("ord"))).where("nth = 1").drop("nth")


def ends(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends."""
    return edges.select("a", "b").union(edges.select("b", "a"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, size): the size is the root of the degree's share of the greatest; hubs have ten edges."""
    d = ends(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    most = d.agg(F.max("degree").alias("most"))
    # One row.
    return d.join(F.broadcast(most)).select("node", "degree", F.sqrt(F.col("degree") / F.col("most")).alias("size"), (F.col("degree") >= 10).alias("hub"))


def edge_width(weight: Column) -> Column:
    """How wide an edge is drawn: by the logarithm of its weight (1 if missing or 0), from 0.5 to 2."""
    w = F.coalesce(F.nullif(weight, F.lit(0)), F.lit(1))
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.lit(0.5) + F.log2(w + 1) * 0.5))


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges of the pairs (a, b), whichever end comes first in either; the pair's ends are kept as given."""
    key = lambda x, one, two: x.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")}).withColumnsRenamed({"a": one, "b": two})
    return key(pairs, "a", "b").join(key(edges, "_a", "_b"), ["_lo", "_hi"]).drop("_lo", "_hi", "_a", "_b")


def visible(nodes: DataFrame, edges: DataFrame, overlays: list[str] = (), focus: DataFrame | None = None, q: str = "", **kinds: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that ``filtered`` leaves of those in focus (node) that every overlay (a column with a count) touches, and one row of counts: nodes, edges, and nodes (label) that match a search."""
    for c in overlays:
        nodes = nodes.where(F.col(c) > 0)
    if focus is not None:
        nodes = nodes.join(focus.select("node").distinct(), "node", "left_semi")
    n, e = filtered(nodes, edges, **kinds)
    hit = matches(F.col("label"), F.col("node").cast("string"), q) if q.strip() else F.lit(False)
    counts = n.agg(F.count("*").alias("nodes"), F.count_if(F.coalesce(hit, F.lit(False))).alias("matches"))
    # Both sides are a single row.
    return n, e, counts.withColumn("_k", F.lit(1)).join(e.agg(F.count("*").alias("edges")).withColumn("_k", F.lit(1)), "_k").drop("_k")


def filtered(nodes: DataFrame, edges: DataFrame, include: list[str] = (), exclude: list[str] = (), edge_include: list[str] = (), edge_exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind) and edges (a, b, kind) that tri-state filters leave: with included kinds only those, never excluded ones; an edge needs both its ends."""
    keep = lambda kind, yes, no: (F.col(kind).isin(*yes) if yes else F.lit(True)) & (~F.col(kind).isin(*no) if no else F.lit(True))
    n = nodes.where(keep("kind", include, exclude))
    e = edges.where(keep("kind", edge_include, edge_exclude))
    e = e.join(n.select(F.col("node").alias("a")), "a", "left_semi").join(n.select(F.col("node").alias("b")), "b", "left_semi")
    return n, e


def matches(label: Column, identity: Column, q: str) -> Column:
    q = q.strip().lower()
    return F.contains(F.lower(label), F.lit(q)) | F.contains(F.lower(identity), F.lit(q))


def k_hops(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """(node, hops) of the nodes within ``k`` edges of the ``start`` nodes (node)."""
    both = written(ends(edges).distinct())
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    front = seen.select("node")
    for i in range(1, k + 1):
        front = both.join(front, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        front = written(front)
        seen = seen.union(front.withColumn("hops", F.lit(i)))
    return seen


def levels(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """(node, depth) of the nodes that can be reached from the node of most edges, the first of equals, and the deepest level. The frontier is a written table each round."""
    both = written(ends(edges).distinct())
    counted = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
    # Where there are no edges the first node is the root.
    first = nodes.agg(F.min("node").alias("node")).where("node is not null").withColumn("n", F.lit(0).cast("bigint"))
    root = counted.union(first).orderBy(F.desc("n"), "node").limit(1).select("node")
    seen, depth = written(root.withColumn("depth", F.lit(0))), 0
    front = seen.select("node")
    while True:
        depth += 1
        front = written(both.join(front, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.limit(1).count() == 0:
            return seen, depth - 1
        seen = seen.union(front.withColumn("depth", F.lit(depth)))


def depths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, depth) from the node of most edges; nodes out of reach lie one below the deepest."""
    seen, deepest = levels(edges, nodes)
    return nodes.select("node").join(seen, "node", "left").select("node", F.coalesce("depth", F.lit(deepest + 1)).alias("depth"))


def rings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, x, y): nodes in rings by depth, evenly round each in the order of their names; nodes out of reach have the outermost. Places come from numbers over all rings, so no ring is sorted in one task."""
    seen, deepest = levels(edges, nodes)
    at = nodes.select("node").join(seen, "node", "left").select("node", F.coalesce("depth", F.lit(deepest + 1)).alias("depth"), F.col("node").cast("string").alias("name"))
    at = written(numbered(at, "depth", "name"))
    ring = at.groupBy("depth").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    turn, radius = 2 * F.pi() * (F.col("i") - F.col("first")) / F.col("n"), F.col("depth") / (max(deepest, 1) + 0.5)
    return at.join(ring, "depth").select("node", (radius * F.cos(turn)).alias("x"), (radius * F.sin(turn)).alias("y"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each reaches. Labels pass to neighbours and through labels, so paths halve each round."""
    both = written(ends(edges).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("next"))
        new = written(step.join(jump, "c", "left").select("node", "was", F.least("c", F.coalesce("next", "c")).alias("component")))
        labels = new.select("node", "component")
        if new.where("was <> component").limit(1).count() == 0:
            return labels


def louvain(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Communities of greatest modularity found by local moves and merging, resolution 1, nodes in order: deterministic. A community is named by its least node."""
    member = {x: x for a, b, _ in edges for x in (a, b)}
    total = sum(w for *_, w in edges)
    graph: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        graph.setdefault(a, {})[b] = graph.setdefault(a, {}).get(b, 0) + w
        graph.setdefault(b, {})[a] = graph.setdefault(b, {}).get(a, 0) + w * (a != b)
    while True:
        weight = {x: sum(n.values()) + n.get(x, 0) for x, n in graph.items()}
        at, mass, moved = {x: x for x in graph}, dict(weight), False
        while True:
            again = False
            for x in sorted(graph):
                own, near = at[x], {}
                for y, w in graph[x].items():
                    if y != x:
                        near[at[y]] = near.get(at[y], 0) + w
                mass[own] -= weight[x]
                gain = {c: w - mass[c] * weight[x] / (2 * total) for c, w in near.items()}
                best = max(gain, key=lambda c: (gain[c], -c), default=own)
                to = best if gain and gain[best] > gain.get(own, -mass[own] * weight[x] / (2 * total)) + 1e-12 else own
                mass[to] += weight[x]
                if to != own:
                    at[x], again, moved = to, True, True
            if not again:
                break
        if not moved:
            least: dict[int, int] = {}
            for x, c in member.items():
                least[c] = min(x, least.get(c, x))
            return {x: least[c] for x, c in member.items()}
        member = {x: at[c] for x, c in member.items()}
        merged: dict[int, dict[int, float]] = {}
        for x, near in graph.items():
            for y, w in near.items():
                if x <= y:
                    a, b = at[x], at[y]
                    merged.setdefault(a, {})[b] = merged.setdefault(a, {}).get(b, 0) + w
                    if a != b:
                        merged.setdefault(b, {})[a] = merged.setdefault(b, {}).get(a, 0) + w
        graph = merged


def communities(edges: DataFrame) -> DataFrame:
    """(node, community): communities never cross components, so each component is solved by itself in a task; a component has to fit there."""
    placed = edges.join(components(edges), F.col("a") == F.col("node")).select("component", "a", "b", F.col("weight").cast("double"))

    def run(t: pa.Table) -> pa.Table:
        found = louvain(sorted(zip(*(t.column(c).to_pylist() for c in ("a", "b", "weight")), strict=True)))
        return pa.table({"node": pa.array(list(found), pa.int64()), "community": pa.array(list(found.values()), pa.int64())})

    return placed.groupBy("component").applyInArrow(run, "node bigint, community bigint")


def grid(nodes: DataFrame, gap: float = 40.0) -> DataFrame:
    """(node, x, y): nodes in order of id on a square grid."""
    n = nodes.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*")))).alias("columns"))
    at = numbered(nodes.select("node"), "node").join(F.broadcast(n))
    return at.select("node", (F.col("i") % F.col("columns") * gap).alias("x"), (F.floor(F.col("i") / F.col("columns")) * gap).alias("y"))


def circle(nodes: DataFrame, scale: float = 30.0) -> DataFrame:
    """(node, x, y): nodes in order of id on a circle that grows with the root of their number."""
    n = nodes.agg(F.count("*").alias("n"))
    at = numbered(nodes.select("node"), "node").join(F.broadcast(n))
    turn, radius = 2 * F.pi() * F.col("i") / F.col("n"), F.sqrt("n") * scale
    return at.select("node", (radius * F.cos(turn)).alias("x"), (radius * F.sin(turn)).alias("y"))


def note_bodies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, body): a note for each node (node, title) with links to its neighbours in order."""
    near = ends(edges).distinct().groupBy(F.col("a").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: F.concat(F.lit("- [["), x.cast("string"), F.lit("]]"))), "\n").alias("near"))
    text = F.concat(F.lit("---\nid: "), F.col("node").cast("string"), F.lit("\n---\n# "), "title", F.lit("\n\n"), F.coalesce("near", F.lit("")))
    return nodes.join(near, "node", "left").select(F.concat(F.lit("notes/"), F.col("node").cast("string"), F.lit(".md")).alias("path"), text.alias("body"))
