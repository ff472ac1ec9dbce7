"""Near-duplicate vectors: a robust-pruned flat graph on cluster shards, searched greedily within a range from every shard that can hold a link."""

from __future__ import annotations

import hashlib
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, sized, table, tuned, written
from tessera.llm.vectors import matrix, usable

COSINE = 0.9
#: Rows of a shard on the whole, and at most: a larger cluster is cut into shards that are searched pair by pair.
SHARD, MOST = 1_000, 2_048
#: Components of the sample that centroids are fitted on (rows times dimensions), and centroids at most.
SAMPLE, CENTROIDS = 2_000_000, 2_048
#: Shards that travel together.
GROUP = 8
#: Neighbours of a node; candidates for them; random ones among these; pruning slack.
DEGREE, NEAR, FAR, ALPHA = 24, 40, 6, 1.2
#: Rounds of the greedy search, nodes expanded in each, and how far below the range nodes are still expanded.
ROUNDS, BEAM, MARGIN = 6, 8, 0.05
#: Vectors whose links are held against brute force in a run.
AUDITED = 500


def units(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit rows; a centroid that loses all its rows stays where it was."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        at = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def pruned(x: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Each row's out-neighbours: of its nearest rows and some random ones, nearest first, those not much nearer to one already taken; random ones and links back are kept besides, so that far parts stay in reach."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -2)
    near = min(NEAR, n - 1)
    cand = np.argpartition(-s, near - 1, axis=1)[:, :near]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(s, cand, 1), axis=1, kind="stable"), 1)
    dist = 1 - np.take_along_axis(s, cand, 1)
    open_, taken, rows = np.ones(cand.shape, bool), np.zeros(cand.shape, bool), np.arange(n)
    for _ in range(DEGREE):
        pick = open_.argmax(1)
        has = open_[rows, pick]
        if not has.any():
            break
        taken[rows[has], pick[has]] = True
        open_[rows, pick] = False
        open_ &= ~(((ALPHA * (1 - s[cand[rows, pick][:, None], cand])) <= dist) & has[:, None])
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    src, at = np.nonzero(taken)
    a = np.concatenate([src, cand[src, at], np.repeat(rows, FAR)])
    b = np.concatenate([cand[src, at], src, far.ravel()])
    a, b = np.divmod(np.unique(a * n + b), n)
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def search(q: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the rows within the range that a search over the graph finds for each query: greedy from the ``start`` nodes, best unexpanded first, then from every node found within the range until no more come up. What is found is verified in double precision."""
    s = (q @ x.T).astype(np.float32)
    # The others have no row in range to be found.
    asked = np.flatnonzero(s.max(1, initial=-2) >= cosine - 1e-3)
    q, s = q[asked], s[asked]
    seen, done = np.zeros(s.shape, bool), np.zeros(s.shape, bool)
    seen[:, start] = True
    rows = np.arange(len(q))[:, None]
    for _ in range(ROUNDS):
        open_ = np.where(seen & ~done, s, -2)
        beam = min(BEAM, s.shape[1])
        pick = np.argpartition(-open_, beam - 1, axis=1)[:, :beam]
        fresh = np.take_along_axis(open_, pick, 1) > -2
        if not fresh.any():
            break
        done[rows, pick] |= fresh
        r, c = np.nonzero(fresh)
        seen[r[:, None], links[pick[r, c]]] = True
    while True:
        r, c = np.nonzero(seen & ~done & (s >= cosine - MARGIN))
        if not len(r):
            break
        done[r, c] = True
        for i in range(0, len(r), 1 << 16):
            seen[r[i : i + (1 << 16), None], links[c[i : i + (1 << 16)]]] = True
    r, c = np.nonzero(seen & (s >= cosine - 1e-3))
    good = np.concatenate([np.einsum("ij,ij->i", q[r[i : i + (1 << 18)]], x[c[i : i + (1 << 18)]]) >= cosine for i in range(0, len(r), 1 << 18)] or [np.zeros(0, bool)])
    return asked[r[good]], c[good]


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, embedding) of the vectors that can link; equal vectors have equal keys."""

    def run(batches):
        for batch in batches:
            m = matrix(batch.column(1)) + 0.0
            kept = m.any(axis=1) if m.size else np.zeros(len(m), bool)
            keys = [hashlib.md5(r.tobytes().rstrip(b"\0")).digest() for r in m]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], names=["vec_id", "key", "embedding"]).filter(pa.array(kept))

    usable_ = vectors.where(F.col("vec_id").isNotNull() & usable()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return usable_.mapInArrow(run, "vec_id long, key binary, embedding array<double>")


def sharded(reps: DataFrame, total: int) -> tuple[DataFrame, np.ndarray]:
    """(cluster, shard, block, vec_id, embedding), each vector in the cluster of its nearest centroid and ``block`` numbering the shards; and the centroids."""
    spark = reps.sparkSession
    first = reps.select("embedding").first()
    rows = max(1, SAMPLE // max(1, len(first[0]) if first else 1))
    sample = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("embedding").toArrow().column(0).combine_chunks()
    sample = units(matrix(sample)) if len(sample) else np.zeros((1, 1))
    c = centroids(sample, int(np.clip(round(total / SHARD), 1, CENTROIDS)))
    sent = spark.sparkContext.broadcast(c)

    def run(batches):
        for batch in batches:
            m, c = widened(matrix(batch.column(1)), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array((m @ c.T).argmax(1).astype(np.int32)), *batch.columns], names=["cluster", "vec_id", "embedding"])

    placed = written(reps.select("vec_id", "embedding").mapInArrow(run, "cluster int, vec_id long, embedding array<double>"))
    # At most CENTROIDS rows.
    shards = placed.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / MOST).alias("shards"))
    shards = shards.withColumn("first", F.sum("shards").over(Window.orderBy("cluster")) - F.col("shards"))
    shard = F.pmod(F.xxhash64("vec_id"), "shards")
    return placed.join(F.broadcast(shards), "cluster").select("cluster", shard.alias("shard"), (F.col("first") + shard).alias("block"), "vec_id", "embedding"), c


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with zeros at the end, as wide as the wider."""
    wide = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, wide - a.shape[1]))), np.pad(b, ((0, 0), (0, wide - b.shape[1])))


def gaps(x: np.ndarray, c: np.ndarray, home: int) -> np.ndarray:
    """Distance of each unit row, whose nearest centroid is ``home``, from the plane between that and each centroid. Rows of two clusters are apart by the sum of theirs at least."""
    x, c = widened(x, c)
    w = c[home] - c
    size = np.linalg.norm(w, axis=1)
    return np.where(size > 1e-9, np.maximum(x @ w.T, 0) / np.maximum(size, 1e-9), 0)


def packed(shards: DataFrame, c: np.ndarray, cosine: float = COSINE) -> DataFrame:
    """A row for each shard: ids, unit vectors, the graph's links padded with the node itself, and each cluster (``other``) from whose plane some row is no further (``gap``, the least) than vectors that link can be apart."""
    sent, apart = shards.sparkSession.sparkContext.broadcast(c), chord(cosine)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("vec_id").to_numpy(), kind="stable")))
        ids, x = t.column("vec_id").to_numpy(), units(matrix(t.column("embedding").combine_chunks()))
        lists = pruned(x)
        links = np.repeat(np.arange(len(ids))[:, None], max(1, *map(len, lists)) if len(lists) > 1 else 1, 1)
        for i, found in enumerate(lists):
            links[i, : len(found)] = found
        gap = gaps(x, sent.value, t.column("cluster")[0].as_py()).min(0)
        other = np.flatnonzero(gap <= apart)
        one = lambda a: pa.array([a.tobytes()], pa.binary())
        row = {k: t.column(k)[:1].combine_chunks() for k in ("cluster", "block")}
        return pa.table(row | {"n": pa.array([len(ids)], pa.int32()), "ids": one(ids), "data": one(x), "links": one(links.astype("<i4")), "other": pa.array([other.astype(np.int32)], pa.list_(pa.int32())), "gap": pa.array([gap[other]], pa.list_(pa.float64()))})

    return shards.groupBy("cluster", "shard").applyInArrow(run, "cluster int, block long, n int, ids binary, data binary, links binary, other array<int>, gap array<double>")


def chord(cosine: float) -> float:
    """How far apart unit vectors of that cosine are, with some room for rounding."""
    return float(np.sqrt(2 - 2 * cosine)) + 1e-6


def linked(reps: DataFrame, total: int, cosine: float = COSINE) -> DataFrame:
    """(u, v) with u < v: the links found. Every two shards meet whose gaps let a vector of one link with one of the other; shards travel in groups, so that each is sent once for each group that it meets."""
    shards, c = sharded(reps, total)
    blocks = written(packed(written(shards), c, cosine).withColumn("group", F.floor(F.col("block") / GROUP)))
    sent, apart = reps.sparkSession.sparkContext.broadcast(c), chord(cosine)
    near = written(blocks.select("block", "group", "cluster", F.explode(F.arrays_zip("other", "gap")).alias("o")).select("block", "group", "cluster", "o.other", "o.gap"))
    back = near.select(F.col("cluster").alias("other"), F.col("other").alias("cluster"), F.col("block").alias("rblock"), F.col("group").alias("h"), F.col("gap").alias("rgap"))
    tiles = written(near.join(back, ["cluster", "other"]).where(f"block <= rblock and gap + rgap <= {apart!r}").select(F.col("group").alias("g"), "h").distinct())
    sends = tiles.select(F.col("g").alias("group"), "g", "h").union(tiles.where("g <> h").select("h", "g", "h"))
    met = blocks.join(sends, "group").groupBy("g", "h").agg(F.collect_list(F.struct("group", "cluster", "block", "n", "ids", "data", "links", "other", "gap")).alias("blocks"))

    def opened(b: dict) -> dict:
        ids = np.frombuffer(b["ids"], "<i8")
        return b | {"ids": ids, "data": np.frombuffer(b["data"], "<f8").reshape(len(ids), -1), "links": np.frombuffer(b["links"], "<i4").reshape(len(ids), -1), "gaps": dict(zip(b["other"], b["gap"], strict=True))}

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = sorted(map(opened, r["blocks"]), key=lambda b: b["block"])
                for b in (b for b in found if b["group"] == r["h"]):
                    medoid = int((b["data"] @ b["data"].mean(0)).argmax())
                    start = np.unique(np.r_[medoid, np.linspace(0, b["n"] - 1, 16).astype(int)])
                    for a in (a for a in found if a["group"] == r["g"] and a["block"] <= b["block"]):
                        yield from between(a, b, start)

    def between(a: dict, b: dict, start: np.ndarray):
        room = apart - b["gaps"].get(a["cluster"], np.inf)
        if a["gaps"].get(b["cluster"], np.inf) > room:
            return
        mine = np.arange(a["n"])
        if a["cluster"] != b["cluster"]:
            mine = np.flatnonzero(gaps(a["data"], sent.value[[a["cluster"], b["cluster"]]], 0)[:, 1] <= room)
        q, x = widened(a["data"][mine], b["data"])
        i, j = search(q, x, b["links"], start, cosine)
        i, j = a["ids"][mine[i]], b["ids"][j]
        u, v = np.minimum(i, j), np.maximum(i, j)
        both = np.unique(np.stack([u, v], 1)[u < v], axis=0)
        for k in range(0, len(both), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(both[k : k + (1 << 18), 0]), pa.array(both[k : k + (1 << 18), 1])], names=["u", "v"])

    return met.select("g", "h", "blocks").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Vectors link where the graph search finds them and their cosine in double precision is ``cosine`` at least. Equal
    vectors take part once, by the least vec_id, and all link with one another and with what that one links with.
    Null and zero vectors and those with null or non-finite components link with nothing and are their own component;
    a null vec_id gives a null component and is kept; rows that repeat a vec_id are one vector and are all returned;
    an empty table gives no rows; other columns are ignored.
    """
    tuned(vectors.sparkSession)
    have = written(keyed(vectors))
    groups = written(have.groupBy("key").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n")).where("n > 1"))
    copies = written(have.select("vec_id", "key").join(sized(groups), "key").select("vec_id", "rep", "n").distinct())
    reps = written(have.join(sized(copies.where("vec_id <> rep").select("vec_id").distinct()), "vec_id", "left_anti").select("vec_id", "embedding").dropDuplicates(["vec_id"]))
    found = written(linked(reps, reps.count(), cosine))
    labels = components(found)
    weights = copies.select("rep", "n").distinct()
    both = found.union(found.select("v", "u"))
    degrees = both.join(sized(weights.withColumnRenamed("rep", "v")), "v", "left").groupBy(F.col("u").alias("rep")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("links"))
    about = degrees.join(weights, "rep", "full").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    about = written(about.select("rep", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = vectors.select("vec_id").join(sized(copies.select("vec_id", "rep")), "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id"))
    out = out.join(sized(about), "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audited_recall(vectors: DataFrame, found: DataFrame, every: int = 50, cosine: float = COSINE, seed: int = 0) -> float:
    """Share of the links of every ``every``-th vector by hash, by brute force over all rows, that their n_links in ``found`` count; for a bounded number of audited rows."""
    have = keyed(vectors).select("vec_id", "embedding").dropDuplicates(["vec_id"])
    asked = have.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(every)) == 0).limit(2_000).toArrow()
    if not len(asked):
        return 1.0
    q_ids, q = asked.column(0).to_numpy(), units(matrix(asked.column(1).combine_chunks()))

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), units(matrix(batch.column(1)))
            a, b = widened(q, x)
            hits = ((a @ b.T >= cosine) & (q_ids[:, None] != ids[None, :])).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(hits)], names=["vec_id", "true"])

    true = have.mapInArrow(run, "vec_id long, true long").groupBy("vec_id").agg(F.sum("true").alias("true"))
    a, b = true.join(found.select("vec_id", "n_links").distinct(), "vec_id").agg(F.sum(F.least("true", "n_links")), F.sum("true")).first()
    return 1.0 if not b else a / b


def audited(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, float]:
    """What ``near_duplicates`` finds, written, and its recall by ``audited_recall`` on about AUDITED vectors; a recall under 0.9 is logged as a warning."""
    found = written(near_duplicates(vectors, cosine))
    recall = audited_recall(vectors, found, max(1, found.count() // AUDITED), cosine)
    logging.getLogger(__name__).log(logging.INFO if recall >= 0.9 else logging.WARNING, "recall of links: %.4f", recall)
    return found, recall


def op5_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {"op5_graph_near_dedup": op5_graph_near_dedup}
ORACLES = {
    "op5_graph_near_dedup": f"""
    with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                         and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= {COSINE}),
    r as (select vec_id, vec_id as c from embeddings union select p.u, r.c from r join p on p.v = r.vec_id)
    select vec_id, (select count(*) from p where u = vec_id)::bigint as n_links, min(c) as component_id, min(c) = vec_id as kept from r group by vec_id"""
}
