"""Exact top-k by inner product with no random access: sorted lists are read in step, bounds decide which rows can still qualify, and only these are read to the end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, tuned, written
from tessera.llm.vectors import matrix, unpacked, usable

K, SCALE, EVERY = 20, 64, 20
#: Queries that travel together and rows that one task has at most; a tile of rows is an eighth of a small table.
STRIPE, TILE, TILES = 8192, 16384, 12
#: Rows whose lists are read together, and queries that read them.
ROWS, QUERIES_AT_ONCE = 1024, 128
#: Entries of a list read in one step, and shares of the lists after which bounds are compared.
STEP, DEPTHS = 256, (0.7, 0.85)


def quantised(m: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * m)


class Lists:
    """A sorted list for each dimension of some rows, by falling value. A query reads a list from its top where its own component is positive and from its end where that is negative."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(-x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, 0)
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(len(x))[:, None], 0)

    def read(self, a: int, b: int, up: np.ndarray, down: np.ndarray, live: np.ndarray, shown: np.ndarray) -> None:
        """The entries a to b of every list from its top and from its end, added to what each live row has ``shown`` each query."""
        n, whole = len(self.order), live.all()
        for i in range(a, b, STEP):
            j = min(b, i + STEP)
            for d in range(self.order.shape[1]):
                for part, weight in ((slice(i, j), up[d]), (slice(n - j, n - i), down[d])):
                    row, value = self.order[part, d], self.values[part, d]
                    if not whole:
                        kept = live[row]
                        row, value = row[kept], value[kept]
                    shown[row] += value[:, None] * weight[None, :]

    def unread(self, depth: int, up: np.ndarray, down: np.ndarray, lowest: bool) -> np.ndarray:
        """What the entries below ``depth`` can add to each row's score at most: each is no better than the next one that its list will show. With ``lowest``, what they add at least: each is no worse than the last one of its list."""
        n = len(self.order)
        top, end = (n - 1, 0) if lowest else (min(depth, n - 1), max(n - 1 - depth, 0))
        kind = up.dtype
        return (self.place >= depth).astype(kind) @ (self.values[top][:, None] * up) + (self.place < n - depth).astype(kind) @ (self.values[end][:, None] * down)


class Best:
    """The best ``k`` rows so far of some queries: equal scores by smaller id, a query's own id left out."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k, self.bar = ids, k, np.full(len(ids), -np.inf)
        self.query, self.row, self.score = (np.zeros(0, np.int64),) * 3

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        query, row, score = np.append(self.query, query), np.append(self.row, row), np.append(self.score, score)
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.row, self.score = query[kept], row[kept], score[kept]
        last = np.searchsorted(self.query, np.arange(len(self.ids)), "right") - 1
        full = np.bincount(self.query, minlength=len(self.ids)) >= self.k
        self.bar = np.where(full, self.score[last] if len(self.score) else 0, -np.inf)


def aggregate(q: np.ndarray, best: Best, x: np.ndarray, x_ids: np.ndarray) -> None:
    """Adds the rows ``x`` that are among the best of the queries ``q`` to ``best``.

    All lists are read in step. After each of DEPTHS the entries seen bound the score of every row, seen or not, from
    above and below; a row is out for a query when its upper bound is under the bar, the k-th best score or lower
    bound known. Rows that are out for all queries are passed over from then on; what remains has been read to the end
    of the lists when its score is final. No entry is fetched by row.
    """
    n, k = len(x), best.k
    exact = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * max(1, x.shape[1]) * 2
    kind = np.float32 if exact < 2**24 else np.float64
    lists, up, down = Lists(x.astype(kind)), np.maximum(q, 0).T.astype(kind), np.minimum(q, 0).T.astype(kind)
    own = best.ids[None, :] == x_ids[:, None]
    shown, live, at = np.zeros((n, len(q)), kind), np.ones((n, len(q)), bool), 0
    live &= ~own
    bar = best.bar
    for depth in [*(int(n * d) for d in DEPTHS), n]:
        lists.read(at, depth, up, down, live.any(1), shown)
        at = depth
        if depth < n:
            if n > k and np.isinf(bar).any():
                low = np.where(live, shown + lists.unread(depth, up, down, True), -np.inf)
                bar = np.maximum(bar, np.partition(low, n - k, axis=0)[n - k])
            live &= shown + lists.unread(depth, up, down, False) >= bar[None, :]
    live &= shown >= bar[None, :]
    row, query = np.nonzero(live)
    best.add(query, x_ids[row], shown[row, query].astype(np.int64))


def packed(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """(part, n, dim, ids, data): the rows of (vec_id, embedding) dealt by hash into ``parts`` parts, each one row of quantised vectors."""

    def run(t: pa.Table) -> pa.Table:
        m = quantised(matrix(t.column("embedding").combine_chunks()), scale)
        ids = t.column("vec_id").to_numpy().astype("<i8")
        return pa.table({"part": t.column("part")[:1].combine_chunks(), "n": pa.array([len(ids)], pa.int32()), "dim": pa.array([m.shape[1]], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([m.astype("<f8").tobytes()], pa.binary())})

    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")
    return vectors.select(part, "vec_id", "embedding").groupBy("part").applyInArrow(run, "part long, n int, dim int, ids binary, data binary")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` the ``k`` rows of the greatest inner product of components floored after scaling, all rows being candidates.

    Rows are dealt into tiles and queries into stripes; every stripe meets every tile once, in a task that carries its
    queries' best rows from block to block of the tile, and what the tiles give is ranked. Vectors that are null or
    hold null or non-finite components and rows with a null vec_id take no part; shorter vectors count as ending in
    zeros; a vec_id that repeats counts once, with its least vector by component; ties go to the smaller vec_id; an
    empty table gives none; other columns are ignored.
    """
    tuned(vectors.sparkSession)
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    vectors = written(vectors)
    ask = vectors.where(F.col("vec_id") % every == 0)
    total, asked = vectors.count(), ask.count()
    tiles, stripes = max(1, -(-total // TILE), min(TILES, -(-total // ROWS))), max(1, -(-asked // STRIPE))
    have = packed(vectors, tiles, scale).withColumnRenamed("part", "tile")
    asks = packed(ask, stripes, scale).select(F.col("part").alias("stripe"), *[F.col(c).alias(f"q{c}") for c in ("n", "dim", "ids", "data")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"))
    pairs = have.join(asks, "tile").select("n", "dim", "ids", "data", "qn", "qdim", "qids", "qdata").repartition(min(tiles * stripes, 10_000))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = unpacked(r["qids"], r["qdata"], r["qn"], r["qdim"])
                x_ids, x = unpacked(r["ids"], r["data"], r["n"], r["dim"])
                wide = max(q.shape[1], x.shape[1])
                q, x = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, x))
                for i in range(0, len(q), QUERIES_AT_ONCE):
                    best = Best(q_ids[i : i + QUERIES_AT_ONCE], k)
                    for j in range(0, len(x), ROWS):
                        aggregate(q[i : i + QUERIES_AT_ONCE], best, x[j : j + ROWS], x_ids[j : j + ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.query]), pa.array(best.row), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_no_random_access_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_no_random_access_topk": op4_no_random_access_topk}
ORACLES = {
    "op4_no_random_access_topk": f"""
    with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as e from embeddings
               where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0)
    select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= {K}"""
}
