"""Near-duplicate documents by BagMinHash signatures of their word-shingle multisets, bands and verified overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, byte_slices, components, lean, mix, sized, table, tuned, unit, written
from tessera.llm.shingles import WORDS, counted, overlaps, shingles

BANDS, ROWS = 24, 5
SIMILARITY = 0.8
#: Texts of a block in the exact comparison of what stars leave apart.
BLOCK = 256
#: Elements that a text and the texts of a block share, looked at at once.
MATCHES = 1 << 20
#: Points made at once.
POINTS = 1 << 19


def processes(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, seed, rate, limit) of each Poisson process.

    The weight axis is cut at 0, 1, 2, 4, 8...; each dyadic interval of an element has a process of its own, with the
    interval's width as rate. ``limit`` is the part of the interval below the weight; points above it do not count.
    """
    out, level = [], 0
    while True:
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        has = weight > low
        if not has.any():
            break
        with np.errstate(over="ignore"):
            seed = mix(element[has] + U64(level) * U64(0xD1B54A32D192ED03))
        out.append((doc[has], seed, np.full(has.sum(), width, np.int64), np.minimum(weight[has] - low, width)))
        level += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: for each text ``size`` least arrival times, equal in two texts with the chance of their weighted Jaccard similarity.

    Each point of a process has an arrival time, a component and a place in its interval; the bits of the place are
    the turns of a descent through the halves, quarters... of the interval, so all weights see the same points. A
    process ends when its time is past the text's largest minimum. Points come in blocks: one at first, then more for
    those that go on. Texts without elements have infinite times.
    """
    doc, seed, rate, limit = processes(doc, element, weight)
    least = np.full(texts * size, np.inf)
    time, live, done, block = np.zeros(len(doc)), np.arange(len(doc)), 0, 1
    while len(live):
        for i in range(0, len(live), max(1, POINTS // block)):
            p = live[i : i + max(1, POINTS // block)]
            with np.errstate(over="ignore"):
                a = mix(seed[p, None] + mix(np.arange(done + 1, done + block + 1, dtype=U64))[None, :])
                b = mix(a + U64(0x632BE59BD9B4E019))
            at = time[p, None] + np.cumsum(-np.log(unit(a)) / rate[p, None], axis=1)
            time[p] = at[:, -1]
            part = ((b & U64(0xFFFFFFFF)) * U64(size)) >> U64(32)
            counts = ((b >> U64(32)).astype(np.int64) & (rate[p, None] - 1)) < limit[p, None]
            np.minimum.at(least, ((doc[p, None] * size) + part.astype(np.int64))[counts], at[counts])
        live = live[time[live] < least.reshape(texts, size).max(1)[doc[live]]]
        done, block = done + block, min(2 * block, 64)
    return least.reshape(texts, size)


def banded(sign: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = sign.view(U64).reshape(len(sign), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(sign), bands)).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return key.view(np.int64)


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, key, bands): the text's digest and band keys; a text without words has no bands and a null key."""

    def run(batches):
        for batch in batches:
            keys = []
            for _, _, buf, off in byte_slices(batch.column(2)):
                n = len(off) - 1
                doc, h, c = counted(*shingles(buf, off, words))
                has = np.bincount(doc, minlength=n) > 0
                found = banded(signatures(doc, h, c, n, bands * rows), bands, rows)
                keys += [list(k) if x else None for k, x in zip(found, has, strict=True)]
            bands_ = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.if_else(bands_.is_valid(), batch.column(1), None), bands_], names=["doc_id", "key", "bands"])

    import pyarrow.compute  # noqa: F401

    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(lean(run), "doc_id long, key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of text keys whose shingle multisets overlap by ``similarity`` at least. The side b, which may be one text for many pairs, is joined last and its text not moved again."""

    def run(batches):
        for batch in batches:
            good = np.flatnonzero(overlaps(batch.column(2), batch.column(3), words) >= similarity - 1e-12)
            yield batch.select(["a", "b"]).take(pa.array(good))

    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(lean(run), "a binary, b binary")


def elements(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, es): each text's multiset as a sorted set of 64-bit elements, the k-th occurrence of a shingle being an element of its own."""

    def run(batches):
        for batch in batches:
            for i, j, buf, off in byte_slices(batch.column(1)):
                doc, h, c = counted(*shingles(buf, off, words))
                row = np.repeat(np.arange(len(doc)), c)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
                with np.errstate(over="ignore"):
                    e = mix(h[row] + nth.astype(U64) * U64(0x9E3779B97F4A7C15))
                parts = np.split(e, np.searchsorted(doc[row], np.arange(1, len(off) - 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([np.sort(x).tobytes() for x in parts], pa.binary())], names=["key", "es"])

    return texts.select("key", "text").mapInArrow(lean(run), "key binary, es binary")


def overlapping(asked: list[np.ndarray], have: list[np.ndarray], apart: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the sets that overlap by ``similarity`` where ``apart`` says that they are to be compared: shared elements counted through one sorted list of all elements."""
    size = np.array([len(x) for x in have])
    flat, owner = np.concatenate(have), np.repeat(np.arange(len(have)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    i_, j_ = [], []
    for i, x in enumerate(asked):
        near = apart[i] & (np.minimum(size, len(x)) >= similarity * np.maximum(size, len(x)) - 1e-9)
        if not near.any():
            continue
        shared = np.zeros(len(have), np.int64)
        for k in range(0, len(x), max(1, MATCHES // len(have))):
            low, high = (np.searchsorted(flat, x[k : k + max(1, MATCHES // len(have))], side) for side in ("left", "right"))
            many = high - low
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared += np.bincount(owner[at], minlength=len(have))
        hit = np.flatnonzero(near & (shared >= similarity * (size + len(x) - shared) - 1e-9) & (shared > 0))
        i_.append(np.full(len(hit), i))
        j_.append(hit)
    return (np.concatenate(i_), np.concatenate(j_)) if i_ else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def across(texts: DataFrame, placed: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(a, b): links between components of ``placed`` (key, component, pool, outside), where one side is outside.

    Texts that buckets connect, linked or not, are a pool. Pools are cut into blocks of at most ``BLOCK`` texts, small
    pools sharing one; the outside texts of a block meet each block of their pool as two rows, and all overlaps are
    counted there exactly. Rows come out only for links, one for a text and component.
    """
    total = placed.count()
    sizes = placed.groupBy("pool").agg(F.count("*").alias("size"))
    spread = F.pmod(F.xxhash64("pool"), F.lit(max(1, total // BLOCK)))
    cut = placed.join(sizes, "pool").withColumn("shelf", F.when(F.col("size") > BLOCK, F.xxhash64("pool")).otherwise(-1 - spread))
    cut = cut.withColumn("block", F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("key"), F.ceil(F.col("size") * 1.2 / BLOCK))).otherwise(F.lit(0)))
    rows = cut.join(elements(texts.join(placed.select("key"), "key"), words), "key")

    def shelved(t: pa.Table) -> pa.Table:
        # Rows of a block, in its first row's key and block; the lists travel inside.
        return pa.table({
            "shelf": t.column("shelf")[:1].combine_chunks(), "block": t.column("block")[:1].combine_chunks(),
            **{c: pa.array([t.column(c).to_pylist()], k) for c, k in (("keys", pa.list_(pa.binary())), ("pools", pa.list_(pa.binary())), ("components", pa.list_(pa.binary())), ("es", pa.list_(pa.binary())), ("outside", pa.list_(pa.bool_())))},
        })

    lists = "keys array<binary>, pools array<binary>, components array<binary>, es array<binary>, outside array<boolean>"
    named = rows.select("shelf", "block", F.col("key").alias("keys"), F.col("pool").alias("pools"), F.col("component").alias("components"), "es", "outside")
    blocks = written(named.groupBy("shelf", "block").applyInArrow(shelved, f"shelf long, block long, {lists}"))
    asks = blocks.where(F.exists("outside", lambda x: x)).select("shelf", *[F.col(c).alias(f"q_{c}") for c in ("keys", "pools", "components", "es", "outside")])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                out = [i for i, x in enumerate(r["q_outside"]) if x]
                code = {p: i for i, p in enumerate({*r["pools"], *r["q_pools"], *r["components"], *r["q_components"]})}
                pool, part = (np.array([code[x] for x in r[c]]) for c in ("pools", "components"))
                q_pool, q_part = (np.array([code[r[c][i]] for i in out]) for c in ("q_pools", "q_components"))
                apart = (q_pool[:, None] == pool[None, :]) & (q_part[:, None] != part[None, :])
                i, j = overlapping([np.frombuffer(r["q_es"][k], "<u8") for k in out], [np.frombuffer(x, "<u8") for x in r["es"]], apart, similarity)
                _, first = np.unique(np.stack([i, part[j]], 1), axis=0, return_index=True) if len(i) else (0, np.zeros(0, np.int64))
                pairs = [(r["q_keys"][out[i[k]]], r["keys"][j[k]]) for k in first]
                yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in pairs], pa.binary()), pa.array([min(x) for x in pairs], pa.binary())], names=["a", "b"])

    return blocks.drop("block", "outside").join(asks, "shelf").drop("shelf").mapInArrow(lean(run), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, class_id, kept): each document with the least doc_id of its class, and whether it is that one.

    Documents link where their multisets of ``words``-word shingles overlap (weighted Jaccard) by ``similarity`` at
    least; classes are the linked components. Texts of fewer words count as one shingle. Equal texts are one class
    from the start and take part once. In each bucket of a band, members are compared with the text that has most
    bucket-mates; those that this leaves in other components are compared exactly with all of their pool, block by
    block, so no link between texts that share a bucket is lost and no pairs of a group are rows. Null, empty and
    wordless texts link with nothing and are kept; a null doc_id gives a null class and is kept; rows repeated with
    their doc_id share its fate. No rows give none; other columns are ignored.
    """
    spark = tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sig = written(sign(docs, bands, rows, words))
    texts_once = written(sig.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("least"), F.count("*").alias("n")))
    buckets = texts_once.select("key", F.explode("least.bands").alias("band"))
    shared = written(buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    members = written(buckets.join(sized(shared), "band"))
    mates = written(members.groupBy("key").agg(F.sum("n").alias("mates")))
    wanted = written(mates.select("key").join(texts_once.select("key", F.col("least.doc_id").alias("doc_id")), "key"))
    texts = written(docs.withColumn("key", text_key()).join(sized(wanted), ["key", "doc_id"]).select("key", "text").dropDuplicates(["key"]))
    members = written(members.join(sized(mates), "key").select("band", "key", F.struct("mates", "key").alias("rank")))

    pivots = members.groupBy("band").agg(F.max("rank").alias("pivot"))
    starred = written(members.join(pivots, "band").select("band", "key", F.col("pivot.key").alias("pivot")))
    pairs = starred.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    pairs = pairs.withColumns({"x": F.greatest("a", "b"), "y": F.least("a", "b")}).dropDuplicates(["x", "y"]).select("a", "b")
    edges = written(verified(pairs, texts, similarity, words))
    labels = components(edges, "a", "b")

    # A pivot is a member of its bucket, so its component is found there.
    placed = starred.join(labels, starred["key"] == labels["node"], "left").select("band", "key", "pivot", F.coalesce("component", "key").alias("component"))
    head = placed.where("key = pivot").select("band", F.col("component").alias("head"))
    left = written(placed.join(head, "band").where("component <> head").select("band", "key"))
    if left.limit(1).count():
        near = written(starred.join(left.select("band").distinct(), "band").select("key", "pivot").distinct())
        pools = components(near, "key", "pivot").select(F.col("node").alias("key"), F.col("component").alias("pool"))
        flags = left.select("key").distinct().withColumn("outside", F.lit(True))
        placed = pools.join(flags, "key", "left").join(labels, F.col("key") == F.col("node"), "left")
        placed = written(placed.select("key", "pool", F.coalesce("component", "key").alias("component"), F.coalesce("outside", F.lit(False)).alias("outside")))
        found = written(across(texts, placed, similarity, words))
        if found.limit(1).count():
            labels = components(edges.union(found), "a", "b")
    reps = texts_once.select("key", F.col("least.doc_id").alias("rep"), "n").join(labels, F.col("key") == F.col("node"), "left").where("n > 1 or component is not null")
    reps = written(reps.select("key", "rep", F.coalesce("component", "key").alias("component")))
    classes = written(reps.join(reps.groupBy("component").agg(F.min("rep").alias("class_id")), "component").select("key", "class_id"))
    out = sig.select("doc_id", "key").join(sized(classes), "key", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
ORACLES: dict[str, str] = {}
