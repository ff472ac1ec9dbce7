"""What several operators share: written tables that cut lineage, text as bytes, hashes, components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a Python worker takes at once, in bytes.
STEP_BYTES = 1 << 20
#: Rows and bytes (by the planner's figure) up to which a side of a join may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Edges for each file of what component rounds write.
ROWS_A_FILE = 50_000
U64 = np.uint64
_own_dir: str | None = None


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds what one Arrow batch carries, for texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, as in tests, a temporary folder serves a local master; on a cluster other machines couldn't read it, so that fails."""
    global _own_dir
    top = spark.conf.get("spark.checkpoint.dir", None) or _own_dir
    if not top:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        top = _own_dir = tempfile.mkdtemp(prefix="tessera-")
    return f"{top.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: lineage ends there and a lost executor costs only its tasks. At most ``files`` tasks write it, if given: for tables that are known to be small."""
    path = shared_dir(df.sparkSession)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(run):
    """``run`` over Arrow batches; at its end the worker, which lives on for other stages, gives free memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is checked to have at most ``limit`` rows and BROADCAST_BYTES; else as it is, for a shuffled join. Give it slim, written rows, whose size the planner knows from their files."""
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES
    return F.broadcast(df) if small and df.limit(limit + 1).count() <= limit else df


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1]."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def byte_slices(texts: pa.Array, most: int = STEP_BYTES):
    """(first row, last row, bytes, offsets) for runs of rows of at most ``most`` bytes, or one longer text; null counts as empty."""
    a = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    buf = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): each node of an undirected edge table with the least node that it reaches.

    In each round every node points to its least neighbour, if that is less; pointer jumping takes all to the roots of
    these trees; and the edges are contracted to edges between roots, of which at most half remain. Rounds end when no
    edge is left. What a round leaves is a written table; only whether something is left comes to the driver.
    Self-loops are harmless; an edge with a null end is left out; no edges give no rows.
    """
    pairs = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where(F.col(u).isNotNull() & F.col(v).isNotNull())
    pairs, labels = written(pairs.distinct()), None
    files = -(-pairs.count() // ROWS_A_FILE) or 1
    while True:
        both = pairs.union(pairs.select("b", "a"))
        roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), files)
        while True:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = written(roots.join(above, "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), files)
            roots = jumped.select("node", "root")
            if not jumped.where("moved").limit(1).count():
                break
        above = roots.select(F.col("node").alias("component"), F.col("root").alias("next"))
        labels = roots.withColumnRenamed("root", "component") if labels is None else written(labels.join(above, "component", "left").select("node", F.coalesce("next", "component").alias("component")), files)
        ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
        inner = pairs.where("a <> b").join(ends[0], "a").join(ends[1], "b").where("a_root <> b_root")
        pairs = written(inner.select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct(), files)
        if not pairs.limit(1).count():
            return labels
