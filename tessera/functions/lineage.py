"""Cuts of lineage for loops: tables written to the folder that a cluster shares; and numbers of rows by way of such a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a side of a join may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
_own_dir: str | None = None


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from Parquet under spark.checkpoint.dir. Where that is unset a temporary folder serves a local master; on a cluster other machines couldn't read it, so that fails."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """The name of a new folder that all machines share."""
    global _own_dir
    top = spark.conf.get("spark.checkpoint.dir", None) or _own_dir
    if not top:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        top = _own_dir = tempfile.mkdtemp(prefix="tessera-")
    return f"{top.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is counted at most ``rows`` rows and the planner knows it to have at most BROADCAST_BYTES; else as it is, for a shuffled join. Give it written rows."""
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES
    return F.broadcast(df) if small and df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``i``, the rows' numbers from 0 in an order. Rows are sorted by ranges and numbered within their range; only the ranges' sizes are added up in one place."""
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parted = written(parted.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    # A row for each partition.
    return parted.join(F.broadcast(sizes), "_part").withColumn("i", F.col("_base") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_base", "_first")
