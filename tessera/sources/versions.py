"""Tables that commit: versions behind a marker that is written last, sources replaced partition by partition, and rows parted into sound and faulty ones with counts from the pass that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MARKER = "version string, base string, tables map<string, string>"


def markers(spark: SparkSession, path: str) -> DataFrame:
    """(version, base, tables) of the versions that were written whole, with the format of each table; none where there is nothing yet."""
    try:
        return spark.read.schema(MARKER).json(f"{path.rstrip('/')}/commits/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame([], MARKER)


def committed(tables: dict[str, DataFrame], path: str, version: str, base: str | None = None, formats: dict[str, str] | None = None) -> None:
    """Writes a version's tables, as Parquet unless ``formats`` say else, and then its marker. What fails on the way has no marker, so no reader sees it; the next attempt writes over it. A version that has its marker is never written again."""
    spark, top = next(iter(tables.values())).sparkSession, path.rstrip("/")
    if markers(spark, top).where(F.col("version") == version).limit(1).count():
        raise ValueError(f"version {version} already exists")
    kinds = {name: (formats or {}).get(name, "parquet") for name in tables}
    for name, df in tables.items():
        df.write.format(kinds[name]).mode("overwrite").save(f"{top}/version={version}/{name}")
    spark.createDataFrame([(version, base, kinds)], MARKER).coalesce(1).write.mode("error").json(f"{top}/commits/version-{version}")


def read_version(spark: SparkSession, path: str, version: str, name: str) -> DataFrame:
    """A table of a version; one that isn't committed, or has no such table, is an error."""
    found = markers(spark, path).where(F.col("version") == version).first()
    if found is None or name not in found.tables:
        raise LookupError(f"no table {name} in version {version}")
    return spark.read.format(found.tables[name]).load(f"{path.rstrip('/')}/version={version}/{name}")


def replaced(new: DataFrame, path: str, key: str = "source_id") -> None:
    """Puts ``new`` in place of its sources' rows in a table partitioned by source, in one dynamic overwrite: the other sources' files aren't read or touched, and none are if the job fails. A missing source is unknown."""
    rows = new.withColumn(key, F.coalesce(key, F.lit("unknown")))
    rows.repartition(key, F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(64))).write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def parted(rows: DataFrame, errors: Column, kinds: list[str], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(sound rows, faulty rows with their ``errors``, counts) by an array of the kinds of faults of a row, written once.

    Counts are metrics of the write itself: rows, sound, faulty, and rows with each kind of fault. Null errors are
    none; a row with several counts for each; kinds that are not named count as faulty only.
    """
    seen, none = Observation(), F.array().cast("array<string>")
    rows = rows.withColumn("errors", F.coalesce(errors, none))
    sound = F.size("errors") == 0
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(sound).alias("sound"), F.count_if(~sound).alias("faulty")]
    rows = rows.observe(seen, *counts, *[F.count_if(F.array_contains("errors", k)).alias(f"fault_{i}") for i, k in enumerate(kinds)])
    rows.withColumn("is_sound", sound).write.partitionBy("is_sound").parquet(path)
    got = seen.get
    back = rows.sparkSession.read.schema(rows.withColumn("is_sound", sound).schema).parquet(path)
    good, bad = (back.where(c).drop("is_sound") for c in ("is_sound", "not is_sound"))
    return good.drop("errors"), bad, {k: got[k] for k in ("rows", "sound", "faulty")} | {k: got[f"fault_{i}"] for i, k in enumerate(kinds)}
