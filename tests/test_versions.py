"""Versions and sources that fail on the way; rows parted in one pass; ranges against a scan of all."""

import datetime
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.functions.lineage import folder
from tessera.operators import injection
from tessera.operators.ranges import LEVELS, bins, first_range
from tessera.sources import versions


def broken(df):
    return df.withColumn("n", F.when(F.col("n") > 0, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("n")))


def test_a_version_that_fails_on_the_way(spark, tmp_path):
    path, one, two = str(tmp_path), spark.createDataFrame([("a", 1)], "k string, n int"), spark.createDataFrame([("b", 2)], "k string, n int")
    assert not versions.markers(spark, path).count()
    versions.committed({"x": one, "y": one}, path, "v1")
    with pytest.raises(Exception, match="broken"):
        versions.committed({"x": two, "y": broken(two)}, path, "v2", "v1")
    assert [r.version for r in versions.markers(spark, path).collect()] == ["v1"]
    with pytest.raises(LookupError):
        versions.read_version(spark, path, "v2", "x")
    versions.committed({"x": two, "y": one}, path, "v2", "v1", {"y": "json"})
    assert versions.read_version(spark, path, "v2", "x").collect() == [("b", 2)] and versions.read_version(spark, path, "v1", "x").collect() == [("a", 1)]
    assert sorted(map(tuple, versions.read_version(spark, path, "v2", "y").select("k", "n").collect())) == [("a", 1)]
    assert {(r.version, r.base) for r in versions.markers(spark, path).collect()} == {("v1", None), ("v2", "v1")}
    with pytest.raises(ValueError, match="already exists"):
        versions.committed({"x": two}, path, "v1")
    with pytest.raises(LookupError):
        versions.read_version(spark, path, "v1", "z")


def test_replaced_sources(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "source_id string, n int, k string"
    read = lambda: sorted(map(tuple, spark.read.parquet(path).select("source_id", "n").collect()))
    versions.replaced(spark.createDataFrame([("a", -1, "x"), ("a", -2, "x"), ("b", -3, "x"), (None, -4, None)], kind), path)
    assert read() == [("a", -2), ("a", -1), ("b", -3), ("unknown", -4)]
    versions.replaced(spark.createDataFrame([("a", -9, "x"), ("c", -5, "x")], kind), path)
    assert read() == [("a", -9), ("b", -3), ("c", -5), ("unknown", -4)]
    with pytest.raises(Exception, match="broken"):
        versions.replaced(broken(spark.createDataFrame([("a", -7, "x"), ("b", 1, "x")], kind)), path)
    versions.replaced(spark.createDataFrame([], kind), path)
    assert read() == [("a", -9), ("b", -3), ("c", -5), ("unknown", -4)]


def test_parted_rows(spark):
    rows = spark.range(1000).withColumn("is_sound", F.lit("mine"))
    errors = F.when(F.col("id") % 10 == 3, None).otherwise(F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "even"), F.when(F.col("id") % 5 == 0, "five"), F.when(F.col("id") == 7, "other"))))
    good, bad, counts = versions.parted(rows.drop("is_sound"), errors, ["even", "five", "never"], folder(spark))
    want = {k: bad.where(F.array_contains("errors", k)).count() for k in ("even", "five", "never")}
    assert counts == {"rows": 1000, "sound": good.count(), "faulty": bad.count()} | want and want["five"] == 200
    assert good.columns == ["id"] and {r.id for r in good.collect()} == {i for i in range(1000) if i % 2 and i % 5 and i != 7}
    none = versions.parted(rows.drop("is_sound").limit(0), F.array(), ["x"], folder(spark))
    assert (none[0].count(), none[1].count(), none[2]) == (0, 0, {"rows": 0, "sound": 0, "faulty": 0, "x": 0})


def test_edits_are_counted_as_they_are_made(spark):
    docs = spark.createDataFrame([("d", "aaa")], "doc_id string, content string")
    plan = spark.range(9).select(F.lit("d").alias("doc_id"), F.col("id").alias("place"), F.lit("a").alias("old"), F.lit("b").alias("new"), F.lit(None).cast("long").alias("line"))
    seen = Observation()
    labels = injection.injected(docs, plan, seen)[1]
    assert seen.get == {"made": labels.count(), "failed": 6}


def test_bins_are_the_days_of_the_range(spark):
    random.seed(3)
    ends = [(a, a + random.choice((-5, -1, 0, 1, 2, 3, 7, 8, 100, 1023, 5000))) for a in (random.randrange(1 << 21) for _ in range(200))]
    got = spark.createDataFrame(ends, "a long, b long").select("a", "b", bins(F.col("a"), F.col("b")).alias("bins")).collect()
    for r in got:
        days = sorted(d for x in r.bins for d in range(x.bin << x.level, (x.bin + 1) << x.level))
        assert days == list(range(r.a, r.b + 1)) and len(r.bins) <= 2 * LEVELS


def test_first_range(spark):
    random.seed(5)
    day = lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(n)
    ranges = [(i, day(a), day(a + random.choice((-1, 0, 3, 40, 900)))) for i, a in ((i, random.randrange(-400, 1000)) for i in range(80))]
    ranges += [(100, None, day(5)), (101, day(5), None), (102, datetime.date(1, 1, 1), datetime.date(9999, 12, 31)), (103, datetime.date(1, 1, 1), datetime.date(1969, 1, 1))]
    points = [(i, random.choice((None, day(random.randrange(-500, 2200)), day(7)))) for i in range(300)] + [(900, datetime.date(1960, 1, 1)), (901, datetime.date(9999, 12, 31))]
    df = spark.createDataFrame(points, "k int, d date")
    got = {r.k: r.rank for r in first_range(df, spark.createDataFrame(ranges, "rank int, start date, end date"), "d", "rank").collect()}
    assert got == {k: min((i for i, a, b in ranges if d and a and b and a <= d <= b), default=None) for k, d in points}
    assert first_range(df, spark.createDataFrame([], "rank int, start date, end date"), "d", "rank").where("rank is null").count() == len(points)


def test_a_million_ranges_without_a_broadcast(spark):
    """No side is broadcast over its limit, and a day's ranges are least ones of bins before they meet it."""
    ranges = spark.range(1_000_000).select(F.col("id").alias("rank"), F.expr("date_add(date'2000-01-01', cast(id % 3000 as int))").alias("start"), F.expr("date_add(date'2000-01-01', cast(id % 3000 + id % 400 as int))").alias("end"))
    points = spark.range(2000).select(F.expr("date_add(date'2000-01-01', cast(id as int))").alias("d"))
    got = first_range(points, ranges, "d", "rank")
    assert got.where("rank is null").count() == 0
    want = points.join(ranges.where("rank < 4000"), F.col("d").between(F.col("start"), F.col("end"))).groupBy("d").agg(F.min("rank").alias("rank"))
    assert got.join(want, ["d", "rank"]).count() == 2000
