"""Statistics over runs: means, intervals and tests by Student's t."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, out = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    """Chance of a t as far from 0 as this one; NaN for NaN, 0 for an infinite one."""
    if math.isnan(t) or df <= 0:
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The t below which a share ``p`` (over a half) lies, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    return df.map({d: t_quantile(0.975, d) if d > 0 else 0.0 for d in df.unique()})


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(x, d) for x, d in zip(t, df, strict=True)], dtype="float64")


def long_form(runs: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """(key, metric, value) of a run's columns."""
    return runs.select(*key, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def filled(rows: DataFrame, runs: DataFrame, run: str, part: str, metrics: list[str]) -> DataFrame:
    """Rows (run, part, metrics) with 0 for every part that a run lacks but another has."""
    parts = rows.select(part).distinct()
    # The parts are the few values of an enumeration.
    return runs.select(run).distinct().join(F.broadcast(parts)).join(rows, [run, part], "left").fillna(0.0, metrics)


def summary(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, mean, std, se) of ``value``, nulls left out; one value has a deviation of 0."""
    out = rows.groupBy(*key).agg(F.count("value").alias("n"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    return out.withColumn("se", F.when(F.col("n") > 0, F.col("std") / F.sqrt("n")).otherwise(0.0))


def with_intervals(found: DataFrame) -> DataFrame:
    """Adds the bounds of the 95 % interval of the mean; with one value or no deviation both are the mean."""
    half = F.when((F.col("n") < 2) | (F.col("se") == 0), 0.0).otherwise(t_quantile_975(F.col("n").cast("double") - 1) * F.col("se"))
    return found.withColumn("half", half).withColumn("ci_lower", F.col("mean") - F.col("half")).withColumn("ci_upper", F.col("mean") + F.col("half")).drop("half")


def compared(rows: DataFrame, key: list[str], mode: str, one, two) -> DataFrame:
    """(key, t, df) of the pooled-variance test between two modes; keys with fewer than two values on a side are left out."""
    side = lambda m, s: rows.where(F.col(mode) == m).groupBy(*key).agg(F.count("value").alias(f"n{s}"), F.avg("value").alias(f"m{s}"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias(f"v{s}"))
    both = side(one, 1).join(side(two, 2), key).where("n1 >= 2 and n2 >= 2").withColumn("df", (F.col("n1") + F.col("n2") - 2).cast("double"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.col("df")
    se = F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    gap = F.col("m1") - F.col("m2")
    t = F.when(se > 0, gap / se).when(gap == 0, float("nan")).otherwise(F.signum(gap) * float("inf"))
    return both.select(*key, t.alias("t"), "df")
