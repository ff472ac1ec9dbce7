"""Answers of a JSON API as a table that later calls' parameters prune, and the urls of such calls and of pages' links."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that stay as they are in a parameter.
SAFE = "=',() <>"


def call_url(base: str, params: dict[str, str], limit: int) -> str:
    """The url of a call for at most ``limit`` rows; names of parameters stay as they are."""
    return f"{base}?" + "&".join([*(f"{k}={quote(v, safe=SAFE)}" for k, v in params.items()), f"$limit={limit}"])


def parameters(url: Column) -> Column:
    """A map of a url's parameters, decoded; the last of those that repeat. What can't be decoded stays as it is; a url without any has an empty map."""
    asked = F.regexp_replace(F.when(F.contains(url, F.lit("?")), F.substring_index(url, "?", -1)).otherwise(""), "#.*", "")
    pairs = F.filter(F.split(asked, "&", -1), lambda p: p != "")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    cut = F.transform(pairs, lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    last = F.filter(cut, lambda x, i: ~F.exists(F.slice(cut, i + 2, F.size(cut)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def absolute(href: Column, page: Column) -> Column:
    """A link as a whole url: one that begins with a slash at the page's host, one without a scheme too, after a slash."""
    host = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(F.startswith(href, F.lit("/")), F.concat(host, href)).when(~F.startswith(href, F.lit("http")), F.concat(host, F.lit("/"), href)).otherwise(href)


def land(pages: DataFrame, path: str, fields: list[str], by: list[str], order: str) -> None:
    """Writes the rows of ``pages`` (body: a JSON array of flat objects) with ``fields`` as strings, in a folder for each value of ``by`` and in order of ``order``, so that reads skip what their conditions rule out. Bodies that aren't such arrays have no rows; rows that several pages have are one."""
    shape = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    rows = pages.where(F.startswith(F.ltrim("body"), F.lit("["))).select(F.inline(F.from_json("body", shape))).distinct()
    rows.repartitionByRange(*by, order).sortWithinPartitions(*by, order).write.partitionBy(*by).parquet(path)


def listed(spark: SparkSession, path: str, select: list[str], where: str | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
    """The call's ``$select``, ``$where``, ``$order`` and ``$limit`` over a landed table: columns and conditions go down to the files, folders that can't match aren't listed."""
    rows = spark.read.parquet(path)
    rows = rows.where(where) if where else rows
    if order:
        keys = [part.strip().partition(" ") for part in order.split(",")]
        rows = rows.orderBy(*[F.desc(name) if way.upper() == "DESC" else F.asc(name) for name, _, way in keys])
    return (rows.limit(limit) if limit is not None else rows).select(*select)
