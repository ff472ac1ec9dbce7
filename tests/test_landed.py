"""Landed calls: what is pushed down and pruned; urls."""

import json

from pyspark.sql import functions as F

from tessera.sources import landed


def files_read(df):
    """Files that the scan opened, by its own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan") else plan
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numFiles").value(), plan.toString()


def test_conditions_reach_the_files(spark, tmp_path):
    rows = [{"no": str(i), "day": f"2020-{i % 12 + 1:02}-01", "status": ("open", "closed", "odd")[i % 3], "more": "x"} for i in range(600)]
    pages = [(json.dumps(rows[i : i + 50]),) for i in range(0, 600, 40)] + [("no json",), ("{}",), (None,), ("[]",)]
    path = str(tmp_path / "t")
    landed.land(spark.createDataFrame(pages, "body string"), path, ["no", "day", "status"], ["status"], "day")
    whole = landed.listed(spark, path, ["no"])
    assert whole.count() == 600  # pages overlap
    some = landed.listed(spark, path, ["no", "day"], "status = 'closed' and day < '2020-03-01'", "day desc, no", 7)
    want = sorted((r for r in rows if r["status"] == "closed" and r["day"] < "2020-03-01"), key=lambda r: r["no"])
    want.sort(key=lambda r: r["day"], reverse=True)
    assert [(r.no, r.day) for r in some.collect()] == [(r["no"], r["day"]) for r in want[:7]]
    read, plan = files_read(landed.listed(spark, path, ["no"], "status = 'closed' and day < '2020-03-01'"))
    assert 0 < read < files_read(whole)[0]
    assert "PartitionFilters: [isnotnull(status" in plan and "LessThan(day,2020-03-01)" in plan and "ReadSchema: struct<no:string,day:string>" in plan


def test_urls(spark):
    assert landed.call_url("https://x.org/r.json", {"$where": "a='b c' AND d<'1'", "$order": "d&e"}, 5) == "https://x.org/r.json?$where=a='b c' AND d<'1'&$order=d%26e&$limit=5"
    df = spark.createDataFrame([("https://h.org/p?a=1&b=x%20y+z&a=2&c&=v#f",), ("https://h.org/p",), ("https://h.org/p?",), ("https://h.org/?q=%zz",), (None,)], "u string")
    got = [r[0] for r in df.select(landed.parameters(F.col("u"))).collect()]
    assert got[:4] == [{"b": "x y z", "a": "2", "c": "", "": "v"}, {}, {}, {"q": "%zz"}]
    links = spark.createDataFrame([("/a.pdf", "https://h.org/x/y"), ("b.pdf", "https://h.org"), ("http://o.org/c", "https://h.org"), ("", "https://h.org/")], "href string, page string")
    assert [r[0] for r in links.select(landed.absolute(F.col("href"), F.col("page"))).collect()] == ["https://h.org/a.pdf", "https://h.org/b.pdf", "http://o.org/c", "https://h.org/"]
