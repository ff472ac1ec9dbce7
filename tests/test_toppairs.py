"""Best pairs by bounds against all pairs; sampled pairs against the permutation's promises."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, pairs, sampling, toppairs
from tessera.plans import registry

DOCS = "case_id string, doc_ord long, content string"


def corpus(spark, seed, n=60):
    random.seed(seed)
    words = [f"w{i}" for i in range(40)] + ["not", "no", "never", "however"]
    weights = [1 / (1 + i) for i in range(40)] + [0.05] * 4
    text = lambda: " ".join(random.choices(words, weights, k=random.choice((0, 1, 3, 10, 40))))
    rows = [(random.choice("aaab"), i, text()) for i in range(n)] + [("c", 1, "one two"), ("d", 1, None)]
    rows += [("a", 1000 + i, "copy of w1 w2 w3 not") for i in range(6)]
    return spark.createDataFrame(rows, DOCS).withColumn("content", F.coalesce("content", F.lit("")))


def found(df):
    return sorted((r.case_id, r.rank, r.doc_a, r.doc_b, r.score, r.confidence) for r in df.collect())


@pytest.mark.parametrize(("seed", "k", "seeds"), [(0, 1, 3), (1, 5, 4), (2, 40, 32)])
def test_keyword_pairs(spark, seed, k, seeds):
    docs = corpus(spark, seed)
    assert found(toppairs.keyword_topk(docs, k, seeds)) == found(pairs.best(pairs.keyword_pairs(docs), k))


@pytest.mark.parametrize(("seed", "k"), [(0, 1), (1, 7)])
def test_divergent_pairs(spark, seed, k):
    features = pairs.surface_features(corpus(spark, seed))
    assert found(toppairs.divergent_topk(features, k)) == found(pairs.best(pairs.divergent_pairs(features), k))


def test_few_pairs_are_looked_at(spark):
    rows = [("a", i, " ".join(f"t{(i * 7 + j) % 300}" for j in range(i % 20 + 1))) for i in range(400)] + [("a", 1000 + i, " ".join(f"t{j}" for j in range(60))) for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    looked = toppairs.keyword_candidates(docs, 5)[0].count()
    assert looked * 50 < pairs.keyword_pairs(docs).count()
    cells, _, some = toppairs.divergence_cells(pairs.surface_features(docs), 5)
    each = some.groupBy("case_id", toppairs.cell(toppairs.WIDTHS[-1]).alias("cell")).count()
    opened = cells.join(each.withColumnsRenamed({"cell": "a", "count": "x"}), ["case_id", "a"]).join(each.withColumnsRenamed({"cell": "b", "count": "y"}), ["case_id", "b"])
    assert opened.agg(F.sum(F.col("x") * F.col("y"))).first()[0] * 10 < 405 * 404 / 2


def test_copies_and_light_documents_are_not_met(spark):
    """Of equal documents only the first can be best; near copies past the heaviest documents set the bar."""
    random.seed(3)
    heavy = [" ".join(random.sample([f"w{j}" for j in range(4000)], 150)) for _ in range(40)]
    base = [f"c{j}" for j in range(120)]
    near = [" ".join(base[: 120 - i]) for i in range(6)]
    rows = list(enumerate(heavy + near + [" ".join(f"s{j}" for j in range(110))] * 300))
    random.shuffle(rows)
    docs = spark.createDataFrame([("a", i, x) for i, x in rows], DOCS)
    assert toppairs.keyword_candidates(docs, 10)[0].count() < 400
    assert found(toppairs.keyword_topk(docs, 10)) == found(pairs.best(pairs.keyword_pairs(docs), 10))
    some = spark.createDataFrame([("a", i, "x y z" if i % 3 else f"x y not q{i % 5}") for i in random.sample(range(400), 120)] + [("a", 900, "k")], DOCS)
    assert found(toppairs.keyword_topk(some, 12)) == found(pairs.best(pairs.keyword_pairs(some), 12))

def test_no_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    assert not toppairs.keyword_topk(docs, 3).count()
    assert not toppairs.divergent_topk(pairs.surface_features(docs), 3).count()
    assert not sampling.sampled_pairs(docs, 0.5, 1).count()


def test_sampled_pairs(spark):
    docs = spark.createDataFrame([(c, i, "") for c, n in (("a", 40), ("b", 2), ("c", 1), ("d", 3)) for i in range(0, 3 * n, 3)], DOCS)
    every = [(r.case_id, r.doc_a, r.doc_b) for r in sampling.sampled_pairs(docs, 1.0, 7).collect()]
    assert len(every) == len(set(every)) == 780 + 1 + 3  # each pair once
    assert all(a < b for _, a, b in every)
    some = {(r.case_id, r.doc_a, r.doc_b, r.confidence) for r in sampling.sampled_pairs(docs, 0.1, 7).collect()}
    assert len(some) == 78 + 1 + 1  # at least one
    assert some == {(r.case_id, r.doc_a, r.doc_b, r.confidence) for r in sampling.sampled_pairs(docs.repartition(7), 0.1, 7).collect()}
    assert all(0.1 <= c <= 0.9 for *_, c in some)
    other = {(r.case_id, r.doc_a, r.doc_b) for r in sampling.sampled_pairs(docs, 0.1, 8).collect()}
    assert other != {x[:3] for x in some}


def test_a_permutation_of_any_size(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 9, 10, 17, 100, 101, 997)], "n long").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("x"))
    out = sizes.select("n", sampling.permuted(F.col("x"), F.col("n"), F.lit("k")).alias("y")).groupBy("n").agg(F.sort_array(F.collect_list("y")).alias("y"))
    assert all(r.y == list(range(r.n)) for r in out.collect())


def test_hot_groups_are_many_tasks_work(spark, monkeypatch):
    """A group of a third of all rows: the same pairs, made in many parts of bounded size."""
    monkeypatch.setattr(pairs, "BLOCK", 16)
    rows = [("hot", i) for i in range(120)] + [(f"g{i % 80}", i) for i in range(240)] + [(None, 1), (None, 2), ("hot", 5)]
    df = spark.createDataFrame(rows, "k string, m long")
    want = {}
    groups = {}
    for k, m in set(rows):
        if k is not None:
            groups.setdefault(k, set()).add(m)
    for g in groups.values():
        for a in g:
            for b in g:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.weight for r in graph.co_members(df, ["k"], "m").collect()} == want
    one = pairs.measured(df.distinct(), ["k"])
    met = pairs.crossed(one.withColumnRenamed("m", "a"), one.withColumnRenamed("m", "b"), ["k"], "a", "n")
    assert met.where("k = 'hot'").count() == 120 * 120
    parts = one.where("k = 'hot'").select(F.pmod(F.xxhash64("m"), F.ceil(F.col("n") / pairs.BLOCK)).alias("p")).groupBy("p").count()
    assert parts.count() == 8 and parts.agg(F.max("count")).first()[0] <= 2.5 * pairs.BLOCK
    links = spark.createDataFrame([(1, "r", list(range(100))), (2, "q", [3, 2, 2])], "link_id int, relation string, claim_ids array<long>")
    members = spark.range(100).select(F.col("id").alias("claim_id"), F.col("id").alias("member"))
    edges = {(r.a, r.b): (r.link_id, r.relation) for r in graph.link_edges(links, members).collect()}
    assert edges == {(a, b): (1, "r") for a in range(100) for b in range(a + 1, 100)}
    left = spark.createDataFrame([(1, i, ["x", f"y{i % 3}"]) for i in range(60)], "k int, a int, refs array<string>")
    right = spark.createDataFrame([(1, i, ["x", "z"]) for i in range(50)], "k int, b int, refs array<string>")
    assert sorted((r.a, r.b, round(r.similarity, 6)) for r in pairs.set_pairs(left, right, ["k"]).collect()) == [(a, b, round(1 / 3, 6)) for a in range(60) for b in range(50)]


def test_sampled_pairs_are_permuted_once_by_many_tasks(spark, monkeypatch):
    """No filter for nulls makes the permutation again, and few small stretches don't end up in one task."""
    monkeypatch.setattr(sampling, "STRETCH", 16)
    docs = spark.range(200).select(F.lit("c").alias("case_id"), F.col("id").alias("doc_ord"))
    pairs = sampling.sampled_pairs(docs, 1.0, 7)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "md5(" in line for line in plan.splitlines())
    assert plan.count("md5(") <= 3 * sampling.ROUNDS
    assert pairs.rdd.getNumPartitions() > 10
    assert pairs.distinct().count() == 199 * 100


def test_tasks_of_sampled_pairs_do_not_grow_with_the_pairs(spark, monkeypatch):
    """However many places there are, tasks are bounded, a row that is dealt out stands for more; looked up by broadcast or shuffled, all pairs are there."""
    monkeypatch.setattr(sampling, "STRETCH", 16)
    monkeypatch.setattr(sampling, "STRETCHES", 4)
    monkeypatch.setattr(sampling, "TASKS", 8, raising=False)
    docs = spark.range(200).select(F.when(F.col("id") < 150, "c").otherwise("d").alias("case_id"), (F.col("id") * 3).alias("doc_ord"))
    pairs = sampling.sampled_pairs(docs, 1.0, 7)
    assert pairs.rdd.getNumPartitions() <= 8
    got = {(r.case_id, r.doc_a, r.doc_b) for r in pairs.collect()}
    assert got == {("c" if b < 450 else "d", a, b) for a in range(0, 600, 3) for b in range(a + 3, 600, 3) if (a < 450) == (b < 450)}
    monkeypatch.setattr(sampling, "LOOKED_UP", 0)
    assert {(r.case_id, r.doc_a, r.doc_b) for r in sampling.sampled_pairs(docs, 1.0, 7).collect()} == got


def test_pairs_are_drawn_from_few(spark, monkeypatch, tmp_path):
    """Of all pairs that share a term only those that can win reach the choice, which stays that of all pairs."""
    registry.load()
    random.seed(4)
    terms = ["Alpha Beta", "Gamma Delta", "NASA", "5 km", "Red Fox", "Big Dog"]
    rows = [(i, "a" if i % 5 else "b", " x ".join(random.choices(terms, k=random.randint(1, 4)) if i % 3 else ["Alpha Beta"])) for i in range(400)] + [(900, "c", "NASA"), (901, "d", "NASA"), (902, "d", "NASA")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.select(F.col("source").alias("case_id"), F.col("doc_id").alias("doc_ord"), F.col("text").alias("content"))
    every = pairs.key_term_pairs(docs)
    want = {tuple(r) for r in sampling.chosen_pairs(every, 4, 9).collect()}
    given, real = [], sampling.chosen_pairs
    monkeypatch.setattr(sampling, "chosen_pairs", lambda x, *more: given.append(x) or real(x, *more))
    assert {tuple(r) for r in registry.QUERIES["target_pairs"](spark, str(tmp_path)).collect()} == want
    assert len(want) == 12 and given[0].count() < every.count() / 4
    for name, value in {"MEET": 16, "SAMPLE": 2, "BEFORE": 1}.items():
        monkeypatch.setattr(sampling, name, value)
        assert {tuple(r) for r in registry.QUERIES["target_pairs"](spark, str(tmp_path)).collect()} == want
    alike = {tuple(r) for r in every.collect()}
    assert {tuple(r) for r in given[-1].collect()} <= alike


def test_lists_of_small_keys_are_met_whole(spark, monkeypatch):
    """Small keys are neither exploded nor shuffled beyond their key, wide ones go by member; repeats, nulls and empty lists count alike in both."""
    random.seed(5)
    refs = lambda: random.choice([None, [], [random.choice([1, 2, 3, None]) for _ in range(4)], random.choices(range(9), k=3)])
    rows = [(random.choice([None, 1, 1, 1, 2]), i, refs()) for i in range(60)]
    left = spark.createDataFrame([(*r, f"o{r[1]}") for r in rows[:30]], "k int, a int, refs array<long>, oa string")
    right = spark.createDataFrame(rows[30:], "k int, b int, refs array<long>")
    want = set()
    for k, a, x in rows[:30]:
        for l, b, y in rows[30:]:
            both = {v for v in set(x or []) & set(y or []) if v is not None}
            if k is not None and k == l and both:
                want.add((k, a, b, f"o{a}", round(len(both) / (len(set(x)) + len(set(y)) - len(both)), 6)))
    for narrow in (64, 30, 0):
        monkeypatch.setattr(pairs, "NARROW", narrow)
        got = pairs.set_pairs(left, right, ["k"], "oa")
        assert {(r.k, r.a, r.b, r.oa, round(r.similarity, 6)) for r in got.collect()} == want
        assert ("Generate" in got._jdf.queryExecution().optimizedPlan().toString()) == (narrow < 64)
