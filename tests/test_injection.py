"""Planned edits against a pass in order over plain strings."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import injection, reports

DOCS, PLAN = "doc_id string, content string", "doc_id string, place long, old string, new string, line long"


def in_order(docs, plan):
    """Texts, labels and where each edit's characters are in the end, each character followed by its owner."""
    texts = {d: [(c, None) for c in t or ""] for d, t in docs}
    labels = {}
    for doc, place, old, new, line in sorted(plan, key=lambda r: (r[0], r[1])):
        if doc not in texts:
            continue
        t = texts[doc]
        plain = "".join(c for c, _ in t)
        new = new or ""
        if line is not None:
            lines = plain.split("\n")
            at = min(sum(len(x) + 1 for x in lines[: max(0, min(line, len(lines) - 1)) + 1]), len(plain))
            size, new = 0, f" {new.strip()} "
        else:
            if old is None or old not in plain:
                continue
            at, size = plain.index(old), len(old)
        texts[doc] = t[:at] + [(c, place) for c in new] + t[at + size :]
        plain = "".join(c for c, _ in texts[doc])
        start = at if line is not None else plain.find(new)
        labels[doc, place] = (start, start + len(new), len(new))
    out = {}
    for (doc, place), (a, b, n) in labels.items():
        own = [i for i, (_, p) in enumerate(texts[doc]) if p == place]
        whole = n and len(own) == n and own == list(range(own[0], own[0] + n))
        out[doc, place] = (a, b, own[0] if whole else None, own[-1] + 1 if whole else None)
    return {d: "".join(c for c, _ in t) for d, t in texts.items()}, out


@pytest.mark.parametrize("seed", range(4))
def test_edits_are_those_of_a_pass_in_order(spark, seed):
    random.seed(seed)
    text = lambda n: "".join(random.choice("ab\né") for _ in range(n))
    docs = [(f"d{i}", None if i == 7 else text(random.choice((0, 1, 5, 60)))) for i in range(12)]
    plan = [(f"d{random.randrange(14)}", i, random.choice((text(1), text(2), "xy", None)), random.choice((text(1), "xy", "x  y", " y\n")), random.choice((None, None, None, 0, 2, 99, -1))) for i in range(250)]
    texts, labels = injection.injected(spark.createDataFrame(docs, DOCS), spark.createDataFrame(plan, PLAN))
    want_texts, want = in_order(docs, plan)
    assert {r.doc_id: r.content for r in texts.collect()} == want_texts
    got = {(r.doc_id, r.place): (r.char_start, r.char_end, r.last_start, r.last_end) for r in labels.collect()}
    assert got == want
    assert all(r.stale == ((r.char_start, r.char_end) != (r.last_start, r.last_end)) for r in labels.collect())


def test_later_edits_see_earlier_ones(spark):
    docs = spark.createDataFrame([("d", "one two one")], DOCS)
    plan = spark.createDataFrame([("d", 0, "one", "1", None), ("d", 1, "1 two", "x", None), ("d", 2, "one", "xx", None), ("d", 3, "gone", "y", None)], PLAN)
    texts, labels = injection.injected(docs, plan)
    assert texts.first().content == "x xx"
    got = sorted((r.place, r.char_start, r.char_end, r.last_start, r.stale) for r in labels.collect())
    # The third's own text is at 2, but "xx" is looked for from the text's start.
    assert got == [(0, 0, 1, None, True), (1, 0, 1, 0, False), (2, 2, 4, 2, False)]
    why = {r.place: r.reason for r in injection.failures(injection.applied(docs, plan.unionByName(spark.createDataFrame([("z", 9, "a", "b", None)], PLAN))), docs).collect()}
    assert why == {3: injection.NOT_FOUND, 9: injection.NO_DOCUMENT}


def test_empty_tables(spark):
    docs, plan = spark.createDataFrame([], DOCS), spark.createDataFrame([], PLAN)
    assert not injection.applied(docs, plan).count()
    texts, labels = injection.injected(spark.createDataFrame([("d", None)], DOCS), plan)
    assert (texts.first().content, labels.count()) == ("", 0)


def test_many_edits_of_one_document(spark):
    docs = spark.createDataFrame([("d", "ab" * 50)], DOCS)
    plan = spark.range(3000).select(F.lit("d").alias("doc_id"), F.col("id").alias("place"), F.lit("a").alias("old"), F.lit("ca").alias("new"), F.lit(None).cast("long").alias("line"))
    texts, labels = injection.injected(docs, plan)
    assert texts.first().content == "c" * 3000 + "ab" * 50
    assert labels.where("last_start is not null").count() == 1  # each edit takes the text of the one before


def test_facts_that_suit(spark):
    facts = spark.createDataFrame([(1, "numeric_drift", "numeric", "a"), (1, "numeric_drift", "entity", "b"), (2, "entity_swap", "causal", "c"), (2, "entity_swap", None, "d"), (3, "other", "causal", "e"), (4, "temporal_revision_conflict", "temporal", "f")], "k int, mechanism string, type string, fact string")
    got = reports.facts_for(facts, "k")
    assert sorted((r.k, r.fact) for r in got.collect()) == [(1, "a"), (2, "c"), (2, "d"), (3, "e"), (4, "f")]
    one = injection.chosen_fact(got, ["k"], "fact", 3)
    assert sorted(r.k for r in one.collect()) == [1, 2, 3, 4]
    assert sorted(one.collect()) == sorted(injection.chosen_fact(got.repartition(5), ["k"], "fact", 3).collect())


def test_answers(spark):
    rows = [
        (1, 0, "intra_doc", '{"original_text": "a", "modified_text": "b"}', None),
        (1, 1, "inter_doc", '```json\n{"modified_text": "c", "insertion_paragraph": 2}\n```', None),
        (1, 2, "inter_doc", '{"modified_text": "c"}', None),
        (2, 3, "intra_doc", '{"modified_text": "c"}', None),
        (2, 4, "intra_doc", "sorry", None),
        (2, 5, "intra_doc", None, "timeout"),
        (2, 6, "intra_doc", None, None),
    ]
    edits, lost = injection.planned(spark.createDataFrame(rows, "doc_id int, place long, scope string, answer string, error string"))
    assert sorted(map(tuple, edits.collect()), key=lambda r: r[1]) == [(1, 0, "a", "b", None), (1, 1, None, "c", 2), (1, 2, None, "c", 0)]
    assert {r.place: r.reason for r in lost.collect()} == {3: injection.NO_EDIT, 4: injection.NO_EDIT, 5: "timeout", 6: injection.NO_EDIT}
    asked = [("c", i, "intra_doc", "expert_opinion", ["d"], a, e) for i, (a, e) in enumerate((('{"description": "x", "divergence_type": "other"}', None), ("{}", None), (None, "busy")))]
    labels, lost = injection.distractors(spark.createDataFrame(asked, "case_id string, place int, scope string, divergence string, refs array<string>, answer string, error string"))
    assert labels.collect() == [("c", 0, "intra_doc", "expert_opinion", ["d"], "x")]
    assert {r.place: r.reason for r in lost.collect()} == {1: injection.NO_DESCRIPTION, 2: "busy"}
