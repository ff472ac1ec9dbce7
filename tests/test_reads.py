"""What is read several times is made once: last plans read tables of the shared folder, not texts or line items again."""

from __future__ import annotations

import os

import pytest

from tessera.operators import text
from tessera.plans import registry, tables

registry.load()
DIR = "/root/testdata/sf0.001"


def test_texts_do_not_travel_to_references(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, content string")
    labels = spark.createDataFrame([(7, [2, 1]), (8, [3])], "label_idx long, refs array<long>")
    found = text.first_modified(labels, texts, texts.replace({"b": "c"}, subset=["content"]))
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(7, 2, False), (8, None, True)}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["quality_gates", "gate_actions", "gates_failed"])
def test_gates_read_texts_once(spark, name):
    assert not [f for f in registry.QUERIES[name](spark, DIR).inputFiles() if "documents" in f]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["score_partial", "score_partial_by_scope", "seed_optional_by_scope"])
def test_scores_read_line_items_once(spark, name):
    assert not [f for f in registry.QUERIES[name](spark, DIR).inputFiles() if "lineitem" in f]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_target_pairs_look_for_terms_once(spark):
    df = registry.QUERIES["target_pairs"](spark, DIR)
    assert not [f for f in df.inputFiles() if "documents" in f]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_edges_are_made_once_to_be_looked_up(spark):
    assert not [f for f in registry.QUERIES["edge_lookup"](spark, DIR).inputFiles() if "lineitem" in f]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_notes_make_links_and_labels_once(spark):
    plan = registry.QUERIES["note_vault"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "datediff" not in plan and "because" not in plan


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["score_partial", "score_partial_by_scope"])
def test_scores_gather_suppliers_once(spark, monkeypatch, name):
    calls, real = [], tables.order_refs
    monkeypatch.setattr(tables, "order_refs", lambda *args: calls.append(1) or real(*args))
    registry.QUERIES[name](spark, DIR)
    assert len(calls) == 1


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_suppliers_of_an_order_are_gathered_after_the_shuffle(spark):
    plan = tables.order_refs(spark, DIR)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("partial_collect_list") < plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange hashpartitioning(l_orderkey")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_scores_of_scopes_do_not_repeat_detections(spark):
    """Detections meet the labels of all scopes at once, so both are shuffled by report alone."""
    plan = registry.QUERIES["score_partial_by_scope"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "refs_a" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "scope" in line and "refs" in line]
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") + plan.count("ShuffledHashJoin") == 2
