"""Readers and writers of case folders: errors, empty folders, order of repeated ids, numbers of labels, files by name and scope."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources import corpus, datasets


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def doc(i, **more):
    return {"document_id": i, "source": "s", "document_type": "report", "source_case_id": "c", "scope_classification": "x", "content": f"text {i}"} | more


def test_a_case(spark, tmp_path):
    case = tmp_path / "case_1"
    lines(case / "anonymized_docs" / "b.jsonl", [doc("d1"), "", doc("d2")])
    lines(case / "anonymized_docs" / "a.jsonl", [doc("d1", content="older")])
    got = corpus.corpus(spark, str(case) + "/")
    assert {(r.document_id, r.content, r.case_id) for r in got.collect()} == {("d1", "text d1", "case_1"), ("d2", "text d2", "case_1"), ("d1", "older", "case_1")}
    assert {(r.document_id, r.content, r.file) for r in corpus.last_by_id(got).collect()} == {("d1", "text d1", "b.jsonl"), ("d2", "text d2", "b.jsonl")}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.corpus(spark, str(tmp_path / "none"))
    lines(case / "anonymized_docs" / "c.jsonl", ["{broken"])
    with pytest.raises(Exception, match="(?i)malformed"):
        corpus.corpus(spark, str(case)).collect()
    assert corpus.json_lines(spark, f"{case}/anonymized_docs/*.jsonl", corpus.DOCUMENT).count() == 3  # tolerant
    assert corpus.json_lines(spark, f"{case}/labels/*.jsonl", corpus.LABEL).count() == 0  # nothing there


def test_labels_are_numbered_in_order_of_files(spark, tmp_path):
    lines(tmp_path / "b.jsonl", [{"scope": "inter_doc", "rationale": "third"}])
    lines(tmp_path / "a.jsonl", [{"scope": "intra_doc", "rationale": "first"}, {"scope": "intra_doc", "rationale": "second"}])
    labels = corpus.json_lines(spark, f"{tmp_path}/*.jsonl", corpus.LABEL)
    assert {r.rationale: r.id for r in corpus.with_ids(labels).collect()} == {"first": "c_0", "second": "c_1", "third": "c_2"}
    own = corpus.with_ids(labels.withColumn("id", F.when(F.col("rationale") == "second", "mine")), "x")
    assert {r.rationale: r.id for r in own.collect()} == {"first": "x0", "second": "mine", "third": "x2"}


def test_documents_go_back_to_their_files(spark, tmp_path):
    rows = [("d1", "report", "a.jsonl"), ("d2", "report", "b.jsonl"), ("d3", "memo", None), ("d4", "memo", None)]
    path = str(tmp_path / "out")
    docs = spark.createDataFrame(rows, "document_id string, document_type string, file string")
    corpus.write_by_file(docs, path)
    read = lambda: {(r.document_id, r.file) for r in spark.read.json(path).collect()}
    assert read() == {("d1", "a.jsonl"), ("d2", "b.jsonl"), ("d3", "memo.jsonl"), ("d4", "memo.jsonl")}
    corpus.write_by_file(docs.limit(1), path)
    assert len(read()) == 1  # written over
    corpus.write_by_scope(spark.createDataFrame([("intra_doc", 1), ("inter_doc", 2), ("intra_doc", 3)], "scope string, n int"), path)
    assert {(r.scope, r.n) for r in spark.read.json(path).collect()} == {("intra_doc", 1), ("inter_doc", 2), ("intra_doc", 3)}
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"scope=intra_doc", "scope=inter_doc"}


def test_texts_and_claims(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    assert corpus.texts(spark, f"{tmp_path}/t/*.txt").collect() == [("a.txt", "one\ntwo")]
    (tmp_path / "g.json").write_text(json.dumps({"claims": [{"claim_id": "c1", "subject": "s", "confidence": 0.5}, {"claim_id": "c2"}], "other": 1}, indent=1))
    assert [(r.claim_id, r.subject, r.confidence) for r in corpus.claims(spark, f"{tmp_path}/g.json").collect()] == [("c1", "s", 0.5), ("c2", None, None)]


def test_links_of_older_shapes(spark):
    raw = spark.createDataFrame([("a", "b", None, None, "r", None), (None, "", "c", "d", "", "q"), ("e", "f", "g", "h", None, None)], "source_claim string, target_claim string, from_claim string, to_claim string, relationship string, relation string")
    assert [tuple(r) for r in graph.unified_links(raw).collect()] == [("a", "b", "r"), ("c", "d", "q"), ("e", "f", "cross_reference")]
    slim = raw.select("from_claim", "to_claim").where("from_claim = 'c'").withColumn("relation", F.lit("x"))
    assert graph.unified_links(slim).collect() == [("c", "d", "x")]


def test_json_over_many_lines(spark, tmp_path):
    """Whole files stay whole: a graph that is written with indents is one object."""
    lines(tmp_path / "case" / "metadata" / "knowledge_graph.json", [json.dumps({"claims": [{"claim_id": "c1"}, {"claim_id": "c2"}], "cross_references": [], "claim_clusters": []}, indent=2)])
    assert datasets.graphs(spark, str(tmp_path))["claims"].count() == 2
