"""Folders of datasets, notes, calls that try again, loops over gates."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, graph, notes, profiles
from tessera.sources import datasets


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_discovery(spark, tmp_path):
    """A root's children with a case that has a graph; the root itself if its own folders have; nothing elsewhere."""
    put(tmp_path / "one" / "case" / "metadata" / "knowledge_graph.json", {"claims": []})
    put(tmp_path / "one" / "other" / "metadata" / "knowledge_graph.json", {"claims": []})
    put(tmp_path / "two" / "case" / "notes.txt", "x")
    found = datasets.discovered(spark, str(tmp_path)).collect()
    assert [(r.dataset, r.path.rsplit("/", 1)[-1]) for r in found] == [("one", "one")]
    own = datasets.discovered(spark, str(tmp_path / "one")).collect()
    assert [r.dataset for r in own] == ["one"] and own[0].path == found[0].path
    assert datasets.discovered(spark, str(tmp_path / "two")).count() == 0 and datasets.discovered(spark, str(tmp_path / "none")).count() == 0


def test_labels_and_graphs_of_cases(spark, tmp_path):
    """The gold file alone where there is one, else all but the file of all; ids by number through the dataset."""
    put(tmp_path / "a" / "contradictions" / "gold_labels.jsonl", '{"scope": "intra_doc"}\n\n{"id": "own", "scope": "inter_doc"}\n')
    put(tmp_path / "a" / "contradictions" / "intra.jsonl", '{"scope": "unused"}\n')
    put(tmp_path / "b" / "contradictions" / "x.jsonl", '{"scope": "one"}\n{"scope": "two"}\n')
    put(tmp_path / "b" / "contradictions" / "all_contradictions.jsonl", '{"scope": "unused"}\n')
    put(tmp_path / "b" / "metadata" / "knowledge_graph.json", {"claims": [{"claim_id": "k", "subject": "s"}], "cross_references": [{"from_claim": "k", "to_claim": "l"}]})
    got = datasets.contradictions(spark, str(tmp_path)).collect()
    assert sorted((r.case_id, r.id, r.scope) for r in got) == [("a", "c_0", "intra_doc"), ("a", "own", "inter_doc"), ("b", "c_2", "one"), ("b", "c_3", "two")]
    g = datasets.graphs(spark, str(tmp_path))
    assert [(r.case_id, r.claim_id) for r in g["claims"].collect()] == [("b", "k")]
    assert [r.to_claim for r in g["cross_references"].collect()] == ["l"] and g["claim_clusters"].count() == 0
    assert datasets.contradictions(spark, str(tmp_path / "none")).count() == 0


LABEL = {"scope": "intra_doc", "mechanism": "entity_swap", "detectability": "single_hop", "difficulty": "easy"}
DOCUMENT = {n: "x" for n in datasets.DOCUMENT.names}


def dataset(top, **changed):
    files = {
        "corpus/subcorpus_a.jsonl": json.dumps(DOCUMENT) + "\n" + json.dumps(DOCUMENT) + "\n",
        "gold/entity_graph.json": {"nodes": [{"id": "n"}, {"id": "m"}], "edges": [{"source": "n", "target": "m"}]},
        "gold/gold_incoherence_labels.json": [LABEL], "gold/gold_distractor_labels.json": [{"scope": "inter_doc"}, {"scope": "intra_doc"}],
        "metadata.json": {"benchmark_version": "1", "master_seed": 42},
    } | changed
    for name, value in files.items():
        if value is not None:
            put(top / name, value)


def test_validation(spark, tmp_path):
    dataset(tmp_path / "good")
    dataset(tmp_path / "bare", **{"metadata.json": None})
    dataset(tmp_path / "odd", **{"corpus/subcorpus_a.jsonl": json.dumps(DOCUMENT) + "\n\nnot json\n" + json.dumps({"document_id": "1"}) + "\n", "gold/gold_incoherence_labels.json": [LABEL, LABEL | {"scope": "?"}], "metadata.json": {"master_seed": 1}})
    dataset(tmp_path / "torn", **{"gold/gold_distractor_labels.json": "[{", "gold/entity_graph.json": None, "corpus/subcorpus_a.jsonl": None, "corpus/other.txt": "x"})
    dataset(tmp_path / ".hidden")
    got = {r.dataset: r for r in datasets.validated(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["bare", "good", "odd", "torn"]
    good = got["good"]
    assert good.valid and good.errors == [] and tuple(good)[3:] == (2, 2, 1, 1, 2)
    assert got["bare"].errors == ["missing metadata.json"] and tuple(got["bare"])[3:] == (0,) * 5 and not got["bare"].valid
    assert got["odd"].errors == ["subcorpus_a.jsonl line 3", "subcorpus_a.jsonl line 4", "labels 1", "metadata without benchmark_version"] and (got["odd"].documents, got["odd"].labels) == (1, 1)
    assert got["torn"].errors == ["no lines of documents", "missing gold/entity_graph.json", "gold/gold_distractor_labels.json is not JSON"]
    assert datasets.validated(spark, str(tmp_path / "none")).count() == 0


def test_legacy_layout(spark, tmp_path):
    dataset(tmp_path, **{"corpus/subcorpus_a.jsonl": '{"id": "d", "content": "t"}\n{"content": "no id"}\n'})
    got = datasets.legacy(spark, str(tmp_path))
    assert {k: v.count() for k, v in got.items()} == {"nodes": 2, "edges": 1, "labels": 1, "distractors": 2, "documents": 1}
    assert {k: v.count() for k, v in datasets.legacy(spark, str(tmp_path / "none")).items()} == dict.fromkeys(got, 0)


def test_package(spark, tmp_path):
    """Tables, parameters and a manifest under the version, which is written once; a backup stays as it was."""
    docs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "case_id string, doc string")
    labels = spark.createDataFrame([("intra_doc", "x", None), ("inter_doc", None, None)], "scope string, mechanism string, detectability string")
    tables = {"docs": docs, "labels": labels, "distractors": labels.limit(0)}
    datasets.write_package(tables, str(tmp_path), "v1", "v0", {"distractor_ratio": 0.5})
    m = spark.read.json(f"{tmp_path}/version=v1/dataset_manifest").first()
    assert (m.case_count, m.document_count, m.intra_doc, m.inter_doc, m.distractor_count, m.version, m.base_version) == (2, 3, 1, 1, 0, "v1", "v0")
    assert m.mechanism.asDict() == {"x": 0.5, "unknown": 0.5} and m.detectability.asDict() == {"unknown": 1.0}
    told = json.loads(spark.read.text(f"{tmp_path}/version=v1/generation_params").first()[0])
    assert told["distractor_ratio"] == 0.5 and told["version_id"] == "v1" and told["contradiction_rate_intra_doc"] == 0.0
    with pytest.raises(Exception, match="(?i)already exists"):
        datasets.write_package(tables, str(tmp_path), "v1")
    datasets.backed_up(docs, f"{tmp_path}/copy")
    datasets.backed_up(docs.limit(1), f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 3


def test_scalars_and_names(spark):
    rows = ["plain", "", "a: b", 'say "x"', "two\nlines", "Yes", " pad", "-dash", "back\\slash", "a/b c", "..x..", "???", None]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = df.select(notes.scalar(F.col("v")), notes.safe(F.col("v"))).collect()
    assert [r[0] for r in got] == ["plain", '""', '"a: b"', 'say "x"', '"two lines"', '"Yes"', '" pad"', '"-dash"', "back\\slash", "a/b c", "..x..", '"???"', None]
    assert [r[1] for r in got] == ["plain", "_", "a_b", "say_x", "two_lines", "Yes", "pad", "-dash", "back_slash", "a_b_c", "x", "_", None]


def test_document_note(spark):
    docs = spark.createDataFrame([("d 1", "body  \n")], "document string, content string")
    claims = spark.createDataFrame([("k2", "d 1"), ("k1", "d 1"), ("k3", "gone")], "claim_id string, document string")
    labels = spark.createDataFrame([("l", "contradiction", 1, ["d 1", "d 1"])], "label_id string, kind string, ord int, refs array<string>")
    got = {r.path: r.body for r in notes.document_notes(docs, claims, labels).collect()}
    assert got["documents/d_1.md"] == (
        "---\ntype: document\ndocument_id: d 1\nclaim_count: 2\ncontradiction_count: 2\ndistractor_count: 0\ntags:\n  - document\n  - contradiction-host\n---\n\n# d 1\n\n"
        "## Claims sourced from this document\n\n- [[k1]]\n- [[k2]]\n\n## Contradictions involving this document\n\n- [[l]]\n- [[l]]\n\n## Original content\n\nbody\n"
    )
    assert got["documents/gone.md"].endswith("# gone\n\n## Claims sourced from this document\n\n- [[k3]]\n") and len(got) == 2


def test_plain_notes_need_no_rules(spark):
    """Whole numbers are told by their type; the white space at an end is found whatever its length."""
    rows = [(7, "a\n" + " " * 40), (-7, "a b \n\n"), (None, " \n"), (0, "c" * 40)]
    df = spark.createDataFrame(rows, "v long, t string")
    got = df.select(notes.scalar(F.col("v")), notes.safe(F.col("v")), notes.trimmed(F.col("t")))
    assert [tuple(r) for r in got.collect()] == [("7", "7", "a"), ('"-7"', "-7", "a b"), (None, None, ""), ("0", "0", "c" * 40)]
    plan = df.select(notes.scalar(F.col("v")).alias("s"), notes.safe(F.col("v")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()


def test_notes_of_claims_and_links(spark):
    claims = spark.createDataFrame([(1, "a: b", "p", None, None, "d", 0.5)], "claim_id long, subject string, predicate string, object string, category string, document string, confidence double")
    rows = [(9, False, "r", "", [1, 1]), (8, True, "r", "t", [1, -1]), (7, None, "r", "", [1]), (None, False, "r", "", [1])]
    links = spark.createDataFrame(rows, "link_id long, cluster boolean, relation string, theme string, claim_ids array<long>")
    got = {r.path: r.body for r in notes.claim_notes(claims, links).collect()}
    assert list(got) == ["claims/1.md"] and 'subject: "a: b"\npredicate: p\nobject: ""\ncategory: unknown\nsource_document: d' in got["claims/1.md"]
    assert got["claims/1.md"].endswith("## Cross-references\n\n- [[9]] (r)\n- [[9]] (r)\n\n## Clusters\n\n- [[8]] — t\n")
    got = {r.path: r.body for r in notes.link_notes(links, claims).collect()}
    assert sorted(got) == ["clusters/8.md", "xrefs/9.md"] and got["clusters/8.md"].endswith("## Members\n\n- [[1]]\n- `-1` (claim not found)\n")


def test_calls_try_again():
    waits, left = [], [audit.Busy("slow"), None, ("text", 3, 4)]

    def ask(prompt):
        got = left.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    assert audit.Client(ask, 20, waits.append).metered("p") == ("text", None, 3, 4) and waits == [30, 2]
    waits.clear()
    left[:] = [audit.Busy("slow")] * 6
    assert audit.Client(ask, 5, waits.append)("p") == (None, "rate limit exceeded after 5 retries: slow") and waits == [30, 60, 120, 240, 300]
    left[:] = [ValueError("key")]
    assert audit.Client(ask, 5, waits.append)("p") == (None, "error of the model: key")
    left[:] = [(None, 1, 1)]
    assert audit.Client(ask, 5, waits.append).metered("p") == (None, "empty content", 0, 0)
    left[:] = [None]
    assert audit.Client(ask, 0, waits.append)("p") == (None, "no choices")


def test_a_failing_strategy_has_no_detections(spark):
    docs = spark.createDataFrame([("c", 1, "t")], "case_id string, doc_ord int, content string")

    def broken(docs, model):
        raise RuntimeError("no")

    def late(docs, model):
        return audit.none(docs).union(docs.selectExpr("case_id", "0L", "array('x')", "'e'", "cast(raise_error('late') as double)", "'s'"))

    assert audit.audit(docs, None, broken, late).count() == 0


def test_gate_loop(spark):
    """Stops at the first round whose gates all hold, or at the last round."""
    rounds = []

    def step(i):
        rounds.append(i)
        return {"n": spark.range(i)}

    gate = lambda t: t["n"].agg((F.count("*") >= 3).alias("passed"))
    tables, gates, i = audit.until_passed(step, gate, 5)
    assert (i, rounds, tables["n"].count(), gates.first().passed) == (3, [1, 2, 3], 3, True)
    assert audit.until_passed(step, gate, 2)[2] == 2
    with pytest.raises(ValueError):
        audit.until_passed(step, gate, 0)
    assert profiles.failed_gates(spark.createDataFrame([("G2", False), ("G1", True)], "gate string, passed boolean")).first().failed == ["G2"]


def test_rings_and_loops(spark):
    """Two nodes apart lie in the outermost ring; without edges the first node is the root."""
    import math

    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 10)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 10, 11)], "node bigint")
    got = {r.node: (round(r.x, 6), round(r.y, 6)) for r in graph.rings(edges, nodes).collect()}
    at = lambda r, i, n: (round(r * math.cos(2 * math.pi * i / n), 6), round(r * math.sin(2 * math.pi * i / n), 6))
    assert got == {1: (0, 0), 10: at(1 / 1.5, 0, 3), 2: at(1 / 1.5, 1, 3), 3: at(1 / 1.5, 2, 3), 11: at(2 / 1.5, 0, 1)}
    lone = {r.node: r.depth for r in graph.depths(edges.limit(0), nodes).collect()}
    assert lone == {1: 0, 2: 1, 3: 1, 10: 1, 11: 1} and graph.rings(edges.limit(0), nodes.limit(0)).count() == 0
    links = spark.createDataFrame([(1, "r", [5, 5, 6, 9]), (2, "q", [6, 5])], "link_id int, relation string, claim_ids array<int>")
    claims = spark.createDataFrame([(5,), (6,)], "claim_id int")
    assert sorted(map(tuple, graph.claim_edges(links, claims).collect())) == [(5, 5, 1, "r"), (5, 6, 1, "r")]
