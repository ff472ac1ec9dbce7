"""Edge cases of the operators: empty sides, ties, repeats, exact offsets, known statistics."""

import difflib
import itertools
import random

from pyspark.sql import functions as F

from tessera.operators import audit, classify, graph, matching, pairs, sampling, stats, text
from tessera.plans import edit_queries
from tessera.sources import corpus, html

DET = "report_id int, det_idx int, refs array<string>, description string, confidence double"
GOLD = "report_id int, label_idx int, refs array<string>, rationale string, scope string, detectability string"


def scores(df):
    return {r.report_id: (r.precision, r.recall, r.f1) for r in df.collect()}


def test_scores_of_empty_sides(spark):
    det = spark.createDataFrame([(1, 0, ["a", "b"], "x", 0.5), (2, 0, ["a"], "x", 0.5), (2, 1, ["a"], "x", 0.5)], DET)
    gold = spark.createDataFrame([(2, 0, ["a"], "r", "intra_doc", "single_hop"), (3, 0, ["a"], "r", "intra_doc", "single_hop")], GOLD)
    got = scores(matching.binary_scores(det, gold, ["report_id"]))
    assert got[1] == (1.0, 0.0, 0.0)  # detections without gold
    assert got[2] == (0.5, 1.0, round(2 / 3, 6))  # a repeated detection counts once
    assert got[3] == (0.0, 0.0, 0.0)


def test_partial_credit(spark):
    det = spark.createDataFrame([(1, 0, ["a", "b"], "x", 0.5), (1, 1, ["c", "x"], "y", 0.5), (1, 2, ["z", "w"], "z", 0.5)], DET)
    gold = spark.createDataFrame([(1, i, r, "r", "inter_doc", "multi_hop") for i, r in enumerate((["a", "b"], ["c", "d"], ["e", "f"]))], GOLD)
    r = matching.partial_scores(det, gold, ["report_id"]).first()
    assert (r.precision, r.recall, r.partial_credit) == (round(4 / 9, 6), round(4 / 9, 6), round(2 / 3, 6))


def greedy(pairs):
    used_a, used_b, out = set(), set(), set()
    for s, a, b in sorted(((-s, a, b) for a, b, s in pairs)):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), out.add((a, b))
    return out


def test_assignment_is_that_of_a_sequential_pass(spark):
    random.seed(4)
    pairs = [(a, b, random.choice((0.2, 0.5, 0.5, 1.0))) for a in range(9) for b in range(9) if random.random() < 0.6]
    df = spark.createDataFrame([(1, a, b, s, "", "") for a, b, s in pairs], "k int, a int, b int, similarity double, order_a string, order_b string")
    assert {(r.a, r.b) for r in matching.assigned(df, ["k"]).collect()} == greedy(pairs)


def lists_of_both_sides(spark):
    """Random sides with ties, and nulls in keys, lists, texts and scopes; a key on each side that the other lacks."""
    random.seed(11)
    refs = lambda: random.choice([None, [], [random.choice(["a", "b", None]) for _ in range(3)], random.choices("abcdefg", k=3)])
    key = lambda: random.choice([None, 1, 1, 2, 3])
    det = [(key(), i, refs(), random.choice([None, "x", "y"]), 0.5) for i in range(120)] + [(8, 0, ["a"], "x", 0.5)]
    gold = [(key(), i, refs(), random.choice("rs"), random.choice([None, "in", "out"]), "h") for i in range(90)] + [(9, 0, ["a"], "r", "in", "h")]
    return spark.createDataFrame(det, DET), spark.createDataFrame(gold, GOLD)


def test_few_lists_of_a_key_are_assigned_in_one_row(spark, monkeypatch):
    """No rounds for keys of few lists; what they take is what the rounds take."""
    det, gold = lists_of_both_sides(spark)
    found = {}
    for narrow in (0, 60, 1000):
        monkeypatch.setattr(pairs, "NARROW", narrow)
        if narrow == 1000:
            monkeypatch.setattr(matching, "assigned", None)
        found[narrow] = sorted(map(repr, matching.partial_matches(det, gold, ["report_id"]).collect()))
    assert len(found[0]) > 10 and found[0] == found[60] == found[1000]


def test_scores_of_scopes_apart_are_those_of_reports_of_their_own(spark, monkeypatch):
    det, gold = lists_of_both_sides(spark)
    scopes = gold.where("scope is not null")
    apart = lambda x: x.withColumn("report_id", F.concat_ws("|", "report_id", "scope"))
    own = apart(det.join(scopes.select("report_id", "scope").distinct(), "report_id"))
    want = sorted(map(tuple, matching.partial_scores(own.drop("scope"), apart(scopes.where("report_id is not null")).drop("scope"), ["report_id"]).collect()))
    for narrow in (0, 60, 1000):
        monkeypatch.setattr(pairs, "NARROW", narrow)
        got = matching.partial_scores(det, gold.where("report_id is not null"), ["report_id"], "scope")
        assert sorted(map(tuple, apart(got).drop("scope").collect())) == want


def test_merge_keeps_a_lone_side_as_it_is(spark):
    kind = "k int, ord int, refs array<string>, confidence double"
    one = spark.createDataFrame([(1, 0, ["a", "b"], 0.3), (1, 1, ["b", "a"], 0.2), (2, 0, ["a"], 0.1)], kind)
    two = spark.createDataFrame([(1, 0, ["b", "a"], 0.9), (1, 1, ["c"], 0.4), (1, 2, ["c"], 0.4), (3, 0, ["x"], 0.1), (3, 1, ["x"], 0.2)], kind)
    got = sorted((r.k, r.side, r.ord, r.confidence) for r in matching.merged(one, two, ["k"]).collect())
    assert got == [(1, 1, 1, 0.2), (1, 2, 0, 0.9), (1, 2, 1, 0.4), (2, 1, 0, 0.1), (3, 2, 0, 0.1), (3, 2, 1, 0.2)]


def test_chunks_join_to_the_text(spark):
    random.seed(2)
    texts = ["", " ", "a", "a b\n\nc d e f g\nh i  j k l m n o p\n\n", "x " * 30, "\n\n\n"] + [
        "".join(random.choice(("ab", " ", "  ", "\n", "\n\n", "c d e f")) for _ in range(random.randint(1, 60))) for _ in range(60)
    ]
    docs = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "case_id string, doc_ord int, content string")
    got = {}
    for r in text.chunks(docs, 5).orderBy("doc_ord", "chunk_index").collect():
        parts = got.setdefault(r.doc_ord, [])
        assert r.chunk_index == len(parts) and texts[r.doc_ord][r.char_start : r.char_end] == r.text
        parts.append(r.text)
    assert ["".join(got[i]) for i in range(len(texts))] == texts


def test_verification_reasons(spark):
    o = spark.createDataFrame([("a", "one two three"), ("b", "same"), ("c", "x y z")], "doc_id string, content string")
    m = spark.createDataFrame([("a", "one 2 three"), ("b", "same"), ("c", "1 y 2")], "doc_id string, content string")
    rows = [(0, ["a"], 4, 5), (1, ["b"], 0, 0), (2, ["c"], 0, 0), (3, ["q"], 0, 0), (4, [], 0, 0), (5, ["b", "a"], 9, 9)]
    labels = spark.createDataFrame(rows, "label_idx int, refs array<string>, char_start int, char_end int")
    got = {r.label_idx: (r.passed, r.reason, r.diff_start, r.discrepancy) for r in text.verified(labels, o, m).collect()}
    assert got[0] == (True, None, 4, False) and got[5] == (True, None, 4, True)
    assert [got[i][1] for i in (1, 2, 3, 4)] == ["no difference", "more than one difference", "missing document", "no references"]


def test_diff_opcodes_of_whole_texts(spark, tmp_path):
    body = "".join(f"line {i} of the 1st, 2nd & 3rd part\n" for i in range(40))
    texts = ["one\ntwo three\n" + body, body + "x two", "a b\nb", "\n\nb c d\ne", "word", "", None]
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in enumerate(texts):
        if t is not None:
            words = t.split(" ")
            edited = t.replace(words[1] if len(words) > 1 else "none", f"<{i}>", 1)
            ops = [o for o in difflib.SequenceMatcher(None, t, edited).get_opcodes() if o[0] != "equal"]
            want |= {(i, *o) for o in ops} or {(i, *[None] * 5)}
    got = edit_queries.diff_opcodes(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_matcher_finds_what_difflib_finds():
    """The same opcodes for texts of few and many signs, edited once, often or throughout; an edited long text is not searched sign by sign."""
    rng = random.Random(5)
    for n, signs in itertools.product((0, 1, 30, 199, 200, 900), ("ab", "abcdefgh ABC.", "etaoin shrdlu" * 9 + "CMFWYPVBGKQJXZ0123\U0001f600é")):
        for edits in (1, 4, n // 3):
            a = "".join(rng.choice(signs) for _ in range(n))
            b = a
            for _ in range(edits):
                at = rng.randrange(len(b) + 1)
                b = b[:at] + rng.choice(["<12>", "", "e", "Q7Q"]) + b[at + rng.randrange(6) :]
            assert text.Matcher(a, b).get_opcodes() == difflib.SequenceMatcher(None, a, b).get_opcodes()
    words = "".join(f"Line {i} tells of the {i % 7}th house\n" for i in range(600))
    m = text.Matcher(words, words.replace("tells", "<1>", 1))
    assert m.get_opcodes() == difflib.SequenceMatcher(None, m.a, m.b).get_opcodes() and not m.full


def test_t_distribution():
    assert abs(stats.t_two_sided(12.706, 1) - 0.05) < 1e-5
    assert abs(stats.t_two_sided(2.776, 4) - 0.05) < 2e-4
    assert abs(stats.t_quantile(0.975, 10) - 2.228) < 1e-3
    assert stats.t_two_sided(float("inf"), 3) == 0.0


def test_intervals_of_one_run(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("b", 0.3), ("c", None)], "k string, value double")
    got = {r.k: r for r in stats.with_intervals(stats.summary(df, ["k"])).collect()}
    assert (got["a"].std, got["a"].ci_lower, got["a"].ci_upper) == (0.0, 0.5, 0.5)
    assert got["b"].ci_lower < 0.2 < got["b"].ci_upper and got["c"].n == 0 and got["c"].mean == 0.0


def test_seed_is_the_hash_modulo(spark):
    assert spark.range(1).select(sampling.derived_seed(F.lit("42:injector:0"))).first()[0] == 2389129744


def test_components_and_communities(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (100, 102)]
    df = spark.createDataFrame(edges, "a long, b long").withColumn("weight", F.lit(1))
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert {got[i] for i in range(21)} == {0} and got[102] == 100
    clique = [(a, b, 1.0) for g in ((0, 1, 2, 3), (10, 11, 12, 13)) for a in g for b in g if a < b] + [(3, 10, 1.0)]
    found = graph.louvain(clique)
    assert {found[i] for i in (0, 1, 2, 3)} == {0} and {found[i] for i in (10, 11, 12, 13)} == {10}
    assert {r.community for r in graph.communities(df).where("node >= 100").collect()} == {100}


def test_depths_and_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (4, 5)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "node int")
    assert {r.node: r.depth for r in graph.depths(edges, nodes).collect()} == {2: 0, 1: 1, 3: 1, 4: 1, 5: 2, 9: 3}
    start = spark.createDataFrame([(1,)], "node int")
    assert {r.node: r.hops for r in graph.k_hops(edges, start, 2).collect()} == {1: 0, 2: 1, 3: 2, 4: 2}


def test_simple_edges(spark):
    edges = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (1, 2, 2), (1, 7, 3)], "a int, b int, ord int")
    nodes = spark.createDataFrame([(1,), (2,)], "node int")
    assert [tuple(r) for r in graph.simple_edges(edges, nodes).collect()] == [(1, 2, 1)]


def test_classifier_order(spark):
    rows = [("Interview transcript, FDR", ""), ("FDR factual report", ""), ("nothing", "12 Recorder group"), ("nothing", "")]
    df = spark.createDataFrame(rows, "t string, g string")
    assert [r[0] for r in df.select(classify.document_type(F.col("t"), F.col("g"))).collect()] == ["witness_testimony", "technical_analysis", "technical_analysis", "investigation_report"]


def test_largest_table():
    """The longest table counts; file type by link, pages where they are a number, rows without number, cells or link passed over."""
    cells = lambda *x: "<tr>" + "".join(f"<td> {c} </td>" for c in x) + "</tr>"
    page = "<table><tr><td>1</td></tr></table><table>" + cells("Item", "Title", "Pages", "", "Type", "Link")
    page += cells(1, "First <b> one </b>", "12", "", "PDF", '<a href="/get?id=1&amp;FileExtension=JPG&amp;x=1">View</a><a href="/no">x</a>') + cells("x", "t", "1", "", "", '<a href="/a">v</a>')
    page += cells(3, "Third", "n/a", "", "TXT", '<p><a href="/f.txt">v</a></p>') + cells(4, "no link", "1", "", "", "none") + cells(5, "few") + cells(6, "empty link", "1", "", "", "<a>v</a>") + "</table>"
    assert html.largest_table(page) == [(1, "Firstone", 12, "jpg", "/get?id=1&FileExtension=JPG&x=1"), (3, "Third", 0, "pdf", "/f.txt")]
    cells = lambda *x: "<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>"
    odd = "<table><tr><td>head</td></tr>" + cells("²", "t", "1", "", "", "<a href='/a'>x</a>") + cells("9" * 30, "t", "1", "", "", "<a href='/b'>x</a>") + cells("4", "t", "9999999999", "", "", "<a href='/c'>x</a>")
    odd += "<tr><td><table>" + cells("7", "in", "1", "", "", "<a href='/d'>x</a>") + "</table></td></tr>" + cells("5", "after", "٣", "", "", "<a href='/e'>x</a>") + "</table>"
    assert html.largest_table(odd) == [(4, "t", 0, "pdf", "/c"), (5, "after", 3, "pdf", "/e")]
    assert html.largest_table(None) == [] and html.largest_table("<table></table><p>") == []


def test_readers(spark, tmp_path):
    d = tmp_path / "case" / "anonymized_docs"
    d.mkdir(parents=True)
    (d / "a.jsonl").write_text('{"document_id": "1", "content": "x"}\n\nnot json\n{"document_id": "1", "content": "y"}\n')
    rows = corpus.json_lines(spark, str(d), corpus.DOCUMENT)
    assert rows.count() == 2 and corpus.last_by_id(rows).first().content == "y"
    assert corpus.json_lines(spark, str(tmp_path / "none"), corpus.DOCUMENT).count() == 0


def test_upsert_and_modules(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, n int")
    new = spark.createDataFrame([("b", 3)], "source_id string, n int")
    assert sorted(map(tuple, corpus.upserted(old, new).collect())) == [("a", 1), ("b", 3)]
    names = ["Transcript 27 January 2020.pdf", "Trancript 5 June 2020_0.pdf", "other.pdf", "Transcript 31 February 2020.pdf"]
    listing = spark.createDataFrame([(f"u{i}", n) for i, n in enumerate(names)], "url string, filename string")
    modules = spark.createDataFrame([(1, "2020-01-01", "2020-03-01")], "module int, a string, b string").select("module", F.to_date("a").alias("start"), F.to_date("b").alias("end"))
    assert {r.url: r.module for r in corpus.modules_of(listing, modules).collect()} == {"u0": 1, "u1": None}


def test_audit_with_a_scripted_model(spark):
    docs = spark.createDataFrame([("c", i, f"text {i}") for i in range(3)], "case_id string, doc_ord int, content string")

    def model(prompt):
        if prompt.startswith("List"):
            if "text 2" in prompt:
                raise ValueError("busy")
            return '[{"subject": "s", "predicate": "p", "object": "o", "confidence": 7}]', None
        return '```json\n[{"doc_a": "0", "doc_b": "1", "evidence": "e", "confidence": 0.7}, {"doc_a": "", "doc_b": ""}]\n```', None

    assert [r.claim_id for r in audit.claims(docs, model).orderBy("claim_id").collect()] == ["claim_0000", "claim_0001"]
    got = audit.audit(docs, model).collect()
    assert [(r.refs, r.confidence, r["mode"]) for r in got] == [(["0", "1"], 0.7, "hybrid")]
    assert audit.mode(audit.none, audit.by_reasoning) == "agentic" and audit.mode(audit.by_graph, audit.none) == "graph_native"
    assert audit.audit(docs, model, graph=audit.none).count() == 1


def test_numbers_follow_the_order(spark):
    from tessera.functions.lineage import numbered

    keys = random.Random(5).sample(range(10_000), 700)
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(7)
    assert [(r.k, r.i) for r in numbered(df, "k").orderBy("k").collect()] == list(zip(sorted(keys), range(700), strict=True))
    assert numbered(df.limit(0), "k").count() == 0


def test_hot_groups_meet_in_blocks(spark, monkeypatch):
    from tessera.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 3)
    a = spark.createDataFrame([(1, i, 10) for i in range(10)] + [(2, 50, 1)], "k int, x int, n bigint")
    got = pairs.crossed(a, a.withColumnRenamed("x", "y"), ["k"], "x", "n").collect()
    assert sorted((r.k, r.x, r.y) for r in got) == sorted([(1, i, j) for i in range(10) for j in range(10)] + [(2, 50, 50)])


def test_links_of_every_shape(spark):
    from tessera.operators import reports

    refs = spark.createDataFrame([(["a", "b"], "", None, "", "rel", "why"), ([], "s", "t", "", "", ""), (None, "", "x", "", None, None), (None, "s", "", "kind", "", "")], "claim_ids array<string>, source_claim string, target_claim string, relationship_type string, relationship string, description string")
    clusters = spark.createDataFrame([(["p", "q", "r"], "", "theme")], "claim_ids array<string>, relation string, theme string")
    got = [(r.claim_ids, r.relation, r.rationale) for r in reports.merged_links(refs, clusters).collect()]
    assert got == [(["a", "b"], "rel", "why"), (["s", "t"], "cross_reference", None), ([], "cross_reference", None), (["s"], "kind", None), (["p", "q", "r"], "cross_reference", "theme")]


def test_structural_notes(spark):
    from tessera.operators import reports

    rows = [("internal_memo", 0, None), ("internal_memo", 1, "MAIN HEADER\n1. x  | y"), ("internal_memo", 2, "word " * 4000), ("other", 0, ""), ("other", 1, None), ("late", 9, "plain")] + [("late", i, "") for i in range(5)]
    got = {r.document_type: r.notes for r in reports.structural_notes(spark.createDataFrame(rows, "document_type string, doc_ord int, content string")).collect()}
    assert got == {"internal_memo": [reports.NUMBERED, reports.HEADERS, reports.TABULAR, reports.LENGTH_NOTES[1][1], reports.TYPE_NOTES["internal_memo"]], "other": [reports.NO_TEXT], "late": [reports.NO_TEXT]}


def test_pairs_are_drawn_by_similarity(spark):
    pairs = spark.createDataFrame([(1, 1, 2, 0.9), (1, 1, 3, 0.1), (2, 1, 2, 0.0), (2, 3, 4, 0.0)], "case_id int, doc_a int, doc_b int, similarity double")
    got = sampling.chosen_pairs(pairs, 1000, 3).collect()
    share = lambda case, x: sum({r.source, r.target} == x for r in got if r.case_id == case) / 1000
    assert abs(share(1, {1, 2}) - 0.9) < 0.04 and abs(share(2, {1, 2}) - 0.5) < 0.06 and abs(sum(r.source < r.target for r in got) / 2000 - 0.5) < 0.05


def test_verification_of_context_and_schema(spark):
    old = spark.createDataFrame([(1, "abc" * 100), (2, "abc" * 100)], "doc_id int, content string")
    new = spark.createDataFrame([(1, "abc" * 100 + "!"), (2, "abc" * 100 + "?")], "doc_id int, content string")
    labels = spark.createDataFrame([(0, [1], 300, 301, []), (1, [2], 300, 301, ["difficulty"]), (2, [], 0, 0, []), (3, [9], 0, 0, [])], "label_idx int, refs array<int>, char_start int, char_end int, errors array<string>")
    got = {r.label_idx: (r.passed, r.reason) for r in text.verified(labels, old, new).collect()}
    assert got == {0: (True, None), 1: (False, "invalid label"), 2: (False, "no references"), 3: (False, "missing document")}
