"""Extraction with odd files and manifests; notes that are missing; the report as one object."""

import json

from tessera.operators import dockets


def test_extraction(spark):
    text = "word " * 120
    files = [("a", "001_T.pdf", text, None), ("a", "2_b.pdf", None, "broken"), ("a", "x_c.d.pdf", " ", None), ("a", "7.pdf", "short", None), ("a", "9_z", None, None), ("b", "001_q.pdf", text, None)]
    entries = [("a", 0, 1, "first", "g"), ("a", 1, 1, "again", "h"), ("a", 2, 2, None, None), ("c", 0, 1, "other", "g")]
    found = dockets.extracted(spark.createDataFrame(files, "case_id string, name string, content string, error string"), spark.createDataFrame(entries, "case_id string, pos int, item_number int, title string, group string"))
    got = {(r.case_id, r.name): (r.item_number, r.title, r.group, r.word_count, r.passed) for r in found.collect()}
    assert got == {
        ("a", "001_T.pdf"): (1, "again", "h", 120, True),
        ("a", "2_b.pdf"): (2, None, "", 0, False),
        ("a", "x_c.d.pdf"): (0, "x_c.d", "", 0, False),
        ("a", "7.pdf"): (0, "7", "", 1, False),
        ("a", "9_z"): (9, "9_z", "", 0, False),
        ("b", "001_q.pdf"): (1, "001_q", "", 120, True),
    }
    meta = {r.case_id: json.loads(r.meta) for r in dockets.extraction_meta(found).collect()}
    assert (meta["a"]["total_pdfs"], meta["a"]["clean_count"], meta["a"]["clean_rate"]) == (5, 1, 0.2)
    assert [d["item_number"] for d in meta["a"]["documents"]] == [1, 2, 0, 9, 0]
    assert dockets.extraction_meta(found.limit(0)).count() == 0


def test_notes_and_report(spark):
    names = spark.createDataFrame([(i, f"n{i}", ["A", "B"]) for i in (3, 1, 2, 4)], "ord int, name string, aliases array<string>")
    cross = spark.createDataFrame([(3.0667,)], "connectivity double")
    templates = spark.createDataFrame([("z", "tz"), ("a", "ta")], "document_type string, note string")
    notes = [r.note for r in dockets.recommendations(templates, names, cross).orderBy("ord").collect()]
    assert notes[:2] == ["ta", "tz"] and "'n1' appears as: A, B; 'n2' appears as: A, B; 'n3'" in notes[2] and "n4" not in notes[2] and "score of 3.07 " in notes[3]
    assert [r.note for r in dockets.recommendations(templates, names.limit(0), cross.selectExpr("0.0D as connectivity")).collect()] == ["ta", "tz"]
    assert dockets.recommendations(templates.limit(0), names.limit(0), cross.limit(0)).count() == 0
    made = json.loads(dockets.report({"types": templates, "none": templates.limit(0), "score": cross.withColumnRenamed("connectivity", "value")}).first().report)
    assert made == {"types": [{"document_type": "a", "note": "ta"}, {"document_type": "z", "note": "tz"}], "none": [], "score": 3.0667}
