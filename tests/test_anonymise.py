"""Phrases replaced one after another, the longest first, by brute force."""

import random
import re

import pytest

from tessera.operators import anonymise

PIECE = re.compile(r"\s*(?:\w+|[^\w\s])")


def brute(text, mapping):
    if text is None:
        return None, 0
    p = PIECE.findall(text)
    plain = [re.sub(r"^\s+", " ", x) for x in p]
    known = {}
    for original, new in sorted((o.strip(" "), n or "") for o, n in mapping if o):
        q = [re.sub(r"^\s+", " ", x) for x in PIECE.findall(original)]
        if q:
            known.setdefault("".join(q).lstrip(" "), (original, new, len(q)))
    taken, out = [None] * len(p), {}
    for phrase, (_original, new, m) in sorted(known.items(), key=lambda kv: (-len(kv[1][0]), kv[1][0])):
        for i in range(len(p) - m + 1):
            if "".join(plain[i : i + m]).lstrip(" ") == phrase and not any(taken[i : i + m]):
                taken[i : i + m] = [True] * m
                out[i] = (m, new)
    text_, i = "", 0
    while i < len(p):
        if i in out:
            text_ += re.match(r"\s*", p[i])[0] + out[i][1]
            i += out[i][0]
        else:
            text_ += p[i]
            i += 1
    return text_ + (re.search(r"\s*\Z", text)[0] if p else text), len(out)


@pytest.mark.parametrize("seed", range(3))
def test_longest_first(spark, seed):
    rng = random.Random(seed)
    parts = ["A", "Bo", "Bo-A", "(K)", "é", "x.", "A1"]
    text = lambda n: "".join(rng.choice(parts) + rng.choice(("", " ", "  ", "\n")) for _ in range(n))
    docs = [(i, text(rng.choice((0, 1, 8, 40)))) for i in range(40)] + [(90, None), (91, " \n"), (92, "A")]
    mapping = [(text(rng.choice((1, 1, 2, 3, 4))), rng.choice((f"[{i}]", "", None, "A Bo"))) for i in range(rng.choice((0, 1, 5, 12)))] + [("", "x"), (None, "y"), (" ", "z")]
    got = anonymise.anonymised(spark.createDataFrame(docs, "doc_id int, content string"), spark.createDataFrame(mapping, "original string, anonymized string"))
    assert "Python" not in got._jdf.queryExecution().toString()
    assert {r.doc_id: (r.content, r.replaced) for r in got.collect()} == {i: brute(t, mapping) for i, t in docs}


def test_names(spark):
    docs = spark.createDataFrame([(1, "John  Wayne Airport (KSNA), John\nWayne, Johnson; Wayne Airport.")], "doc_id int, content string")
    mapping = spark.createDataFrame([("John Wayne Airport (KSNA)", "Airport-A"), ("John Wayne", "PIC"), ("Wayne Airport", "Airport-B"), ("John", "J")], "original string, anonymized string")
    assert anonymise.anonymised(docs, mapping).first() == (1, "Airport-A, PIC, Johnson; Airport-B.", 3)


def test_nothing_to_do(spark):
    docs, mapping = spark.createDataFrame([(1, "a")], "doc_id int, content string"), spark.createDataFrame([], "original string, anonymized string")
    assert anonymise.anonymised(docs, mapping).collect() == [(1, "a", 0)] and not anonymise.anonymised(docs.limit(0), mapping).count()


def test_beginnings_of_any_number_are_looked_up(spark, monkeypatch):
    """Two pieces tell where a phrase may stand; the same rows whether the beginnings are sent out or shuffled."""
    docs = spark.createDataFrame([(1, "the  cat, the dog the cat\n sat. the"), (2, "the"), (3, None)], "doc_id int, content string")
    mapping = spark.createDataFrame([("the cat", "A"), ("the cat sat", "B"), ("the", "C"), (",", ";")], "original string, anonymized string")
    assert {(r.phrase, r.key) for r in anonymise.phrases(mapping).collect()} == {("the cat", "the cat"), ("the cat sat", "the cat"), ("the", "the"), (",", ",")}
    want = [(1, "A; C dog B. C", 5), (2, "C", 1), (3, None, 0)]
    assert sorted(map(tuple, anonymise.anonymised(docs, mapping).collect())) == want
    places = sorted(map(tuple, anonymise.occurrences(docs, mapping).collect()))
    monkeypatch.setattr(anonymise, "sized", lambda df: df)
    assert sorted(map(tuple, anonymise.anonymised(docs, mapping).collect())) == want
    assert sorted(map(tuple, anonymise.occurrences(docs, mapping).collect())) == places and len(places) == len(set(places))
