"""Verbatim matches with test texts against brute force over words."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as d
from tessera.llm.common import byte_slices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def brute(docs, items):
    windows = {}
    for k, t in enumerate(items):
        w = words(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(k)
    out = []
    for t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if who := windows.get(tuple(w[i : i + n])):
                    found |= who
                    hit.update(range(i, i + n))
        out.append((len(w), len(hit), found))
    return out


def text(rng, n, alphabet):
    return rng.choice(["", " ", ". "]).join(rng.choice(alphabet) + rng.choice([" ", " , ", "-", "\n", "é "]) for _ in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_matches(seed):
    rng = random.Random(seed)
    for _ in range(25):
        alphabet = [rng.choice(["a", "B", "cc", "é", "longerword", "averyveryverylongword" * rng.choice([1, 9]), "x1"]) for _ in range(rng.choice([1, 2, 3, 5]))]
        docs = [rng.choice([None, "", text(rng, rng.choice([1, 5, 30, 200]), alphabet)]) for _ in range(rng.choice([1, 3, 8]))]
        items = [text(rng, rng.choice([1, 2, 5, 9, 10, 11, 14, 40]), alphabet) for _ in range(rng.choice([1, 2, 5]))] + ["", docs[0] or "q"]
        (_, _, buf, off), *_ = byte_slices(pa.array(docs, pa.string()), 1 << 40)
        held = d.Words(buf, off)
        doc, item, item_word, doc_word, n = d.matches(held, d.Tests(pa.array(items, pa.string())), rng.choice([1, 7, 50, 1 << 20]))
        for k, (count, hit, found) in enumerate(brute(docs, items)):
            got = {i for a, m in zip(doc_word[doc == k], n[doc == k], strict=True) for i in range(a, a + m)}
            assert (np.diff(held.first)[k], len(got), set(item[doc == k].tolist())) == (count, hit, found)
        for x in zip(doc, item, item_word, doc_word, n, strict=True):
            a, b = words(docs[x[0]]), words(items[x[1]])
            assert a[x[3] : x[3] + x[4]] == b[x[2] : x[2] + x[4]]
            assert not (x[2] and x[3] and a[x[3] - 1] == b[x[2] - 1])  # can't be made longer to the left
            assert a[x[3] + x[4] : x[3] + x[4] + 1] != b[x[2] + x[4] : x[2] + x[4] + 1] or x[2] + x[4] == len(b)


def test_words_that_only_share_a_number(monkeypatch):
    """All words of a length get one number: matches that the bytes refuse are cut."""
    monkeypatch.setattr(d.Words, "numbers", lambda self: self.size.astype(np.uint64))
    docs, items = ["aa bb cc dd ee ff gg hh ii jj kk ll", "zz bb cc dd ee ff gg hh ii jj kk ll mm"], ["aa bb cc dd ee ff gg hh ii jj kk ll"]
    (_, _, buf, off), *_ = byte_slices(pa.array(docs), 1 << 40)
    doc, _, _, doc_word, n = d.matches(d.Words(buf, off), d.Tests(pa.array(items)))
    assert sorted(zip(doc.tolist(), doc_word.tolist(), n.tolist(), strict=True)) == [(0, 0, 12), (1, 1, 11)]


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for depth in (2, 3, 10, 16):
        ids = rng.integers(1, 3, 300).astype(np.uint64)
        order = d.suffix_array(ids, depth)
        keys = [tuple(ids[i : i + depth]) for i in order]
        assert sorted(order.tolist()) == list(range(300)) and keys == sorted(keys)


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_documents(spark, most):
    rng = random.Random(3)
    base = [text(rng, 40, ["a", "b", "c", "é", "dd"]) for _ in range(6)]
    docs = [None, "", "?", base[0], base[0], "x " + base[1].upper() + " y", base[2][:30], "w " * 3000 + base[3]]
    items = [*base, "w", None, ""]
    df = spark.createDataFrame([(None if i == 4 else i, t, "clash", 1) for i, t in enumerate(docs)], "doc_id long, text string, found string, n_words int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "x"), (0, base[0])], "item_id long, text string")
    got = d.searched(df.select(F.struct("doc_id", "found").alias("doc"), "text"), bench, most).select("doc.doc_id", "n_words", d.hit_words(F.col("found")).alias("hit"), F.array_distinct(F.transform("found", lambda m: m["item"])).alias("items")).collect()
    want = brute(docs, [t if t is not None else "" for t in items])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.hit, sorted(r.items)) for r in got) == sorted((-1 if i == 4 else i, a, b, sorted(str(x) for x in c)) for i, (a, b, c) in enumerate(want))
    kept = d.decontaminated(df, bench).collect()
    assert all((r.text, r.found, r.n_words) == (docs[r.doc_id], "clash", 1) for r in kept)
    assert {r.doc_id for r in kept} == {i for i, (_, b, _) in enumerate(want) if not b}


def test_query_digest(spark, tmp_path):
    base = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, base), (2, None), (3, "ten " + base)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, base), (9, "One"), (2, "zero")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.op11_decontamination(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (11, 11, 2, digest("10,9"), True), 2: (0, 0, 0, digest(""), False), 3: (12, 11, 2, digest("10,9"), True)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc struct<doc_id: long>, text string"), spark.createDataFrame([], "item_id long, text string")
    assert not d.searched(docs, items).count()
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string").select(F.struct("doc_id").alias("doc"), "text")
    r = d.searched(one, items).first()
    assert (r.n_words, r.found) == (2, [])
