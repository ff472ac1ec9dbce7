"""Interactions of filters against a pass over documents in every order."""

import itertools
import random
import re

from tessera.llm import filteraudit as a

DOC = "doc_id long, text string, source string, mask int, part string, n long"


def brute(docs, labels):
    marks = {}
    for i, q, t in labels:
        if i is not None:
            g, x = marks.get(i, (False, False))
            marks[i] = (g or q == 1, x or t == 1)
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        rows.append((s or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, *marks.get(i, (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        first = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for fails, _, _ in mine:
                hit = next((f for f in order if f in fails), None)
                if hit:
                    first[hit] += 1
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                failing = [r for r in mine if f in r[0]]
                left = [r for r in left if f not in r[0]]
                out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone), first[f])
    return out


def test_filters_in_every_order(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n ", "A", "ÀÉ é", "a\x0bb\x0cc d", "x" * 70_000, "A#b " * 300]
    texts += [" ".join(rng.choices(vocabulary[: rng.choice((50, 300))], k=rng.choice((150, 199, 200, 201, 400)))) + rng.choice(("", "$", " ABC DEF", "A" * 30)) for _ in range(30)]
    docs = [(i, rng.choice(texts), rng.choice(("s", "s", "t", None, ""))) for i in range(120)]
    docs += [(None, "A", "s"), (None, "A", "s"), (7, "again", "s"), *[(500, "repeated row " * 90, "t")] * 5, (3, docs[3][1], "t")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 3, "clash", 9) for d in docs], DOC).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in a.audited(df, marks).collect()}
    assert got == brute(docs, labels)


def test_word_counts_of_rows_that_repeat(spark):
    rows = spark.createDataFrame([("k", "a b a"), ("k", "a b a"), ("l", "  "), ("m", "a")], "key string, text string").repartition(3)
    got = {r.key: (r.n_words, r.n_distinct) for r in a.word_counts(rows).collect()}
    assert got == {"k": (6, 2), "m": (1, 1)}


def test_no_documents(spark):
    assert not a.audited(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count()
