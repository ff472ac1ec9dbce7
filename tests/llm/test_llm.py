"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graphdedup, langid, minhash, mixing, packing, pii, suffixes, topk, toxicity, warc
from tessera.llm.common import components, shared_dir

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"
WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("", "n", "r", "st")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, ids=None, lang="en"):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, lang, "src0", len(t or ""), "clash", 1.0) for i, t in zip(ids, texts)], DOC)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(1)
    return [None, "", " ", "a", "a", "é 😀", prose(rng, 4), prose(rng, 5), prose(rng, 30_000)]


# 1


def test_warc_round_trip(spark):
    big, fake = "x" * 1200, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, None, None), (2, "u\r\nv", ""), (3, "u", big), (5, "u", big), (4, "u", big), (6, "é", "é" + fake * 3), (None, "u", big), (9, "u", "short"), (10, "u", "short"), (11, "u", fake + big), (5, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    path = shared_dir(spark)
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        (p or 0, "revisit" if h == big and p in (3, 4) else "response", 5 if h == big and p in (3, 4) else None, len((h or "").encode())) for p, _, h in rows
    )
    for r in got:
        assert r.intact and (r.record_type == "revisit" or hashlib.sha1(r.payload).hexdigest() == r.payload_digest)
    slim = {(r.archive, r.offset): r for r in warc.read_warc(spark, path, payload=False).collect()}
    assert len(slim) == len(got) and all(slim[r.archive, r.offset][:9] == r[:9] for r in got)
    warc.write_warc(pages.limit(0), empty := shared_dir(spark))
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_in_byte_ranges(spark, tmp_path):
    """Archives cut into many byte ranges, with payloads full of magics, ones that are broken off and ones that don't begin with a record."""
    rng, old = random.Random(23), spark.conf.get("spark.sql.files.maxPartitionBytes")

    def record(i, body):
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)

    bodies = [b"".join(rng.choice((b"WARC/1.1\r\n", b"x", b"\r\n\r\n", record(99, b"y"), "é".encode())) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    (tmp_path / "a.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies)))
    (tmp_path / "b.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies[:9]))[:-5])
    (tmp_path / "c.warc").write_bytes(b" " + record(1, b"x"))
    (tmp_path / "d.warc").write_bytes(b"")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    name = lambda r: r.archive[-6:]
    assert sorted((r.offset, r.page_id, bytes(r.payload)) for r in got if name(r) == "a.warc") == [(sum(len(record(j, b)) for j, b in enumerate(bodies[:i])), i, b) for i, b in enumerate(bodies)]
    assert all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() for r in got)
    assert sorted(r.page_id for r in got if name(r) == "b.warc") == list(range(8)) and {name(r) for r in got} == {"a.warc", "b.warc"}


def test_reachable_is_the_chain():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 40)
        starts = sorted(rng.sample(range(0, 200), n))
        nexts = [rng.choice([*starts, 777]) if rng.random() < 0.9 else 5000 for _ in starts]
        nexts = [max(x, s + 1) for s, x in zip(starts, nexts)]
        want, at = set(), 0
        while at in starts:
            want.add(at)
            at = nexts[starts.index(at)]
        got = warc.reachable(np.array(starts), np.array(nexts))
        assert {s for s, g in zip(starts, got) if g} == want


# 2


def bag(t):
    w = (t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts, ids):
    bags, up = [bag(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] | bags[j]).values())
            if both and sum((bags[i] & bags[j]).values()) / both >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(ids[i])
    return {x: min(g) for g in groups.values() for x in g}


def test_near_duplicates(spark, odd):
    rng = random.Random(3)
    texts = [*odd, *(prose(rng, rng.randint(5, 300)) for _ in range(30))]
    base = prose(rng, 250).split()
    for k in (1, 2, 3, 5, 8, 12, 4, 6, 9):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [texts[20], texts[20], "la la la " * 50, "la la la " * 60]
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert {i: c for i, (c, _) in got.items()} == classes(texts, list(range(len(texts))))
    assert all(k == (i == c) for i, (c, k) in got.items())
    lone = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.kept) for r in lone) == [(-1, -1, True), (7, 7, True), (7, 7, True)]
    assert minhash.near_duplicates(table(spark, texts).limit(0)).count() == 0


def test_hot_group_goes_through_the_prefix_filter(spark):
    rng = random.Random(5)
    base, texts = prose(rng, 120).split(), []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.random())
        texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, texts)).collect()}
    want = classes(texts, list(range(len(texts))))
    assert sum(got[i] != want[i] for i in want) <= 1  # signatures may miss a pair


def test_signatures_are_unbiased():
    rng, gaps = np.random.default_rng(1), []
    for t in range(60):
        a = rng.integers(0, 6, 60)
        b = np.where(rng.random(60) < 0.7, a, rng.integers(0, 6, 60))
        e = minhash.mix(np.arange(1, 61, dtype=np.uint64) + np.uint64(t * 1000))
        s = minhash.signatures(np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)], np.r_[e[a > 0], e[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 120)
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.06


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (70, 70), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(31)} == {0} and (got[60], got[55], got[70]) == (50, 50, 70)
    rng = random.Random(4)
    for _ in range(3):
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(999, 500 + rng.randrange(200)) for _ in range(99)]
        up = {x: x for e in edges for x in e}
        for _ in range(300):
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        assert {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == up
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 3


def test_toxicity(spark, odd):
    rng = random.Random(6)
    good = [prose(rng, 60) for _ in range(300)]
    bad = [prose(rng, 30) + " " + rng.choice(("zorgling", "Z0rgling", "zоrgling", "quixbert")) + " " + prose(rng, 30) for _ in range(150)]
    ids = list(range(450))
    docs = table(spark, [*good, *bad, *odd], [*ids, *range(1000, 1000 + len(odd))])
    labels = spark.createDataFrame([(i, 0, int(i >= 300)) for i in ids] + [(None, 1, 1), (3000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 450 + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i in ids if got[i].held_out]
    assert sum(got[i].predicted == (i >= 300) for i in held) >= 0.97 * len(held)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none) and toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_folding_and_exceptions():
    assert toxicity.fold("St0p1d, ÉTÉ 123 w0rthle$$! оk!!") == " stopid ete worthless ok "
    lexicon = toxicity.Lexicon({" zorg": 3.0, " zorgl": 5.0}, {" good zorgling "}, -4, 4)
    a = lexicon.automaton()
    assert lexicon.raw(" a good zorgling here ", a) == 0 and lexicon.raw(" a zorgling here ", a) > lexicon.raw(" a zorg here ", a) > 0
    assert toxicity.Lexicon({}).raw(" x ", toxicity.Lexicon({}).automaton()) == 0


# 4


def test_raw_scores_are_those_of_a_scan():
    """Against a search for every term and phrase at every place, and long texts full of both."""
    rng = random.Random(41)
    for _ in range(200):
        terms = {" " + "".join(rng.choice("ab ") for _ in range(rng.randint(1, 3))).strip() + rng.choice(("", " ")): rng.choice((0.5, 1.0, 2.0)) for _ in range(4)}
        spared = {" " + "".join(rng.choice("ab ") for _ in range(rng.randint(3, 6))).strip() + " " for _ in range(3)} - set(terms)
        text = toxicity.fold("".join(rng.choice("ab ") for _ in range(60)))
        lexicon = toxicity.Lexicon(terms, spared)
        at = lambda t: [i for i in range(len(text)) if text.startswith(t, i)]  # noqa: B023, E731
        longest = {}
        for t in sorted(terms, key=len):
            longest |= dict.fromkeys(at(t), t)
        free = [t for i, t in longest.items() if not any(j <= i and i + len(t) <= j + len(s) for s in spared for j in at(s))]
        assert lexicon.raw(text, lexicon.automaton()) == pytest.approx(sum(terms[t] for t in free) / math.log2(4 + len(text) / 400))
    lexicon = toxicity.Lexicon({" bad ": 1.0}, {" not bad "})
    began = time.process_time()
    assert lexicon.raw(" not bad" * 8000 + " bad ", lexicon.automaton()) > 0
    assert time.process_time() - began < 0.5


def test_a_lexicon_is_that_of_counts_by_hand():
    texts = ["vile thing"] * 20 + ["kind thing"] * 30 + ["so vile"]
    lexicon = toxicity.learn(texts, [1] * 20 + [0] * 31)
    # In 20 of 20 toxic documents and 1 of 31 clean ones; "thing" is in nearly all of both.
    assert [t.strip() for t in lexicon.terms] == ["vile"] and list(lexicon.terms.values()) == [pytest.approx(math.log(20.5 / 21) - math.log(1.5 / 32))]
    score = lambda t: lexicon.score(lexicon.raw(toxicity.fold(t), lexicon.automaton()))
    assert score("vile thing") > 0.5 > score("kind thing") and toxicity.learn(["a"], [1]).terms == {}



def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) * np.r_[np.ones(200), np.zeros(200) + 0.01][:, None]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1020, [float("inf")] * 8), (None, [0.5] * 8), (1100, []), (1200, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in topk.top_k(df, k=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    good = {i: np.pad(np.floor(64 * np.array(v)), (0, 8 - len(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    for q in (i for i in good if i % 20 == 0):
        want = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:7]
        assert [got[q][k] for k in range(1, 8)] == [(i, -s) for s, i in want]
    assert set(got) == {i for i in good if i % 20 == 0} and topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_repeated_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 32)  # several blocks in a tile
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(120, 8)))] + [(201, [9.0] * 8)] * 30 + [(202, [8.0 + j / 1000] * 8) for j in range(12)]
    rows += [rows[0]] * 5 + [(20, [-9.0] * 8)] + [(300 + j, [0.5] * 8) for j in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    one = {}
    for i, v in rows:
        one[i] = min(one.get(i, v), v)
    got = {}
    for r in topk.top_k(df, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert set(got) == {i for i in one if i % 20 == 0}
    for q in got:
        want = sorted((-int(np.floor(64 * np.array(one[q])) @ np.floor(64 * np.array(v))), i) for i, v in one.items() if i != q)
        assert sorted(got[q]) == [(n, *w) for n, w in enumerate(want[:7], 1)]


def test_rows_under_the_bar_are_not_read_to_the_end():
    rng = np.random.default_rng(7)
    x = np.floor(64 * rng.normal(size=(300, 4)) * 0.2)
    x[:5] = 200
    best, read = topk.Best(np.array([1000]), 5), []
    whole = topk.Lists.read
    try:
        topk.Lists.read = lambda self, a, b, up, down, live, shown: (read.append(int(live.sum())), whole(self, a, b, up, down, live, shown))[1]
        topk.aggregate(np.array([[1.0, 2.0, 3.0, 4.0]]), best, x, np.arange(300))
    finally:
        topk.Lists.read = whole
    assert best.row.tolist() == [0, 1, 2, 3, 4] and best.score.tolist() == [2000] * 5 and read[-1] == 5 and read[0] == 300


# 5


def test_vector_links(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    x[50:90] = x[0] + rng.normal(size=(40, 16)) * 0.1
    x[90:95] = x[1]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [1.0, None]), (603, [float("nan")] * 16), (None, [1.0] * 16), (3, [float(v) for v in x[3]])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    found = graphdedup.near_duplicates(df)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(500, dtype=bool)
    true = sum(links[i].sum() for i in range(500))
    assert sum(min(got[i][0], links[i].sum()) for i in range(500)) >= 0.97 * true and all(got[i][0] <= links[i].sum() for i in range(500))
    assert got[600] == (0, 600, True) and got[601] == (0, 601, True) and got[None] == (0, None, True) and got[92][1:] == (1, False)
    assert found.count() == len(rows) and graphdedup.audited_recall(df, found, every=3) >= 0.97
    assert graphdedup.near_duplicates(df.limit(0)).count() == 0


def test_links_between_clusters(spark):
    rng = np.random.default_rng(8)
    x = graphdedup.units(rng.normal(size=(6000, 64)))
    z = rng.normal(size=x.shape)
    z = graphdedup.units(z - (z * x).sum(1, keepdims=True) * x)
    both = np.concatenate([x, 0.91 * x + np.sqrt(1 - 0.91**2) * z])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(both)], "vec_id long, embedding array<double>").repartition(4)
    s = both @ both.T >= 0.9
    got = {r.vec_id: r.n_links for r in graphdedup.near_duplicates(df).collect()}
    assert got == {i: int(n) - 1 for i, n in enumerate(s.sum(1))}


def test_links_of_clusters_over_a_shard(spark):
    """A cluster that is cut into shards, copies and far vectors; recall is audited in the run."""
    rng = np.random.default_rng(9)
    close = graphdedup.units(np.r_[1, np.zeros(15)] + rng.normal(size=(2600, 16)) * 0.11)
    x = np.concatenate([close, close[:30], rng.normal(size=(400, 16))]).round(6)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found, recall = graphdedup.audited(df)
    u = graphdedup.units(x)
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in found.collect()}
    assert links.sum() > 2600 * 200 and recall >= 0.97
    assert all(got[i] <= n for i, n in enumerate(links)) and sum(got.values()) >= 0.97 * links.sum()


# 6


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    texts = [*odd, "a  b", " a", "a ", "a   b", "a \nb\n c", "<|endoftext|> x", "\r\n\r\n y", *(prose(rng, rng.randint(1, 900)) for _ in range(60))]
    rows = packing.pack(table(spark, texts)).collect()
    at = {}
    for r in rows:
        at.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(at[i], key=lambda r: r.piece)
        assert [p.start for p in parts] == list(np.cumsum([0, *(p.length for p in parts)])[:-1]) and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 2048 for p in parts[1:]) and all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in parts)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0, *(n for _, n in s)])[:-1]) and sum(n for _, n in s) <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in rows) / 2048) + 1
    assert packing.pack(table(spark, texts).limit(0)).count() == 0


def test_best_fit_is_that_of_a_sequential_pass():
    rng = random.Random(9)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        gaps = []
        for s in sorted(sizes, reverse=True):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else 100) - s)
        placed, left, _ = packing.best_fit([(s, 0, n) for s, n in Counter(sizes).items()], [], 100)
        assert not left and sum(r[2] for r in placed if r[4] == 100) == len(gaps)


def test_rounds_over_ranges_place_every_piece_once(spark):
    rng = random.Random(19)
    sizes = Counter(min(99, int(rng.expovariate(1 / 25)) + 1) for _ in range(5000))
    plan = packing.planned(spark.createDataFrame(list(sizes.items()), "length int, many long"), 100)
    took, sequences = Counter(), {}
    for size, rank, many, first, at in plan:
        assert rank == took[size]  # ranks are dealt out in order, none twice
        took[size] += many
        for k in range(many):
            sequences.setdefault(first + k, []).append((at, size))
    assert took == sizes
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == list(np.cumsum([0, *(n for _, n in s)])[:-1]) and sum(n for _, n in s) <= 100
    assert len(sequences) <= 1.01 * sum(k * n for k, n in sizes.items()) / 100 + 1


def test_ids_of_words_are_those_of_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(20)
    parts = [" ", " ", " ", "\n", "\t", "a", "Ab", "é", "7", "!", "'s", "\u00a0", "\u2003", "\x1c", "😀", "<|endoftext|>", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    words = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    for some in (texts[:1500], texts[1500:], texts[:1500]):
        ids, off = words.encode(packing.pa.array(some, packing.pa.string()))
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(some))] == [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]


# 7


def test_budgets_stay_among_siblings(spark):
    leaves = spark.createDataFrame([("x", "en", "a", 100), ("x", "en", "b", 1000), ("x", "de", "c", 50), ("y", "en", "d", 5000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, 1000.0, 1, {"domain": {"x": 0.5, "y": 0.5}, "lang": {"en": 0.5, "de": 0.5}}).collect()}
    assert got == {"a": 100, "b": 350, "c": 50, "d": 500}
    got = {r.source: r.budget for r in mixing.budgets(leaves, 4000.0, 1, {"domain": {"x": 0.5, "y": 0.5}}).collect()}
    assert got == {"a": 100, "b": 1000, "c": 50, "d": 2850}  # a domain that can't hold its share leaves it to the other


def test_mixing(spark, odd):
    rng = random.Random(10)
    texts = [*odd, *(prose(rng, rng.randint(1, 80)) for _ in range(80))]
    docs = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.concat(F.lit("src"), (F.col("doc_id") % 4).cast("string"))))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise("en")).withColumn("epoch", F.lit("clash"))
    got = mixing.mixed(docs, weights={"domain": {"d0": 0.7, "d1": 0.1}}).collect()
    leaf = {}
    for r in got:
        leaf.setdefault(r.leaf, [0, r.budget])[0] += r.n_tokens
    assert got and all(n <= b for n, b in leaf.values())
    longest = max(len((t or "").split()) for t in texts)
    assert all(b - n < longest for n, b in leaf.values())
    again = mixing.mixed(docs.repartition(5), weights={"domain": {"d0": 0.7, "d1": 0.1}}).collect()
    assert Counter((r.doc_id, r.epoch) for r in got) == Counter((r.doc_id, r.epoch) for r in again)
    assert mixing.mixed(docs.limit(0)).count() == 0


# 8


def brute_repeats(texts):
    raw, seen = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(raw):
        for s in range(len(b) - 399):
            seen.setdefault(b[s : s + 400], []).append((i, s))
    marks = [bytearray(len(b)) for b in raw]
    for v in seen.values():
        if len(v) > 1:
            for i, s in v:
                marks[i][s : s + 400] = b"\1" * 400
    return [(len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()) for b, m in zip(raw, marks)]


def thue_morse(n):
    return bytes(97 + bin(i).count("1") % 2 for i in range(n)).decode()


@pytest.mark.parametrize("whole, piece", [(4096, 1 << 21), (8, 3000)])
def test_repeated_strings(spark, whole, piece):
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (80, 100, 150)]
    texts = [" ".join([prose(rng, rng.randint(0, 120)), rng.choice(shared)[rng.randint(0, 9) :], prose(rng, rng.randint(0, 60))]) for _ in range(40)]
    texts += [texts[2], texts[2], None, "", "x" * 399, "y" * 400, "z" * 401, "ab" * 600, texts[5] + texts[5], "😀" * 300, texts[7][:300] + "Q" + texts[7][301:]]
    texts += [thue_morse(1024), thue_morse(2048)[1024:], " ".join([prose(rng, 1500), shared[0], prose(rng, 700), shared[2]])]
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.deduplicated(table(spark, texts), whole, piece).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    assert suffixes.deduplicated(table(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("between", [None, lambda pre, a, b: (b - a) % 7, lambda pre, a, b: (pre[0][b] + (1 << 31) - pre[0][a]) % 2])
def test_common_extensions_in_spite_of_collisions(monkeypatch, between):
    if between:
        monkeypatch.setattr(suffixes, "between", between)
    rng, spans, p, group = random.Random(22), [], [], []
    for g in range(25):
        base = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(2)]
        for _ in range(rng.choice((1, 2, 5, 90))):
            x, at = bytearray(rng.choice(base)), rng.randint(20, 40)
            for _ in range(rng.randint(0, 4)):
                x[rng.choice([*range(16), *range(44, 60)])] = rng.choice(b"abc")
            begin, end = rng.randint(0, 12), rng.randint(48, 60)
            spans.append(bytes(x[begin:end]))
            p.append(30 - begin)
            group.append(g)
    low, high = suffixes.repeated(spans, np.array(p), np.array(group), 40)
    for i, s in enumerate(spans):
        others = {(o[t : t + 40], p[j] - t) for j, o in enumerate(spans) if j != i and group[j] == group[i] for t in range(len(o) - 39)}
        found = [t for t in range(len(s) - 39) if (s[t : t + 40], p[i] - t) in others and 0 <= p[i] - t <= 40]
        assert (low[i], high[i]) == ((found[0], found[-1] + 40) if found else (0, 0))


# 9


def test_gradients_are_those_of_differences():
    net = langid.Network.fresh(["a", "b"], 4)
    words = [w.encode() for w in ("hello", "été", "x")]
    x, n, y = np.array([list(w.ljust(6, b"\0")) for w in words]), np.array([len(w) for w in words]), np.array([0, 1, 0])
    _, grads = net.gradients(x, n, y)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[k][i] += 1e-2
        up = net.gradients(x, n, y)[0]
        net.p[k][i] -= 2e-2
        down = net.gradients(x, n, y)[0]
        net.p[k][i] += 1e-2
        assert abs((up - down) / 2e-2 - g[i]) < 1e-3


def test_every_byte_is_labelled_as_by_a_loop():
    net = langid.Network.fresh(["a", "b", "c"], 4)
    texts = [b"", b"x", bytes(range(65, 91)) * 30, "é a".encode() * 75, b"y" * langid.STRETCH]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = net.pooled(buf, off)

    def states(d, run):
        h, out = np.zeros(4), []
        for c in run:
            a = net.p[f"x{d}"][c] + net.p[f"c{d}"]
            z, r = (1 / (1 + np.exp(-(a[k : k + 4] + h @ net.p[f"h{d}"][:, k : k + 4]))) for k in (0, 4))
            h = h + z * (np.tanh(a[8:] + (r * h) @ net.p[f"h{d}"][:, 8:]) - h)
            out.append(h)
        return out

    for t, row in zip(texts, got, strict=True):
        total = np.zeros(3)
        for first in range(0, len(t), langid.STRETCH):
            begin, last = max(0, first - langid.AROUND), min(len(t), first + langid.STRETCH)
            run = t[begin : last + langid.AROUND]
            both = zip(states("f", run), reversed(states("b", run[::-1])), strict=True)
            for i, (f, b) in enumerate(both, begin):
                s = np.r_[f, b] @ net.p["o"] + net.p["b"]
                total += np.exp(s) / np.exp(s).sum() if first <= i < last else 0
        assert np.allclose(row, total / max(1, len(t)), atol=1e-4)


def test_language_id(spark, odd):
    rng = random.Random(12)
    other = [w[::-1] + "ä" for w in WORDS]
    texts = [prose(rng, 40) for _ in range(60)] + [" ".join(rng.choice(other) for _ in range(40)) for _ in range(60)]
    docs = table(spark, [*texts, *odd, "123 !"]).withColumn("lang", F.when(F.col("doc_id") < 60, "xx").when(F.col("doc_id") < 120, "yy"))
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert len(got) == 121 + len(odd) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(120) if got[i].held_out]
    assert held and all(got[i].lang_pred == ("xx" if i < 60 else "yy") for i in held)
    assert {got[120 + i].lang_pred for i in range(3)} == {"und"} and got[120 + len(odd)].lang_pred == "und"
    assert langid.language_id(docs.limit(0)).count() == 0


# 10

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    def ok(k, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]

    return {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if ok(k, m.group())] for k, p in BASE.items()}


def test_base_spans(spark, odd):
    rng = random.Random(13)
    texts = [*odd, "a@b.c+d@e.f é x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111, 5500-0000-0000-0004 1 4111111111111111 x4111111111111111.", "+1 (274) 555-1898, +12345678.+1 2", "𝒳 j@k.lm 日本 +81 3 1234 5678"]
    texts += ["".join(rng.choice(("1", "23", "4111111111111111", ".", " ", "-", "+", "(", ")", "a", "@", "b.c", "é", "_")) for _ in range(60)) for _ in range(300)]
    for r in pii.sanitised(table(spark, texts)).collect():
        assert {k: [(x.s, x.e) for x in r[k]] for k in pii.KINDS} == base_spans(r.text)
        assert (r.clean_text is None) == (r.text is None)
    assert pii.sanitised(table(spark, texts).limit(0)).count() == 0


def test_disclosing_terms(spark):
    rng = random.Random(14)
    texts = [prose(rng, 60) for _ in range(200)] + [f"{prose(rng, 30)} zebulon {'quark' if i else 'boson'} mail me@zeb.org {prose(rng, 30)} zebulon" for i in range(5)]
    got = pii.sanitised(table(spark, texts)).collect()
    for r in got:
        terms = {r.text[x.s : x.e] for x in r.term}
        assert terms == ({"zebulon", "quark", "mail"} if r.doc_id > 200 else {"zebulon", "mail"} if r.doc_id == 200 else set())
        if r.doc_id >= 200:
            assert "zebulon" not in r.clean_text and "[EMAIL]" in r.clean_text and "me@zeb.org" not in r.clean_text


def brute_disclosures(texts, support=3, threshold=0.9):
    def entities(t):
        out = set()
        for k, spans in base_spans(t).items():
            for a, b in spans:
                v = t[a:b]
                d = re.sub("[^0-9]", "", v)
                out |= {f"kind:{k}", *{"email": (f"email:{v.lower()}", f"domain:{v.lower().split('@')[-1]}"), "ip": (f"ip:{v}", "network:" + ".".join(v.split(".")[:2])), "card": (f"card:{d}", f"issuer:{d[:6]}"), "phone": (f"phone:{d}", f"area:{d[:4]}")}[k]}
        return out

    terms = [set(re.findall(r"(?<![^\W\d_])[^\W\d_]{3,}(?![^\W\d_])", (t or "").lower())) for t in texts]
    have = [entities(t) for t in texts]
    n_t, n_c, both, shared = Counter(), Counter(), Counter(), {}
    for t, ts, cs in zip(texts, terms, have, strict=True):
        n_t.update(ts)
        n_c.update(cs)
        for c in cs:
            for x in ts:
                both[c, x] += 1
                shared.setdefault((c, x), set()).add(t)
    n, out = len(texts), {}
    for (c, x), m in both.items():
        if len(shared[c, x]) >= support and n_c[c] < n:
            ratio = math.log2(n * m / (n_c[c] * n_t[x])) / math.log2(n / n_c[c])
            if ratio >= threshold - 1e-9:
                out[c, x] = ratio
    return out


def test_disclosures_are_those_of_brute_force(spark, odd):
    rng = random.Random(21)
    texts = [*odd, *(prose(rng, rng.randint(3, 50)) for _ in range(150))]
    for k in range(40):
        w = prose(rng, 30).split()
        w.insert(rng.randrange(len(w)), rng.choice((f"u{k % 4}@h{k % 2}.org", f"10.{k % 3}.1.{k}", "4111 1111 1111 1111", f"+1 555 010 {1000 + k}")))
        w.insert(rng.randrange(len(w)), rng.choice(("zebulon", "quark", "boson")))
        texts.append(" ".join(w))
    texts += texts[-3:] * 2
    want = brute_disclosures(texts)
    got = {(r.entity, r.term): r.ratio for r in pii.disclosures(pii.based(table(spark, texts).select("doc_id", "text"))).collect()}
    assert got.keys() == want.keys() and want and any(c.startswith("kind:") for c, _ in want)
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_sanitisation_of_clashing_columns_and_repeats(spark):
    rows = [(1, "a@b.co x", "was"), (1, "a@b.co x", "was"), (None, "a@b.co x", "was"), (2, None, "was")]
    docs = spark.createDataFrame([(*r, 7, "k", "t") for r in rows], "doc_id long, text string, email string, phone int, _key string, term string")
    got = pii.sanitised(docs).collect()
    assert sorted((r.doc_id or 0, r.clean_text or "", len(r.email), len(r.phone)) for r in got) == [(0, "[EMAIL] x", 1, 0), (1, "[EMAIL] x", 1, 0), (1, "[EMAIL] x", 1, 0), (2, "", 0, 0)]


def test_disclosing_terms_without_their_entity(spark):
    rng = random.Random(16)
    texts = [prose(rng, 60) for _ in range(200)] + [f"{prose(rng, 30)} zebulon mail me@zeb.org {prose(rng, 30)}" for _ in range(5)] + [f"{prose(rng, 20)} Zebulon, {prose(rng, 9)} zebulon" for _ in range(2)]
    for r in pii.sanitised(table(spark, texts)).collect():
        terms = [r.text[x.s : x.e] for x in r.term]
        assert terms == ([] if r.doc_id < 200 else ["zebulon", "mail"] if r.doc_id < 205 else ["Zebulon", "zebulon"])
        assert r.doc_id < 205 or r.clean_text == re.sub("(?i)zebulon", "[TERM]", r.text)


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    texts = [prose(rng, rng.randint(20, 90)) for _ in range(120)] + [prose(rng, 30) + " zorgling " + prose(rng, 30) for _ in range(60)]
    texts += [texts[3], texts[4] + " " + WORDS[0], texts[5] + " me@zeb.org"]
    docs = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(120 <= i < 180)) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    at, ids = docs, set(range(len(texts)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, d)
        assert out.columns == docs.columns
        got = {r.doc_id for r in out.collect()}
        if name == "toxicity":
            ids -= set(range(120, 180))
            assert got == ids
        elif name == "near_duplicates":
            want = classes([texts[i] for i in sorted(ids)], sorted(ids))
            ids = {i for i in ids if want[i] == i}
            assert got == ids
        elif name == "sanitisation":
            assert got == ids and out.where("text like '%me@zeb%'").count() == 0
        at = out
    packed = corpus_pipeline.run(spark, d).collect()
    assert packed and {r.doc_id for r in packed} <= ids


def test_pipeline_keeps_one_row_of_a_class(spark):
    import corpus_pipeline

    rng = random.Random(17)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (None, a), (4, d), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter(r.text for r in out.collect())
    assert got == Counter([a, b, c, d, None, ""])


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns and empty tables."""
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rows = [(i, t, "en", "src0", len(t or ""), "k", 0.5, 1) for i, t in enumerate(odd)]
    rows += [(None, odd[6], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[7], rows[7], (3, "mail a@b.co now", "de", None, 15, "k", 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, predicted int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        got = out.collect()
        texts = Counter(r.text for r in got) if "text" in out.columns else Counter()
        if name == "toxicity":
            assert texts == Counter(r[1] for r in rows) and {r.score for r in got} == {0.5, None}
        elif name == "near_duplicates":
            # Null, empty and wordless texts are like no other.
            assert texts == Counter({t: 1 for t in [r[1] for r in rows] if t and t.strip()}) + Counter([None, None, "", " "])
        elif name == "sanitisation":
            assert texts == Counter("mail [EMAIL] now" if "@" in (r[1] or "") else r[1] for r in rows)
        elif name == "packing":
            assert Counter((r.doc_id, r.piece) for r in got if r.piece == 0) == Counter((r[0], 0) for r in rows)
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    """Documents that own every name that a stage adds, uses or drops get their values back."""
    import corpus_pipeline

    rng = random.Random(31)
    names = "_key _entities _told email ip card phone term clean_text leaf n_tokens epoch budget score predicted _score _row set_aside class_id kept domain tokens capacity share place bucket over upto".split() + ["a b.c"]
    texts = [None, "", *(prose(rng, 40) + f" mail x{i}@y.org +4930123456{i} {rng.choice(WORDS)}" for i in range(12))]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(range(len(texts)))
