"""Toxicity by a learned, weighted lexicon, matched with an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import bisect
import math
import pickle
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lean, table, tuned

#: Labelled rows that a lexicon is learned from, of each label at most.
TRAIN_ROWS = 2_500
TERMS = 400
#: Share of the toxic documents learned from that a term must be in.
SUPPORT = 0.02
THRESHOLD = 0.7
STEMS = range(4, 9)
#: Letters of other scripts by the Latin letters that they are taken for, and digits and signs by the letters that they stand in for.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ӏ": "l", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ν": "v", "ı": "i", "ł": "l", "ø": "o", "đ": "d"}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
FOLD = str.maketrans(LOOKALIKES | STAND_INS)
UNSEEN = re.compile("[­​-‏⁠﻿̀-ͯ]+")
#: Not a letter: all of it becomes one space, so that terms are anchored at words.
APART = re.compile(r"[\W\d_]+")
#: A stand-in with no letter on its right is punctuation, one of digits alone a number.
TRAILING = re.compile(r"[!|]+(?=\W|$)|(?<![^\W\d_])\d+(?![^\W\d_])")


def fold(text: str) -> str:
    """Lower case without accents, with homoglyphs and substituted digits as the letters they stand for, words between single spaces, a space at each end."""
    text = TRAILING.sub(" ", text.lower())
    if not text.isascii():
        text = UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return f" {APART.sub(' ', text.translate(FOLD)).strip()} "


@dataclass
class Lexicon:
    """terms: weights of folded terms, " word " or " stem"; exceptions: phrases in which the term that they hold does not count."""

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    bias: float = -4.0
    slope: float = 4.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for t in self.exceptions:
            a.add_word(t, (len(t), 0.0))
        if self.terms or self.exceptions:
            a.make_automaton()
        return a

    def raw(self, folded: str, automaton) -> float:
        """Weights of the matches outside exception phrases, over the length's logarithm. Where one term is the start of another, the longer counts."""
        if not len(automaton):
            return 0.0
        spared, found = [], {}
        for end, (n, w) in automaton.iter(folded):
            if w:
                found[end - n + 1] = (end, w)
            else:
                spared.append((end - n + 1, end))
        if not found:
            return 0.0
        # Of the phrases that begin at a match's start or before, the one that reaches farthest tells whether it is spared.
        spared.sort()
        begins, upto = [x for x, _ in spared], [-1, *accumulate((y for _, y in spared), max)]
        total = sum(w for a, (b, w) in found.items() if upto[bisect.bisect_right(begins, a)] < b)
        return total / math.log2(4 + len(folded) / 400)

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * raw))))


def learn(texts: list[str], toxic: list[int], terms: int = TERMS) -> Lexicon:
    """Words and stems by smoothed log-odds of the label among documents, shorter stems first; phrases of a term and a neighbour that only clean documents have; then a logistic fit of the raw score. Without both labels the lexicon is empty."""
    sides = {0: Counter(), 1: Counter()}
    many = Counter(toxic)
    folded = [fold(t) for t in texts]
    for t, y in zip(folded, toxic, strict=True):
        words = set(t.split())
        sides[y].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k})
    bad, good = sides[1], sides[0]
    least = max(3, math.ceil(SUPPORT * many[1]))
    odds = {t: math.log((n + 0.5) / (many[1] + 1)) - math.log((good[t] + 0.5) / (many[0] + 1)) for t, n in bad.items() if n >= least}
    strong = sorted((t for t, o in odds.items() if o >= 2.5 and bad[t] >= 8 * good[t]), key=lambda t: (len(t.strip()), t))
    kept: dict[str, float] = {}
    for t in sorted(strong, key=lambda t: (-bad[t], len(t), t)):
        if len(kept) < terms and not any(t.startswith(s) or s.startswith(t) for s in (t[:k] for k in range(1, len(t))) if s in kept):
            kept[t] = odds[t]
    for t in [t for t in kept if t.endswith(" ") and any(t.startswith(s) for s in kept if s != t)]:
        del kept[t]
    lexicon = Lexicon(kept)
    phrases = {0: Counter(), 1: Counter()}
    for t, y in zip(folded, toxic, strict=True):
        words = t.split()
        for i, w in enumerate(words):
            if f" {w} " in kept or any(f" {w[:k]}" in kept for k in STEMS):
                phrases[y].update(f" {a} {b} " for a, b in (words[i - 1 : i + 1], words[i : i + 2]) if a and b) if 0 < i < len(words) - 1 else None
    lexicon.exceptions = {p for p, n in phrases[0].items() if n >= 3 and phrases[1][p] == 0}
    if kept and many[0] and many[1]:
        automaton = lexicon.automaton()
        x = np.array([lexicon.raw(t, automaton) for t in folded])
        y = np.array(toxic, float)
        x1, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
        for _ in range(50):  # Newton steps of a ridge-penalised logistic regression
            p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
            step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + 0.05 * np.eye(2), x1.T @ (y - p) - 0.05 * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                break
        lexicon.bias, lexicon.slope = map(float, beta)
    return lexicon


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """Learned from at most ``rows`` labelled documents of each label, those of least hash, by their whole texts; none of them is held out (``crc32(doc_id) mod 3 = 1``). Rows with a null label, doc_id or text are passed over."""
    usable = labels.where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", "toxic")
    order = F.xxhash64("doc_id")
    picked = [usable.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(rows) for y in (0, 1)]
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked[0].union(picked[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))), "doc_id")
    # Of a document that has several texts, the least.
    once = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = sorted((r.doc_id, r.text, r.toxic) for r in once.toLocalIterator())
    return learn([t for _, t, _ in got], [int(y) for _, _, y in got])


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` added (columns of these names are replaced). Only the text is read; null and empty texts get the score of no match."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(pickle.dumps(lexicon))
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        lexicon = pickle.loads(sent.value)
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [lexicon.score(lexicon.raw(fold(t.as_py() or ""), automaton)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*names, "score", "predicted"])

    kinds = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.toDF(*names).mapInArrow(lean(run), kinds).toDF(*docs.columns, "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``. A null doc_id counts as not held out; repeated rows are scored alike; no labels give an empty lexicon, whose scores are all below the threshold; no documents give no rows."""
    lexicon = trained(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored(docs.select("doc_id", "text"), lexicon).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
