"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import byte_slices, lean, table, tuned

#: Labelled rows learned from at most, those of least hash, and bytes of each from a place drawn by the seed.
TRAIN_ROWS, TRAIN_BYTES = 1_500, 20_000
HIDDEN = 16
#: Bytes of a stretch that are labelled, and bytes on each side of it that both layers run through besides.
STRETCH, AROUND = 224, 16
#: Bytes of a stretch learned from; batches.
WINDOW, STEPS, BATCH, RATE = 64, 500, 160, 0.01
#: Stretches run through the network together.
RUN = 1024
UNKNOWN = "und"


def stretches(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first and last byte run through, first and last byte labelled) of each stretch of the texts between ``off``. Stretches tile each text; a stretch is run through from AROUND bytes before it to AROUND bytes after it, as far as the text goes."""
    many = -(-np.diff(off) // STRETCH)
    text = np.repeat(np.arange(len(many)), many)
    first = off[text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
    last = np.minimum(first + STRETCH, off[text + 1])
    return text, np.maximum(first - AROUND, off[text]), np.minimum(last + AROUND, off[text + 1]), first, last


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Two gated recurrent layers over a window's bytes, one from each end, and a softmax over languages at each byte."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng, p = np.random.default_rng(seed), {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            p[f"h{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            p[f"c{d}"] = np.zeros(3 * hidden, np.float32)
        p["o"] = rng.normal(0, hidden**-0.5, (2 * hidden, len(langs))).astype(np.float32)
        p["b"] = np.zeros(len(langs), np.float32)
        return Network(langs, p)

    def layer(self, d: str, x: np.ndarray, keep: np.ndarray | None, tape: list | None) -> np.ndarray:
        """States (time, row, hidden) of the layer that runs over the columns of ``x`` in order; where ``keep`` is 0 the state stays 0."""
        wx, wh = self.p[f"x{d}"] + self.p[f"c{d}"], self.p[f"h{d}"]
        c = len(wh)
        h, out = np.zeros((len(x), c), np.float32), np.empty((x.shape[1], len(x), c), np.float32)
        for t in range(x.shape[1]):
            a = wx[x[:, t]]
            g = sigmoid(a[:, : 2 * c] + h @ wh[:, : 2 * c])
            z, r = g[:, :c], g[:, c:]
            n = np.tanh(a[:, 2 * c :] + (r * h) @ wh[:, 2 * c :])
            new = h + z * (n - h)
            if keep is not None:
                new *= keep[:, t, None]
            if tape is not None:
                tape.append((h, z, r, n))
            h = out[t] = new
        return out

    def states(self, x: np.ndarray, keep: np.ndarray | None = None, tapes: tuple | None = None) -> np.ndarray:
        f = self.layer("f", x, keep, tapes and tapes[0])
        b = self.layer("b", x[:, ::-1], None if keep is None else keep[:, ::-1], tapes and tapes[1])
        return np.concatenate([f, b[::-1]], axis=2)

    def log_probs(self, states: np.ndarray) -> np.ndarray:
        s = states @ self.p["o"] + self.p["b"]
        s -= s.max(-1, keepdims=True)
        return s - np.log(np.exp(s).sum(-1, keepdims=True))

    def back(self, d: str, x: np.ndarray, keep: np.ndarray, tape: list, grad_out: np.ndarray, grads: dict) -> None:
        """Backpropagation through time of one layer; adds to ``grads``."""
        wh, c = self.p[f"h{d}"], self.p[f"h{d}"].shape[0]
        gx, gh, carry = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh), np.zeros((len(x), c), np.float32)
        for t in reversed(range(x.shape[1])):
            h, z, r, n = tape[t]
            g = (grad_out[t] + carry) * keep[:, t, None]
            dn = g * z * (1 - n * n)
            dr = dn @ wh[:, 2 * c :].T
            gates = np.concatenate([g * (n - h) * z * (1 - z), dr * h * r * (1 - r)], axis=1)
            carry = g * (1 - z) + dr * r + gates @ wh[:, : 2 * c].T
            gh[:, : 2 * c] += h.T @ gates
            gh[:, 2 * c :] += (r * h).T @ dn
            np.add.at(gx, x[:, t], np.concatenate([gates, dn], axis=1))
        grads[f"x{d}"], grads[f"h{d}"], grads[f"c{d}"] = gx, gh, gx.sum(0)

    def gradients(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the labelled bytes, and its gradients."""
        keep = (np.arange(x.shape[1])[None, :] < length[:, None]).astype(np.float32)
        tapes: tuple[list, list] = ([], [])
        states = self.states(x, keep, tapes)
        logs = self.log_probs(states)
        weight = keep.T / keep.sum()
        rows = np.arange(len(x))
        loss = -(logs[:, rows, y] * weight).sum()
        d = np.exp(logs)
        d[:, rows, y] -= 1
        d *= weight[:, :, None]
        flat = d.reshape(-1, d.shape[2])
        grads = {"o": states.reshape(len(flat), -1).T @ flat, "b": flat.sum(0)}
        up, c = d @ self.p["o"].T, self.p["hf"].shape[0]
        self.back("f", x, keep, tapes[0], up[:, :, :c], grads)
        self.back("b", x[:, ::-1], keep[:, ::-1], tapes[1], up[::-1, :, c:], grads)
        return float(loss), grads

    def pooled(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The mean over each text's bytes of each language's probability; every byte is labelled, in the one stretch that it belongs to. Empty texts have zeros."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        text, begin, end, first, last = stretches(off)
        order = np.argsort(end - begin, kind="stable")
        for i in range(0, len(order), RUN):
            k = order[i : i + RUN]
            size = end[k] - begin[k]
            wide = int(size.max())
            t = np.arange(wide)[None, :]
            x = buf[np.minimum(begin[k, None] + t, len(buf) - 1)]
            inside = t < size[:, None]
            keep = None if size.min() == wide else inside.astype(np.float32)
            labelled = inside & (begin[k, None] + t >= first[k, None]) & (begin[k, None] + t < last[k, None])
            p = np.exp(self.log_probs(self.states(x, keep)))
            np.add.at(out, text[k], np.einsum("trl,rt->rl", p, labelled.astype(np.float32)))
        return out / np.maximum(np.diff(off), 1)[:, None]


def learn(texts: list[str], langs: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 7) -> Network:
    """Trained by Adam on batches of stretches of WINDOW bytes, languages drawn evenly, then a text by length, then a place in it."""
    names = sorted(set(langs))
    net, rng = Network.fresh(names, hidden, seed), np.random.default_rng(seed)
    bags = []
    for k, name in enumerate(names):
        own = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t, y in zip(texts, langs, strict=True) if y == name]
        if own := [b for b in own if len(b)]:
            bags.append((k, own, np.cumsum([len(b) for b in own])))
    if len(bags) < 2:
        return net
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        rows, y = [], []
        for b in rng.integers(0, len(bags), BATCH):
            k, own, ends = bags[b]
            text = own[int(np.searchsorted(ends, rng.integers(ends[-1]), "right"))]
            at = int(rng.integers(max(1, len(text) - WINDOW + 1)))
            rows.append(text[at : at + WINDOW])
            y.append(k)
        length = np.array([len(r) for r in rows])
        x = np.zeros((BATCH, length.max()), np.uint8)
        x[np.arange(x.shape[1])[None, :] < length[:, None]] = np.concatenate(rows)
        _, grads = net.gradients(x, length, np.array(y))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def trained(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Network:
    """Learned from the text and non-null lang of at most ``rows`` documents, those of least hash, none of them held out (``crc32(doc_id) mod 5 = 0``). Of a text with more than ``most`` characters so many are learned from, from a place given by the doc_id's hash, so that what comes to the driver is bounded."""
    usable = docs.where("doc_id is not null and text is not null and lang is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    ids = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    start = F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int")
    got = usable.select("doc_id", F.substring("text", start, F.lit(most)).alias("text"), "lang").join(F.broadcast(ids.distinct()), "doc_id")
    got = sorted((r.doc_id, r.text, r.lang) for r in got.limit(2 * rows).toLocalIterator())
    return learn([t for _, t, _ in got], [y for _, _, y in got])


def identified(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) for each row: the network runs over the bytes of the whole text in overlapping stretches and labels every one; the text has the language of the greatest mean probability, which is the score."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(pickle.dumps(net))

    def run(batches):
        net = pickle.loads(sent.value)
        for batch in batches:
            for i, j, buf, off in byte_slices(batch.column(1)):
                letter = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                p = net.pooled(buf, off) if net.langs else np.zeros((j - i, 1))
                known = letter & bool(net.langs)
                langs = [net.langs[k] if good else UNKNOWN for k, good in zip(p.argmax(1), known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(langs, pa.string()), pa.array(np.where(known, np.minimum(p.max(1), 1.0), 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")).mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score). Texts that are null or have no letter, and all if no language could be learned, are ``und`` with score 0. Repeated rows are labelled alike; a null doc_id counts as not held out; no rows give none."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return identified(docs, trained(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
