"""Removal of long strings that occur more than once, by hash-compared suffix sorting of the texts around shared anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, byte_slices, lean, mix, sized, table, tuned, written
from tessera.llm.shingles import between, prefix

LENGTH, GRAM = 400, 32
#: Contexts of an anchor's group that are sorted in one task; the windows of a larger group are dealt out as rows.
WHOLE = 4096
#: Context bytes that a task sorts at once, whole groups at least.
SORTED_BYTES = 2 << 20
#: Bits of a place in a buffer, and bytes of a text that are searched at once; longer texts are cut into overlapping pieces.
PLACE = 21
PIECE = 1 << 19
ANCHOR = "key binary, tag long, h long, span long, span2 long, p int, a int, b int"
FOUND = "key binary, tag long, a int, e int"


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, gram hash, anchor, first window, last window) of each anchor, in bytes of ``buf`` (2**PLACE at most).

    Each window of ``length`` bytes selects the gram of least hash in it, the leftmost of equal ones, so equal windows
    select equal places wherever they stand; windows in a row that select one place are one anchor. The span of an
    anchor reaches from its first window's start to its last window's end.
    """
    n, wide = len(buf), length - gram + 1
    empty = np.zeros(0, np.int64)
    start = np.flatnonzero(np.diff(off) >= length)
    if not len(start):
        return empty, empty.astype(U64), empty, empty, empty
    at = np.arange(n - gram + 1)
    h = mix(between(prefix(buf), at, at + gram))
    low = (U64(1) << U64(PLACE)) - U64(1)
    v = np.concatenate([(h & ~low) | at.astype(U64), np.full(-len(h) % wide, ~U64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(behind[: n - length + 1], ahead[wide - 1 : n - length + wide]) & low).astype(np.int64)
    s = np.concatenate([np.arange(off[d], off[d + 1] - length + 1) for d in start])
    doc = np.repeat(start, np.diff(off)[start] - length + 1)
    p = chosen[s]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])]))
    a, b, p, doc = s[new], s[np.append(new[1:], len(s)) - 1], p[new], doc[new]
    return doc, h[p], p, a, b


def digest(data: bytes, place: int = 0) -> bytes:
    """A cryptographic digest of bytes and a place in them: where two are equal, so are the bytes."""
    return hashlib.blake2b(data, digest_size=16, salt=place.to_bytes(8, "little")).digest()


class Collision(Exception):
    """Bytes differ where hashes agree."""


class Contexts:
    """Spans of anchors laid end to end, with prefix hashes: how far two of them agree, on from their anchors or back from them, is a binary search over hash comparisons. What hashes say is held against the bytes by ``verify``; ``exact`` compares bytes throughout."""

    def __init__(self, spans: list[bytes], p: np.ndarray):
        self.buf = np.frombuffer(b"".join(spans), np.uint8)
        size = np.array([len(s) for s in spans], np.int64)
        self.first = np.cumsum(size) - size
        self.at, self.end = self.first + p, self.first + size
        self.pre, self.exact = prefix(self.buf), False

    def room(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        return np.minimum(self.at[i] - self.first[i], self.at[j] - self.first[j]) if back else np.minimum(self.end[i] - self.at[i], self.end[j] - self.at[j])

    def agree(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the common extension of rows i and j from their anchors on, or backwards from them."""
        low, high = np.zeros(len(i), np.int64), self.room(i, j, back)
        while self.exact and (open_ := np.flatnonzero(low < high)).size:
            same = self.byte(i[open_], low[open_], back) == self.byte(j[open_], low[open_], back)
            low[open_[same]] += 1
            high[open_[~same]] = low[open_[~same]]
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            x, y = self.at[i], self.at[j]
            same = between(self.pre, x - mid, x) == between(self.pre, y - mid, y) if back else between(self.pre, x, x + mid) == between(self.pre, y, y + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def byte(self, i: np.ndarray, n: np.ndarray, back: bool) -> np.ndarray:
        """The byte after an extension by ``n``."""
        return self.buf[np.clip(self.at[i] - n - 1 if back else self.at[i] + n, 0, len(self.buf) - 1)]

    def verify(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, back: bool) -> None:
        """Raises Collision unless rows i and j agree in ``n`` bytes and no more."""
        if self.exact or not len(i):
            return
        some = max(1, (1 << 20) // LENGTH)
        for k in range(0, len(i), some):
            size = n[k : k + some]
            row = np.repeat(np.arange(k, k + len(size)), size)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            if (self.byte(i[row], nth, back) != self.byte(j[row], nth, back)).any():
                raise Collision
        if ((n < self.room(i, j, back)) & (self.byte(i, n, back) == self.byte(j, n, back))).any():
            raise Collision

    def less(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Whether the suffix (or the reversed prefix) of row i stands before that of row j; of equal ones neither does."""
        n = self.agree(i, j, back)
        full = n >= self.room(i, j, back)
        long_i, long_j = (self.at[k] - self.first[k] if back else self.end[k] - self.at[k] for k in (i, j))
        return np.where(full, long_i < long_j, self.byte(i, n, back) < self.byte(j, n, back))

    def sorted(self, group: np.ndarray, rows: np.ndarray, back: bool) -> np.ndarray:
        """``rows`` in order of group and suffix. Groups ascend. Bottom-up merges of runs of doubling width; in each, an element's place is its rank in its own run and, by binary search, in the one beside."""
        group, order = group[rows], rows
        head = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - head
        nth, width = np.arange(len(rows)) - head, 1
        while width < size.max(initial=0):
            run = nth // width
            other = np.where(run % 2 == 0, run + 1, run - 1) * width
            low, high = np.minimum(other, size), np.minimum(other + width, size)
            begin = low.copy()
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                mid = (low[k] + high[k]) // 2
                mine, its = order[k], order[head[k] + mid]
                # Equal suffixes keep the order of their runs.
                past = np.where(run[k] % 2 == 0, self.less(its, mine, back), ~self.less(mine, its, back))
                low[k], high[k] = np.where(past, mid + 1, low[k]), np.where(past, high[k], mid)
            place = head + (run // 2) * 2 * width + (nth - run * width) + (low - begin)
            merged = np.full_like(order, -1)
            merged[place] = order
            if merged.min() < 0:  # comparisons that contradict each other
                raise Collision
            order, width = merged, 2 * width
        return order

    def neighbours(self, group: np.ndarray, rows: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """(``rows`` in order, how far each agrees with the next of its group, 0 at a group's end), held against the bytes."""
        order = self.sorted(group, rows, back)
        i, j = order[:-1], order[1:]
        same = np.flatnonzero(group[i] == group[j])
        near = np.zeros(len(order), np.int64)
        near[same] = self.agree(i[same], j[same], back)
        self.verify(i[same], j[same], near[same], back)
        n = near[same]
        full = n >= self.room(i[same], j[same], back)
        if (~full & (self.byte(i[same], n, back) > self.byte(j[same], n, back))).any():
            raise Collision
        return order, near


def extents(c: Contexts, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far back and on from its anchor each row reaches with windows that another row of its group has too; 0 and 0 without one.

    A window's bytes before the anchor and those after it must agree with the same row. How far a row agrees with any
    other is read off its neighbours in suffix order, and in order of reversed prefixes; only rows for which the two
    add up to a window are looked at further. In suffix order the agreement can only fall with the distance between
    rows, so neighbours are scanned outwards, both ways, until it can't make up a window with what may stand before.
    """
    rows, far = np.arange(len(group)), []
    for way in (True, False):
        order, near = c.neighbours(group, rows, way)
        most = np.zeros(len(group), np.int64)
        most[order] = np.maximum(near, np.append(0, near[:-1]))
        far.append(most)
    back, on = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    rows = np.flatnonzero(far[0] + far[1] >= length)
    if not len(rows):
        return back, on
    order, near = c.neighbours(group, rows, False)
    g = group[order]
    for way in (1, -1):
        k = np.arange(len(order))
        least, step = np.full(len(order), 1 << 40), 0
        while len(k):
            step += way
            k = k[(k + step >= 0) & (k + step < len(order))]
            k = k[g[k] == g[k + step]]
            least[k] = np.minimum(least[k], near[k + step - 1] if way > 0 else near[k + step])
            k = k[least[k] + far[0][order[k]] >= length]
            i, j = order[k], order[k + step]
            before = c.agree(i, j, back=True)
            hit = np.flatnonzero((before + least[k] >= length) & ((before > back[i]) | (least[k] > on[i])))
            i, j, x, y = i[hit], j[hit], before[hit], least[k][hit]
            c.verify(i, j, x, True)
            back[i], on[i] = np.maximum(back[i], x), np.maximum(on[i], y)
    return back, on


def repeated(spans: list[bytes], p: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) in each span of the bytes in windows that another span of its group has too; equal where there are none. If any hash proves wrong, all comparisons are made again on the bytes."""
    c = Contexts(spans, p)
    try:
        back, on = extents(c, group, length)
    except Collision:
        c.exact = True
        back, on = extents(c, group, length)
    return np.where(on > 0, p - back, 0), np.where(on > 0, p + on, 0)


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def find_anchors(texts: DataFrame, piece: int = PIECE) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, _, whole, ends in byte_slices(batch.column(2), piece):
                # Pieces overlap by less than a window, so each window lies in one of them.
                for first in range(0, max(1, len(whole) - LENGTH + 1), piece - LENGTH + 1):
                    buf = whole[first : first + piece]
                    off = ends if len(ends) > 2 else np.array([0, len(buf)])
                    doc, h, p, a, b = anchors(buf, off)
                    raw = buf.tobytes()
                    span = np.frombuffer(b"".join(digest(raw[x : z + LENGTH], y - x) for x, y, z in zip(a.tolist(), p.tolist(), b.tolist(), strict=True)), np.int64).reshape(-1, 2)
                    row, own = pa.array(i + doc), off[doc] - first
                    ints = [pa.array((x - own).astype(np.int32)) for x in (p, a, b)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(h.view(np.int64)), pa.array(span[:, 0]), pa.array(span[:, 1]), *ints], names=["key", "tag", "h", "span", "span2", "p", "a", "b"])

    return texts.select("key", "tag", "text").mapInArrow(lean(run), ANCHOR)


def cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, tag, h, members, a, p, context): the spans' bytes."""

    def run(batches):
        for batch in batches:
            for key, tag, text, spots in zip(*(batch.column(k) for k in range(4)), strict=True):
                raw, spots = text.as_py().encode(), spots.as_py()
                cut = [raw[x["a"] : x["b"] + LENGTH] for x in spots]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(spots), pa.binary()), pa.array([tag.as_py()] * len(spots), pa.int64()), pa.array([x["h"] for x in spots], pa.int64()), pa.array([x["members"] for x in spots], pa.int64()), pa.array([x["a"] for x in spots], pa.int32()), pa.array([x["p"] - x["a"] for x in spots], pa.int32()), pa.array(cut, pa.binary())],
                    names=["key", "tag", "h", "members", "a", "p", "context"],
                )

    spots = wanted.groupBy("key", "tag").agg(F.collect_list(F.struct("h", "members", "p", "a", "b")).alias("spots"))
    return texts.join(spots, ["key", "tag"]).select("key", "tag", "text", "spots").mapInArrow(lean(run), "key binary, tag long, h long, members long, a int, p int, context binary")


def in_groups(contexts: DataFrame) -> DataFrame:
    """(key, tag, a, e): repeated bytes of each context, group by group. A task gets whole groups in order and sorts some at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table):
            if not len(t):
                return
            h = t.column("h").to_numpy()
            group = np.cumsum(np.append(0, h[1:] != h[:-1]))
            low, high = repeated(t.column("context").to_pylist(), t.column("p").to_numpy().astype(np.int64), group)
            some = np.flatnonzero(high > low)
            a = t.column("a").to_numpy()[some]
            t = t.select(["key", "tag"]).take(pa.array(some))
            t = t.append_column("a", pa.array((a + low[some]).astype(np.int32))).append_column("e", pa.array((a + high[some]).astype(np.int32)))
            yield from t.combine_chunks().to_batches()

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("context").nbytes
            if size > SORTED_BYTES:
                t = pa.Table.from_batches(held)
                h = t.column("h").to_numpy()
                last = int(np.searchsorted(h, h[-1]))  # the last group may go on
                yield from done(t.slice(0, last))
                held, size = t.slice(last).combine_chunks().to_batches(), t.slice(last).column("context").nbytes
        if held:
            yield from done(pa.Table.from_batches(held))

    parted = contexts.drop("members").repartition("h").sortWithinPartitions("h")
    return parted.select("key", "tag", "h", "a", "p", "context").mapInArrow(lean(run), FOUND)


def in_windows(contexts: DataFrame) -> DataFrame:
    """The same for groups too large for one task: a row for each window, by its digest and its place before the anchor."""

    def run(batches):
        for batch in batches:
            for key, tag, h, a, p, context in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                many = len(context) - LENGTH + 1
                w = [digest(context[s : s + LENGTH], p - s) for s in range(many)]
                one = lambda x, t: pa.array([x] * many, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one(key, pa.binary()), one(tag, pa.int64()), one(h, pa.int64()), one(a, pa.int32()), pa.array(range(many), pa.int32()), pa.array(w, pa.binary())], names=["key", "tag", "h", "a", "s", "w"])

    every = written(contexts.select("key", "tag", "h", "a", "p", "context").mapInArrow(lean(run), "key binary, tag long, h long, a int, s int, w binary"))
    twice = every.groupBy("h", "w").count().where("count > 1").select("h", "w")
    hit = every.join(twice, ["h", "w"]).groupBy("key", "tag", "a").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    return hit.select("key", "tag", (F.col("a") + F.col("low")).cast("int").alias("a"), (F.col("a") + F.col("high") + LENGTH).cast("int").alias("e"))


def removed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256) of the texts with repeated bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw, parts, at, spans, last = text.as_py().encode(), [], 0, 0, -1
                for x in sorted((x["a"], x["e"]) for x in found.as_py()):
                    if x[0] > last:
                        parts.append(raw[at : x[0]])
                        spans += 1
                    last = at = max(at, x[1])
                parts.append(raw[at:])
                kept = b"".join(parts)
                out.append((len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            n, s, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256"])

    by_text = found.groupBy("key", "tag").agg(F.collect_list(F.struct("a", "e")).alias("found"))
    return texts.join(by_text, ["key", "tag"]).select("key", "text", "found").mapInArrow(lean(run), "key binary, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated) of each row: every byte that a string of ``LENGTH`` bytes covers which starts anywhere else too is removed.

    Equal texts go once through the search and lose all their bytes if there are ``LENGTH`` of them. Of the others,
    windows select anchors, and only anchors found twice go on. Where all the spans of an anchor are equal by digest of
    their bytes, or one of them recurs, it is repeated as a whole. One of each of the other spans is cut out and
    brought together by anchor; there a suffix sort by hash comparison, verified on the bytes, finds what they share.
    Groups of over ``whole`` such spans are dealt out by window instead. Texts over ``piece`` bytes are searched in pieces that
    overlap, so that each window lies in one. Null counts as empty, texts shorter than ``LENGTH``
    lose nothing, repeated rows are copies of each other, null doc_ids are kept as they are, no rows give none;
    other columns are ignored.
    """
    tuned(docs.sparkSession)
    docs = docs.select("doc_id", "text").withColumn("key", text_key()).withColumn("tag", F.coalesce("doc_id", F.lit(0)))
    long_ = docs.where(F.octet_length("text") >= LENGTH)
    copies = written(long_.groupBy("key").agg(F.min("tag").alias("tag"), F.count("*").alias("n")).where("n > 1"))
    spare = long_.select("key", "tag").join(sized(copies.select("key", F.col("tag").alias("first"))), "key").where("tag <> first").select("key", "tag").distinct()
    once = long_.select("key", "tag", "text").join(sized(written(spare)), ["key", "tag"], "left_anti")
    found = written(find_anchors(once, piece))
    shared = written(found.groupBy("h").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("span", "span2") for f in (F.min, F.max)]).where("n > 1"))
    shared = shared.select("h", F.expr("span_min = span_max and span2_min = span2_max").alias("alike"))
    again = written(found.join(sized(shared), "h"))
    kinds = again.where("not alike").groupBy("h", "span", "span2").agg(F.count("*").alias("n"), F.min(F.struct("key", "tag", "p", "a", "b")).alias("one"))
    kinds = written(kinds)
    members = kinds.groupBy("h").agg(F.count("*").alias("members"), F.min("n").alias("least")).where("least = 1")
    wanted = written(kinds.join(members, "h").select("h", "members", "one.*"))
    entire = again.where("alike").select("key", "tag", "a", "b").union(again.where("not alike").join(kinds.where("n > 1").select("h", "span", "span2"), ["h", "span", "span2"]).select("key", "tag", "a", "b"))
    entire = entire.select("key", "tag", "a", (F.col("b") + LENGTH).cast("int").alias("e"))
    contexts = written(cut_out(once, wanted))
    parts = in_groups(contexts.where(F.col("members") <= whole))
    if contexts.where(F.col("members") > whole).limit(1).count():
        parts = parts.union(in_windows(contexts.where(F.col("members") > whole)))
    gone = written(removed(once, written(entire.union(parts))))
    slim = docs.select("doc_id", "key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("own"))
    out = slim.join(sized(gone.dropDuplicates(["key"])), "key", "left").join(sized(copies.select("key", "n")), "key", "left")
    copied = F.col("n").isNotNull()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    ).withColumn("repeated", F.col("n_removed") > 0)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict[str, str] = {}
