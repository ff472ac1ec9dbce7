"""Documents that repeat passages of a benchmark: every suffix of a test text is looked up in suffix arrays of the documents' words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, byte_slices, lean, mix, table, tuned, written

WINDOW = 10
#: Bytes of test texts that are looked up in one pass, and words of documents in one suffix array.
BLOCK_BYTES, SHARD_WORDS = 8 << 20, 1 << 20
SHARD_BYTES = 4 << 20
#: Places that are looked at at once, and bytes from which a word goes by a digest.
AT_ONCE, LONG_WORD = 1 << 22, 128
FOUND = "array<struct<item: string, item_word: int, doc_word: int, n: int>>"
#: Letters and digits of a word in lower case (A-Z only); 0 for ASCII that parts words.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


class Words:
    """The words of many texts one after another, as numbers, with a 0 after each text's last."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.low = np.concatenate([FOLD[buf], np.zeros(8, np.uint8)])
        inside = self.low[: len(buf)] != 0
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        self.start = np.flatnonzero(inside & ~np.append(False, inside[:-1]) | inside & edge[:-1])
        self.size = np.flatnonzero(inside & ~np.append(inside[1:], False) | inside & edge[1:]) + 1 - self.start
        self.first = np.searchsorted(self.start, off)  # word number with which each text begins
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.base = self.first + np.arange(len(off))  # the same in ``ids``
        self.ids = np.zeros(len(self.start) + len(off), U64)
        self.ids[np.arange(len(self.start)) + self.text] = self.numbers()

    def numbers(self) -> np.ndarray:
        """A number for each word, never 0: up to 8 bytes one to one, beyond that a hash."""
        eights = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))
        part = lambda at, size: eights[at] & (~U64(0) >> (U64(8) * (U64(8) - np.clip(size, 1, 8).astype(U64))))
        h = mix(part(self.start, self.size))
        more, k = np.flatnonzero((self.size > 8) & (self.size <= LONG_WORD)), 8
        while len(more):
            h[more] = mix(h[more] ^ part(self.start[more] + k, self.size[more] - k) ^ U64(k))
            k += 8
            more = more[self.size[more] > k]
        for i in np.flatnonzero(self.size > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.low[self.start[i] : self.start[i] + self.size[i]].tobytes(), digest_size=8).digest(), "little")
        return np.maximum(h, U64(1))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The text that holds a place of ``ids``."""
        return np.searchsorted(self.base, at, "right") - 1

    def bytes_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, size) of the words at places of ``ids``."""
        word = at - self.text_of(at)
        return self.start[word], self.size[word]


def ranges(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, nth) for each of ``size`` elements of each row."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` in order of their suffixes' first ``depth`` words or more, by doubling: each round sorts the suffixes that are still alike by the rank of what follows."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    key = rank * (n + 1) + np.append(rank[1:] + 1, 0)
    order = np.argsort(key)
    place, key, h = np.arange(n), key[order], 2
    rank[order] = head = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), place, 0))
    while h < depth:
        new = np.append(head[1:] != head[:-1], True)
        tied = np.flatnonzero(~(new & np.append(True, new[:-1])))
        if not len(tied):
            break
        some = order[tied]
        key = head[tied] * (n + 1) + np.where(some + h < n, rank[np.minimum(some + h, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[tied], key = some[by], key[by]
        head[tied] = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), tied, 0))
        rank[order[tied]] = head[tied]
        h *= 2
    return order


class Tests:
    """Test texts and the suffixes that begin a window: ``WINDOW`` words, or all words of a shorter text."""

    def __init__(self, texts: pa.Array):
        _, _, buf, off = next(byte_slices(texts, 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        self.words = w = Words(buf, off)
        count = np.diff(w.first)
        self.wide = np.minimum(count, WINDOW)
        self.text, nth = ranges(np.where(count > 0, count - self.wide + 1, 0))
        self.at = w.base[self.text] + nth
        self.size = self.wide[self.text]
        self.padded = np.append(w.ids, np.zeros(WINDOW, U64))

    def looked_up(self, ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix the first place in ``order`` whose window isn't less than its own, and the first that is greater: binary searches, all in step."""
        out = []
        for past in (False, True):
            low, high = np.zeros(len(self.at), np.int64), np.full(len(self.at), len(order))
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                at, mine, size = order[mid], self.at[open_], self.size[open_]
                state = np.zeros(len(open_), np.int8)  # of the row against the suffix
                same = np.arange(len(open_))
                for k in range(WINDOW):
                    same = same[size[same] > k]
                    if not len(same):
                        break
                    x, y = ids[at[same] + k], self.padded[mine[same] + k]
                    state[same] = np.where(x < y, -1, np.where(x > y, 1, 0))
                    same = same[x == y]
                right = state < 0 if not past else state <= 0
                low[open_[right]] = mid[right] + 1
                high[open_[~right]] = mid[~right]
            out.append(low)
        return out[0], out[1]


def matches(docs: Words, tests: Tests, shard: int = SHARD_WORDS) -> tuple[np.ndarray, ...]:
    """(document, test text, word of the test text, word of the document, words): verbatim matches that hold a window and can't be made longer.

    Documents' words are cut into shards with a suffix array each; binary searches find where each test suffix's window
    stands. Of windows of one match the first is kept and followed as far as the words agree. Numbers of words agree
    where the words do; what they say is held against the words' bytes.
    """
    ids, found = np.append(docs.ids, np.zeros(WINDOW, U64)), []
    other = tests.words
    for s in range(0, len(docs.ids), shard):
        part = ids[s : s + shard + WINDOW - 1]
        order = suffix_array(part, WINDOW)
        low, high = tests.looked_up(np.append(part, np.zeros(WINDOW, U64)), order)
        hit = np.flatnonzero(high > low)
        ends = np.cumsum(high[hit] - low[hit])
        for a in np.unique(np.searchsorted(ends, np.arange(0, ends[-1], AT_ONCE))) if len(hit) else []:
            some = hit[a : np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right") + 1]
            row, nth = ranges(high[some] - low[some])
            at = order[low[some][row] + nth]
            mine, at = some[row][at < shard], s + at[at < shard]
            i = tests.at[mine]
            before = other.ids[i - 1]
            fresh = (before == 0) | (before != ids[at - 1])
            found.append((mine[fresh], at[fresh]))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    mine, at = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
    n, live = tests.size[mine].copy(), np.arange(len(mine))
    i = tests.at[mine]
    while len(live):
        x = tests.padded[i[live] + n[live]]
        live = live[(x != 0) & (x == ids[np.minimum(at[live] + n[live], len(ids) - 1)])]
        n[live] += 1
    i, at, n = verified(docs, other, i, at, n, tests.size[mine])
    text, doc = other.text_of(i), docs.text_of(at)
    return doc, text, i - other.base[text], at - docs.base[doc], n


def verified(docs: Words, other: Words, i, at, n, least) -> tuple[np.ndarray, ...]:
    """Matches whose words are equal byte by byte; where one isn't, the match is cut there and parts of at least ``least`` words stay."""
    bad = np.zeros(len(i), bool)
    unlike: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(i), step := max(1, AT_ONCE // 64)):
        row, nth = ranges(n[a : a + step])
        row += a
        (x, m), (y, k) = docs.bytes_at(at[row] + nth), other.bytes_at(i[row] + nth)
        wrong = m != k
        for first in range(0, len(row), 1 << 16):
            pair, byte = ranges(np.where(wrong, 0, m)[first : first + (1 << 16)])
            pair += first
            wrong[pair[docs.low[x[pair] + byte] != other.low[y[pair] + byte]]] = True
        bad[row[wrong]] = True
        unlike.append((row[wrong], nth[wrong]))
    if not bad.any():
        return i, at, n
    rows, nths = (np.concatenate(x) for x in zip(*unlike, strict=True))
    parts = [(i[~bad], at[~bad], n[~bad])]
    for r in np.flatnonzero(bad):
        cuts = np.concatenate([[-1], np.sort(nths[rows == r]), [n[r]]])
        for a, b in zip(cuts[:-1] + 1, cuts[1:], strict=True):
            if b - a >= least[r]:
                parts.append((np.array([i[r] + a]), np.array([at[r] + a]), np.array([b - a])))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def blocks(items: DataFrame, most: int = BLOCK_BYTES):
    """(item ids, texts) of test texts as Arrow arrays, at most about ``most`` bytes at a time, or one longer text."""
    some = written(items.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).where("item is not null and body is not null"))
    count = -(-(some.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // most)
    count = count if count <= 1 else 2 * count
    for k in range(count):
        t = some.where(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == k).toArrow().combine_chunks()
        if len(t):
            yield t.column("item").combine_chunks(), t.column("body").combine_chunks()


def looked_at(docs: DataFrame, names: pa.Array, texts: pa.Array) -> DataFrame:
    """``docs`` (doc, text, ...) with n_words and what it shares with a block of test texts."""

    def run(batches):
        tests = Tests(texts)
        for batch in batches:
            for i, j, buf, off in byte_slices(batch.column(1), SHARD_BYTES):
                words = Words(buf, off)
                doc, text, item_word, doc_word, n = matches(words, tests)
                order = np.lexsort((item_word, doc_word, doc))
                ints = [pa.array(x[order].astype(np.int32)) for x in (item_word, doc_word, n)]
                rows = pa.StructArray.from_arrays([names.take(pa.array(text[order])).cast(pa.string()), *ints], ["item", "item_word", "doc_word", "n"])
                ends = pa.array(np.searchsorted(doc[order], np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(ends, rows)], names=["doc", "text", "found", "n_words", "more"])

    shape = T.StructType([docs.schema["doc"], docs.schema["text"], docs.schema["found"], T.StructField("n_words", T.LongType()), T.StructField("more", docs.schema["found"].dataType)])
    return docs.select("doc", "text", "found").mapInArrow(lean(run), shape)


def searched(docs: DataFrame, items: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """(doc, n_words, found): each row of ``docs`` (doc, text) with its verbatim matches in test texts: item, the word of the item and of the document where the match begins, and its number of words.

    Words are runs of letters and digits, A-Z in lower case, anything beyond ASCII a letter. A match holds a window:
    ten words of an item, or all of an item of fewer. Items are looked up a block at a time; between blocks the rows are
    written. Null texts have no words; items without an id or text are left out; repeated rows and items count each by
    itself; no documents give none.
    """
    tuned(docs.sparkSession)
    docs, first = docs.select("doc", "text", F.array().cast(FOUND).alias("found")), True
    empty = (pa.array([], pa.string()), pa.array([], pa.string()))
    for names, texts in [*blocks(items, most)] or [empty]:
        docs = docs if first else written(docs)
        docs = looked_at(docs, names, texts).select("doc", "text", F.concat("found", "more").alias("found"), "n_words")
        first = False
    return docs.select("doc", "n_words", "found")


def hit_words(found: Column) -> Column:
    """Words that matches cover, each once; matches in order of their first word."""
    spans = F.array_sort(F.transform(found, lambda m: F.struct(m["doc_word"].cast("long").alias("a"), (m["doc_word"] + m["n"]).cast("long").alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto"))
    step = lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["upto"]))).alias("hit"), F.greatest(s["upto"], x["b"]).alias("upto"))
    return F.aggregate(spans, start, step, lambda s: s["hit"])


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no window with a test text, all columns as they are."""
    return searched(docs.select(F.struct(*docs.columns).alias("doc"), "text"), items).where(F.size("found") == 0).select("doc.*")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id").alias("doc"), "text")
    found = searched(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["item"])))
    found = found.select("doc.doc_id", "n_words", hit_words(F.col("found")).alias("n_hit"), items.alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op11_decontamination": op11_decontamination}
ORACLES: dict[str, str] = {
    "op11_decontamination": r"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    b as (select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
    windows as (select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s from (select item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0)),
    places as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows)) where i > 0),
    hits as (select r, item, i, n from places join windows using (n, s)),
    words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
    items as (select r, list_sort(list(distinct item)) as items from hits group by r)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join words using (r) left join items using (r)""",
}
