"""Bulk-synchronous best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lean, shared_dir, table, tuned, written

LENGTH = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids a Python worker remembers at once, and characters of a word that is remembered.
CACHE_WORDS, WORD = 600_000, 64
#: Words encoded in one call.
SOME = 10_000
#: Text that is tokenised at once, in bytes; at least one text.
SLICE = 4 << 20
#: Size ranges that are swept apart in each round; the round over a single range comes last.
RANGES = (16, 8, 4, 2)
#: The sequences that a piece of more than half the length opens are numbered size * OPENED + rank.
OPENED = 1 << 44
PIECES = "row long, doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"
RUNS = "kind int, size long, first long, many long, sequence long, at long"

_encoders: dict[str, WordIds] = {}


class WordIds:
    """Ids of texts by a byte-level tokenizer, through a bounded store of the words seen.

    A pre-token always ends before a single space between two characters that are not white space. So texts are cut
    there, each distinct word of a slice is looked up or encoded once, and the ids of the texts are gathered by word
    number. Texts with any other space, at an end or beside white space, are encoded whole, as are texts that hold one
    of the tokenizer's added tokens, for those are found before words are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.pieces = sorted({p for t in self.added for p in t.split(" ") if p})
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True  # a space, as the vocabulary writes it
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, each after a space; number of ids of each). No word is empty or has white space at an end, so a token begins with a space where a word does."""
        # What the tokenizer returns is far larger than the ids, so some words at a time.
        parts = [self.whole([" " + " ".join(words[i : i + SOME])])[0] for i in range(0, len(words), SOME)]
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])
        return ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word, -1 where it has white space at an end or nothing; ids and sizes of what is numbered)."""
        odd = pc.or_(pc.equal(words, ""), pc.not_equal(pc.utf8_trim_whitespace(words), words)).to_numpy(zero_copy_only=False) | holds(words, self.pieces)
        get, listed = self.index.get, words.to_pylist()
        found = np.fromiter((get(w, -1) for w in listed), np.int64, len(listed))
        unknown = np.flatnonzero((found < 0) & ~odd)
        new = [listed[i] for i in unknown]
        ids, size = self.spaced(new)
        found[unknown] = np.arange(len(self.size), len(self.size) + len(new))
        all_ids, all_size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        if len(self.index) + len(new) > CACHE_WORDS and 2 * len(new) > len(listed):
            self.forget()  # other words than before
        short = np.array([len(w) <= WORD for w in new], bool)
        short[max(0, CACHE_WORDS - len(self.index)) :] = False
        stay = [w for w, s in zip(new, short, strict=True) if s]
        self.index.update(zip(stay, range(len(self.size), len(self.size) + len(stay)), strict=True))
        self.ids, self.size = np.concatenate([self.ids, ids[np.repeat(short, size)]]), np.concatenate([self.size, size[short]])
        return found, all_ids, all_size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their offsets)."""
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy().astype(np.int64)
        first = np.zeros(at[-1] + 1, bool)
        first[at[:-1]] = True
        first, many = first[:-1], np.diff(at)
        coded = split.values.dictionary_encode()
        found, ids, size = self.numbers(coded.dictionary)
        word = found[coded.indices.to_numpy()]
        # A word alone, or without white space at its end before the next, is encoded as it stands.
        odd = np.bincount(np.repeat(np.arange(len(many)), many)[word < 0], minlength=len(many)) > 0
        odd |= holds(texts, self.added)
        heads = split.values.filter(pa.array(first))
        own = self.whole(pc.if_else(pa.array(odd), texts, heads).to_pylist())
        kept = ~np.repeat(odd, many) | first
        word = np.where(first, len(size) + np.cumsum(first) - 1, word)[kept]
        many = np.where(odd, 1, many)
        ids, size = np.concatenate([ids, *own]), np.concatenate([size, [len(x) for x in own]]).astype(np.int64)
        long_ = size[word]
        ends = np.cumsum(long_)
        begin = np.cumsum(size) - size
        gathered = ids[np.repeat(begin[word] - (ends - long_), long_) + np.arange(ends[-1] if len(ends) else 0)]
        return gathered, np.append(0, ends)[np.append(0, np.cumsum(many))]


def holds(texts: pa.Array, strings: list[str]) -> np.ndarray:
    """Whether each text has any of the strings in it."""
    out = np.zeros(len(texts), bool)
    for s in strings:
        out |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    return out


def encoder(name: str) -> WordIds:
    """One for each Python worker."""
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = WordIds(str(public_tokenizers.path(name)))
    return _encoders[name]


def slices(batches, most: int = SLICE):
    """(doc_ids, texts) of runs of rows with at most ``most`` bytes of text, or one longer text; null is empty. Batches are put together, for the more text, the more of its words recur."""
    held, size = [], 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).fill_null("")
        ends, i = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
        while i < len(texts):
            before = ends[i - 1] if i else 0
            j = int(np.searchsorted(ends, before + most - size, "right"))
            if j == i and not held:
                j = i + 1
            if j > i:
                held.append((ids.slice(i, j - i), texts.slice(i, j - i)))
                size, i = size + int(ends[j - 1] - before), j
            if i < len(texts):
                yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each piece of each document: its ids and then id 0, cut from the end so that only the first is shorter.

    ``row`` numbers the rows of documents. ``part`` is the task and ``rank`` the piece's number among those
    of its length there, so a length's pieces can be numbered throughout by adding the counts of earlier parts.
    """

    def cut(batches):
        words, part, ranks = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        row = part << 33
        for docs, texts in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            ids, off = words.encode(texts)
            raw, off = ids.astype("<u4").tobytes(), off.tolist()
            for k, doc in enumerate(docs.to_pylist()):
                coded = raw[4 * off[k] : 4 * off[k + 1]] + b"\0\0\0\0"
                n = len(coded) // 4
                first = (n - 1) % length + 1
                for p, start in enumerate([0, *range(first, n, length)]):
                    size = length if p else first
                    crc = zlib.crc32(coded[4 * start : 4 * (start + size)])
                    for column, v in zip(out, (row, doc, p, start, size, crc, part, ranks[size]), strict=True):
                        column.append(v)
                    ranks[size] += 1
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, KINDS, strict=True)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(lean(cut), PIECES)


NAMES = [x.split()[0] for x in PIECES.split(", ")]
KINDS = [pa.int32() if x.endswith(" int") else pa.int64() for x in PIECES.split(", ")]


def best_fit(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], length: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(size, first rank, number, first sequence, gap before) of each run placed, and the pieces and gaps left over.

    Pieces of one size and sequences of one gap are alike, so both come and go as runs (size, first, number). The
    sweep takes pieces longest first and goes from each size upwards to its successor among the gaps. Pieces that want
    the same gap are told apart by rank, one to a sequence; what they leave is a gap again. Pieces without a successor
    stay over, or open new sequences, numbered from 0, if a ``length`` is given.
    """
    placed, left, opened = [], [], 0
    held: dict[int, list] = defaultdict(list)
    for gap, first, many in sorted(gaps):
        held[gap].append((first, many))
    order = sorted(held)

    def give(gap: int, first: int, many: int) -> None:
        if gap:
            if not held[gap]:
                bisect.insort(order, gap)
            held[gap].append((first, many))

    for size, rank, many in sorted(pieces, reverse=True):
        while many:
            i = bisect.bisect_left(order, size)
            if i < len(order):
                gap = order[i]
                first, there = held[gap].pop()
                if not held[gap]:
                    del order[i]
            elif length:
                gap, first, there = length, opened, -(-many // (length // size))
                opened += there
            else:
                left.append((size, rank, many))
                break
            here = min(many, there)
            placed.append((size, rank, here, first, gap))
            give(gap - size, first, here)
            if there > here:
                give(gap, first + here, there - here)
            rank, many = rank + here, many - here
    return placed, left, [(gap, *run) for gap in order for run in held[gap]]


def swept(runs: DataFrame, ranges: int, length: int = LENGTH) -> DataFrame:
    """The runs after one round: pieces (kind 0) and gaps (kind 1) are dealt into ranges of size, each range is swept by a task of its own, and what was placed becomes kind 2."""

    def sweep(t: pa.Table) -> pa.Table:
        have = [list(zip(*(t.filter(pc.equal(t["kind"], k))[c].to_pylist() for c in ("size", "first", "many")), strict=True)) for k in (0, 1)]
        placed, left, gaps = best_fit(*have)
        rows = [(0, *r, 0, 0) for r in left] + [(1, *r, 0, 0) for r in gaps] + [(2, *r[:4], length - r[4]) for r in placed]
        return pa.table({c: pa.array(v, k) for (c, k), v in zip(RUN_TYPES.items(), zip(*rows, strict=True) if rows else [[]] * 6, strict=True)})

    band = F.floor((F.col("size") - 1) * ranges / length)
    return runs.groupBy(band.alias("band")).applyInArrow(sweep, RUNS)


RUN_TYPES = {"kind": pa.int32(), "size": pa.int64(), "first": pa.int64(), "many": pa.int64(), "sequence": pa.int64(), "at": pa.int64()}


def planned(counts: DataFrame, length: int = LENGTH) -> np.ndarray:
    """(size, first rank, number, first sequence, offset) of every run of pieces, given (length, many) of those below ``length``.

    No two pieces of more than half the length fit together, so each opens a sequence. Then rounds: ranges of sizes
    are swept side by side, the gaps and pieces that are left are dealt out anew into fewer and wider ranges, and a
    last sweep over all sizes opens what sequences are still wanted. It runs on the driver: runs are bounded by the
    sequence length, not by the number of documents.
    """
    size, none = F.col("length").cast("long"), F.lit(0).cast("long")
    runs = counts.select(F.lit(0).alias("kind"), size.alias("size"), none.alias("first"), F.col("many"), none.alias("sequence"), none.alias("at"))
    large = runs.where(f"2 * size > {length}")
    opened = large.withColumn("kind", F.lit(2)).withColumn("sequence", F.col("size") * OPENED)
    gaps = large.select(F.lit(1).alias("kind"), (length - F.col("size")).alias("size"), (F.col("size") * OPENED).alias("first"), "many", none.alias("sequence"), none.alias("at"))
    state = written(runs.where(f"2 * size <= {length}").union(gaps).union(opened))
    placed = [state.where("kind = 2")]
    for ranges in RANGES:
        state = written(swept(state.where("kind < 2"), ranges, length))
        placed.append(state.where("kind = 2"))
    left = [[tuple(r) for r in state.where(F.col("kind") == k).select("size", "first", "many").collect()] for k in (0, 1)]
    rows = [(r.size, r.first, r.many, r.sequence, r.at) for part in placed for r in part.toArrow().to_pandas().itertuples()]
    last, _, _ = best_fit(*left, length)
    plan = np.array([*rows, *((*r[:4], length - r[4]) for r in last)] or [(0, 0, 0, 0, 0)], np.int64)
    return plan[np.lexsort((plan[:, 1], plan[:, 0]))]


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    Null and empty texts are one token, id 0. A null doc_id stays null; repeated rows are packed each for itself;
    other columns are ignored; no documents give no rows. A sequence's pieces lie gapless from offset 0. Runs of equal
    pieces reach the driver, rows never do; the plan that is sent out is bounded by ``length``. Full pieces need no gap and get negative sequence ids from their part and rank.
    """
    spark = tuned(docs.sparkSession)
    path = shared_dir(spark)
    pieces(docs, length, tokenizer).write.option("compression", "zstd").parquet(path)
    cut = spark.read.parquet(path)
    by_part = cut.where(F.col("length") < length).groupBy("length", "part").count()
    by_part = by_part.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    sent = spark.sparkContext.broadcast(planned(by_part.groupBy("length").agg(F.sum("count").alias("many")), length))

    def place(batches):
        plan = sent.value
        wide = np.int64(1) << 44
        keys = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            size, rank, part = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "nth", "part"))
            at = np.searchsorted(keys, size * wide + rank, "right") - 1
            full = size >= length
            sequence = np.where(full, -1 - ((part << np.int64(33)) + rank), plan[at, 3] + rank - plan[at, 1])
            offset = np.where(full, 0, plan[at, 4])
            kept = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            kept[3] = kept[3].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = cut.join(by_part.select("length", "part", "base"), ["length", "part"], "left").withColumn("nth", F.col("rank") + F.coalesce("base", F.lit(0)))
    return numbered.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict[str, str] = {}
