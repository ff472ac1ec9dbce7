"""Chunks with exact offsets, names, edits of texts and their verification."""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import sized, written

MAX_WORDS = 800


def segments(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(case_id, doc_ord, pos, start, end, words): paragraphs; where one has more than ``max_words`` words, its lines; where a line has more, batches of its space-separated words.

    A separator stays with what is before it, so the segments joined are the text. Words of a segment are runs between
    white space; a batch counts what single spaces part. Positions follow from running sums of lengths.
    """
    count = lambda c: F.regexp_count(c, F.lit(r"(?U)\S+"))

    def parts(text: Column, sep: str) -> Column:
        pieces = F.split(text, sep, -1)
        return F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(pieces) - 1, F.lit(sep)).otherwise(F.lit(""))))

    def batches(line: Column) -> Column:
        words = F.split(line, " ", -1)
        n = F.ceil(F.size(words) / max_words)
        cut = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.array_join(F.slice(words, (i * max_words + 1).cast("int"), max_words), " "))
        return F.transform(cut, lambda p, i: F.concat(p, F.when(i < n - 1, F.lit(" ")).otherwise(F.lit(""))))

    lines = lambda p: F.flatten(F.transform(parts(p, "\n"), lambda x: F.when(count(x) > max_words, batches(x)).otherwise(F.array(x))))
    cut = F.flatten(F.transform(parts(F.col("content"), "\n\n"), lambda p: F.when(count(p) > max_words, lines(p)).otherwise(F.array(p))))
    w = Window.partitionBy("case_id", "doc_ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = docs.select("case_id", "doc_ord", F.posexplode(F.filter(cut, lambda x: x != "")).alias("pos", "seg"))
    out = out.withColumn("end", F.sum(F.length("seg")).over(w)).withColumn("start", F.col("end") - F.length("seg"))
    return out.select("case_id", "doc_ord", "pos", "start", "end", count(F.col("seg")).alias("words"))


def chunk_rows(done: list, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array([h[0][i] for h in done], t) for i, t in enumerate(types)] + [pa.array([h[i] for h in done], t) for i, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["case_id", "doc_ord", "chunk_index", "char_start", "char_end"])


def chunks(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(case_id, doc_ord, chunk_index, char_start, char_end, word_count): segments filled greedily up to ``max_words`` words; a text of no more is one chunk, an empty one too.

    The fill starts anew after each chunk. Segments are sorted by text and position within partitions and filled as they
    come, so a task holds one chunk's bounds, however long the text.
    """
    total = F.regexp_count("content", F.lit(r"(?U)\S+"))
    small = docs.where(total <= max_words).select("case_id", "doc_ord", F.lit(0).alias("chunk_index"), F.lit(0).cast("bigint").alias("char_start"), F.length("content").cast("bigint").alias("char_end"))
    segs = segments(docs.where(total > max_words), max_words)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("case_id", "doc_ord")}

    def run(batches):
        held = None  # key, number, start, end and words of the chunk that is being filled
        for batch in batches:
            types, done = [c.type for c in batch.columns[:2]], []
            for case, doc, start, end, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == (case, doc) and not (held[4] > 0 and held[4] + words > max_words):
                    held[3:] = end, held[4] + words
                    continue
                if held:
                    done.append(held)
                held = [(case, doc), held[1] + 1 if held and held[0] == (case, doc) else 0, start, end, words]
            yield chunk_rows(done, types)
        if held:
            yield chunk_rows([held], types)

    sorted_ = segs.repartition("case_id", "doc_ord").sortWithinPartitions("case_id", "doc_ord", "pos").select("case_id", "doc_ord", "start", "end", "words")
    large = sorted_.mapInArrow(run, f"case_id {kinds['case_id']}, doc_ord {kinds['doc_ord']}, chunk_index int, char_start bigint, char_end bigint")
    out = small.unionByName(large).join(docs.select("case_id", "doc_ord", "content"), ["case_id", "doc_ord"])
    cut = F.substring("content", F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    return out.select("case_id", "doc_ord", "chunk_index", "char_start", "char_end", F.regexp_count(cut, F.lit(r"(?U)\S+")).alias("word_count"), cut.alias("text"))


def chunk_manifest(found: DataFrame) -> DataFrame:
    """Documents, chunks, and documents of one and of several chunks, by case."""
    per = found.groupBy("case_id", "doc_ord").agg(F.count("*").alias("n"))
    return per.groupBy("case_id").agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple"))


def plain_title(name: Column) -> Column:
    """A file name without number prefix and ending, its underscores as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\d+[-_ ]+", ""), r"\.[A-Za-z0-9]+$", ""), "_", " "))


def safe_name(name: Column, most: int = 100) -> Column:
    return F.left(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]+", "_"), F.lit(most))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def shortened(name: Column, most: int = 50) -> Column:
    return F.when(F.length(name) > most, F.concat(F.left(name, F.lit(most - 3)), F.lit("…"))).otherwise(name)


def replaced_first(docs: DataFrame) -> DataFrame:
    """``docs`` (content, old, new) with the edited text and the span: the first ``old`` becomes ``new``, char_start is where the edited text first has ``new``; a text without ``old`` fails and stays."""
    at = F.expr("instr(content, old)")
    edited = F.when(at > 0, F.expr("concat(substring(content, 1, instr(content, old) - 1), new, substring(content, instr(content, old) + length(old)))")).otherwise(F.col("content"))
    out = docs.withColumn("ok", at > 0).withColumn("edited", edited)
    start = F.when(F.col("ok"), F.expr("instr(edited, new)") - 1)
    return out.withColumn("char_start", start).withColumn("char_end", start + F.length("new"))


def inserted_after_line(docs: DataFrame) -> DataFrame:
    """``docs`` (content, line, new) with ``new``, a space on each side, put behind line number ``line`` (from 0, clamped) and its newline; the span has the spaces."""
    lines = F.split("content", "\n", -1)
    n = F.least(F.greatest(F.col("line"), F.lit(0)), F.size(lines) - 1)
    at = F.least(F.length(F.array_join(F.slice(lines, 1, n + 1), "\n")) + 1, F.length("content"))
    pad = F.concat(F.lit(" "), "new", F.lit(" "))
    out = docs.withColumn("char_start", at).withColumn("char_end", at + F.length(pad))
    return out.withColumn("edited", F.concat(F.expr("substring(content, 1, char_start)"), pad, F.expr("substring(content, char_start + 1)")))


#: Looks for a block by whole runs before a text is searched sign by sign.
LOOKS = 200


class Matcher(difflib.SequenceMatcher):
    """``difflib.SequenceMatcher`` of two texts without junk, with the same blocks. Its longest blocks are sought among the runs of signs that are not popular, longest first and found by a search for their text, instead of sign by sign."""

    def __init__(self, a: str, b: str):
        self.codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        signs, n = np.unique(np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        if len(b) >= 200:
            signs = signs[n <= len(b) // 100 + 1]
        self.rare, self.full = np.isin(self.codes, signs), False
        super().__init__(None, a, b)

    def set_seq2(self, b):
        self.b, self.matching_blocks, self.opcodes, self.fullbcount, self.bjunk = b, None, None, None, set()

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        found = self.longest_run(alo, ahi, blo, bhi)
        if found is None:
            if not self.full:
                b, self.b, self.full = self.b, None, True
                super().set_seq2(b)
            return super().find_longest_match(alo, ahi, blo, bhi)
        i, j, size = found
        back = same(self.a[alo:i][::-1], self.b[blo:j][::-1])
        ahead = same(self.a[i + size : ahi], self.b[j + size : bhi])
        return difflib.Match(i - back, j - back, back + size + ahead)

    def longest_run(self, alo, ahi, blo, bhi):
        """(i, j, size) of the longest text of such signs in both ranges, the first in a, then in b; None after too many looks."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], self.rare[alo:ahi].view(np.int8), [0]))))
        starts, ends = edges[::2] + alo, edges[1::2] + alo
        sizes, looks = ends - starts, 0
        for size in range(int(sizes.max(initial=0)), 0, -1):
            for k in np.flatnonzero(sizes >= size):
                for i in range(int(starts[k]), int(ends[k]) - size + 1):
                    j = self.b.find(self.a[i : i + size], blo, bhi)
                    if j >= 0:
                        return i, j, size
                    looks += 1
                    if looks >= LOOKS:
                        return None
        return alo, blo, 0


def same(a: str, b: str) -> int:
    """The number of signs at the beginning that two texts share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def diff_opcodes(pairs: DataFrame) -> DataFrame:
    """(id, ops): the non-equal opcodes (tag, i1, i2, j1, j2) of the character diff of ``original`` and ``modified``. Equal texts never leave the JVM."""

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out.append([dict(zip(("tag", "i1", "i2", "j1", "j2"), o, strict=True)) for o in Matcher(a, b).get_opcodes() if o[0] != "equal"])
            kind = pa.list_(pa.struct([("tag", pa.string()), *[(k, pa.int32()) for k in ("i1", "i2", "j1", "j2")]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "ops"])

    kind = f"id {pairs.schema['id'].dataType.simpleString()}, ops array<struct<tag: string, i1: int, i2: int, j1: int, j2: int>>"
    changed = pairs.where("original <> modified").select("id", "original", "modified").mapInArrow(run, kind)
    return changed.unionByName(pairs.where("original = modified").select("id", F.array().cast("array<struct<tag: string, i1: int, i2: int, j1: int, j2: int>>").alias("ops")))


def first_modified(labels: DataFrame, originals: DataFrame, modifieds: DataFrame) -> DataFrame:
    """(label_idx, doc_id, missing): the first referenced document whose text was changed; without one, whether some reference has no document."""
    # One row a document: its texts don't travel to the references.
    texts = originals.select("doc_id", F.col("content").alias("o")).join(modifieds.select("doc_id", F.col("content").alias("m")), "doc_id", "full")
    both = F.col("o").isNotNull() & F.col("m").isNotNull()
    return first_flagged(labels, written(texts.select("doc_id", both.alias("both"), (both & (F.col("o") != F.col("m"))).alias("changed"))))


def first_flagged(labels: DataFrame, flags: DataFrame) -> DataFrame:
    """``first_modified`` by (doc_id, both, changed) of documents: whether both texts are there, and differ."""
    refs = labels.select("label_idx", F.posexplode_outer("refs").alias("pos", "doc_id"))
    seen = refs.join(sized(flags), "doc_id", "left")
    return seen.groupBy("label_idx").agg(
        F.min_by("doc_id", F.when(F.col("changed"), F.col("pos"))).alias("first"), F.bool_or(F.when(F.col("changed"), True)).alias("any"), F.bool_or(~F.coalesce("both", F.lit(False))).alias("missing")
    ).select("label_idx", F.when(F.col("any"), F.col("first")).alias("doc_id"), F.coalesce("missing", F.lit(False)).alias("missing"))


#: Fixed value: characters on each side of a change that have to be the same.
CONTEXT = 200


def same_context(original: str, modified: str, i1: str, i2: str, j1: str, j2: str, width: int = CONTEXT) -> Column:
    """Whether ``width`` characters before and after a change, from i1 to i2 and from j1 to j2, are the same in both texts; arguments are SQL."""
    before = lambda t, at: f"substring({t}, greatest(0, {at} - {width}) + 1, least({at}, {width}))"
    after = lambda t, at: f"substring({t}, {at} + 1, {width})"
    return F.expr(f"{before(original, i1)} = {before(modified, j1)} and {after(original, i2)} = {after(modified, j2)}")


def verified(labels: DataFrame, originals: DataFrame, modifieds: DataFrame) -> DataFrame:
    """(label_idx, passed, reason, diff_start, diff_end, discrepancy) by the first rule that rejects: no references, a missing document or no change, more than one change, another context, a label with ``errors`` (if it has that column).

    The diff's span overrides the label's own; where they differ that is a discrepancy, not a failure.
    """
    found = written(first_modified(labels, originals, modifieds))
    wanted = written(found.where("doc_id is not null").select("doc_id").distinct())
    old, new = originals.select("doc_id", F.col("content").alias("original")), modifieds.select("doc_id", F.col("content").alias("modified"))
    pairs = old.join(sized(wanted), "doc_id", "left_semi").join(new.join(sized(wanted), "doc_id", "left_semi"), "doc_id")
    ops = written(diff_opcodes(pairs.withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id"))
    lone = ops.where("size(ops) = 1").select("doc_id", F.col("ops")[0].alias("o"))
    lone = pairs.join(sized(lone), "doc_id").select("doc_id", same_context("original", "modified", "o.i1", "o.i2", "o.j1", "o.j2").alias("clean"))
    # Of a document's changes the number and the first are all that a label asks for.
    ops = sized(written(ops.select("doc_id", F.size("ops").alias("changes"), F.get("ops", F.lit(0)).alias("op")).join(lone, "doc_id", "left")))
    bad = F.size("errors") > 0 if "errors" in labels.columns else F.lit(False)
    x = labels.select("label_idx", (F.size("refs") == 0).alias("bare"), bad.alias("bad"), "char_start", "char_end").join(found, "label_idx").join(ops, "doc_id", "left")
    reason = (
        F.when(F.col("bare"), "no references")
        .when(F.col("doc_id").isNull(), F.when(F.col("missing"), "missing document").otherwise("no difference"))
        .when(F.col("changes") == 0, "no difference")
        .when(F.col("changes") > 1, "more than one difference")
        .when(~F.col("clean"), "changed context")
        .when(F.col("bad"), "invalid label")
    )
    return x.select(
        "label_idx",
        reason.isNull().alias("passed"),
        reason.alias("reason"),
        F.when(reason.isNull(), F.col("op.j1")).alias("diff_start"),
        F.when(reason.isNull(), F.col("op.j2")).alias("diff_end"),
        (reason.isNull() & ((F.col("char_start") != F.col("op.j1")) | (F.col("char_end") != F.col("op.j2")))).alias("discrepancy"),
    )


def cross_validated(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(label_idx, valid): whether the label's text is in any document that it refers to."""
    refs = labels.select("label_idx", "modified_text", F.explode_outer("refs").alias("doc_id")).join(docs.select("doc_id", "content"), "doc_id", "left")
    return refs.groupBy("label_idx").agg(F.coalesce(F.bool_or(F.contains(F.coalesce("content", F.lit("")), "modified_text")), F.lit(False)).alias("valid"))
