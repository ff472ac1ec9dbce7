"""Injection of planned edits into documents, in order, with labels of what was done; facts to edit; distractors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.lineage import written
from tessera.operators.audit import parsed
from tessera.operators.sampling import uniform

#: Why an edit fails.
NOT_FOUND, NO_DOCUMENT = "original_text not found in document", "missing document"
#: Why an answer gives no edit or distractor, where the call itself had no error.
NO_EDIT, NO_DESCRIPTION = "no edit in the answer", "no description in the answer"
#: Pieces of a text that are held apart before they are joined again.
PIECES = 256
APPLIED = "doc_id {id}, place long, ok boolean, char_start long, char_end long, last_start long, last_end long, content string"


def chosen_fact(facts: DataFrame, key: list[str], order: str, seed: int) -> DataFrame:
    """One of each key's facts, each with the same chance: that of least hash of seed, key and ``order``."""
    place = uniform(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in [*key, order]]))
    first = facts.groupBy(*key).agg(F.min(F.struct(place.alias("_at"), order, F.struct(*[c for c in facts.columns if c not in key]).alias("_fact"))).alias("_x"))
    return first.select(*key, "_x._fact.*")


def planned(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits (doc_id, place, old, new, line), answers without one (doc_id, place, reason)) of ``answers`` (doc_id, place, scope, answer, error): JSON, in a fence or not, with ``original_text`` and ``modified_text`` within a document, and with ``modified_text`` and ``insertion_paragraph`` (0 if missing) across documents."""
    rows = parsed(answers, "original_text string, modified_text string, insertion_paragraph long")
    across = F.col("scope") == "inter_doc"
    sound = F.col("items.modified_text").isNotNull() & (across | F.col("items.original_text").isNotNull())
    rows = rows.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    line = F.when(across, F.coalesce("items.insertion_paragraph", F.lit(0)))
    edits = rows.where("_sound").select("doc_id", "place", F.when(~across, F.col("items.original_text")).alias("old"), F.col("items.modified_text").alias("new"), line.alias("line"))
    return edits, rows.where("not _sound").select("doc_id", "place", F.coalesce("error", F.lit(NO_EDIT)).alias("reason"))


def distractors(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels (case_id, place, scope, divergence_type, document_references, description), answers without one (case_id, place, reason)) of ``answers`` (case_id, place, scope, divergence, refs, answer, error): JSON with a ``description``; the type is the one that was asked for. Documents stay as they are."""
    rows = parsed(answers, "description string")
    labels = rows.where("items.description is not null").select("case_id", "place", "scope", F.col("divergence").alias("divergence_type"), F.col("refs").alias("document_references"), "items.description")
    return labels, rows.where("items.description is null").select("case_id", "place", F.coalesce("error", F.lit(NO_DESCRIPTION)).alias("reason"))


class Text:
    """A text in pieces, so that an edit copies the piece that it falls in alone."""

    def __init__(self, content: str):
        self.pieces = [content]

    def find(self, what: str) -> int:
        """Where ``what`` first stands, in characters, or -1."""
        before, tail = 0, ""
        for p in self.pieces:
            at = (tail + p[: len(what) - 1]).find(what) if tail and what else -1
            if at >= 0:
                return before - len(tail) + at
            at = p.find(what)
            if at >= 0:
                return before + at
            before += len(p)
            tail = (tail + p)[1 - len(what) :] if len(what) > 1 else ""
        return -1

    def line_end(self, line: int) -> int:
        """Behind the newline of line number ``line`` (from 0; less counts as 0), or the text's end."""
        left, before = max(0, line) + 1, 0
        for p in self.pieces:
            many = p.count("\n")
            if many >= left:
                at = -1
                for _ in range(left):
                    at = p.index("\n", at + 1)
                return before + at + 1
            left, before = left - many, before + len(p)
        return before

    def splice(self, at: int, size: int, new: str) -> None:
        """Puts ``new`` in place of ``size`` characters at ``at``."""
        out, before, done = [], 0, False
        for p in self.pieces:
            a, b = at - before, at + size - before
            if not done and a <= len(p):
                out += [p[:a], new]
                done = True
            elif not done or b <= 0:
                out.append(p)
                a = b = len(p)
            out.append(p[max(b, 0) :])
            before += len(p)
        self.pieces = [p for p in out if p] or [""]
        if len(self.pieces) > PIECES:
            self.pieces = ["".join(self.pieces)]

    def whole(self) -> str:
        return "".join(self.pieces)


class Edits:
    """The edits of one document so far: where each stood when it was made, and where later ones have moved it."""

    def __init__(self, content: str | None):
        self.text = None if content is None else Text(content)
        self.rows: list[tuple[int, bool, int | None, int | None]] = []
        self.spans = np.zeros((0, 3), np.int64)  # row number, start and end now; one that was edited again has none
        self.live = 0

    def moved(self, at: int, size: int, new: int) -> None:
        s = self.spans[: self.live]
        behind, before = s[:, 1] >= at + size, s[:, 2] <= at
        s[behind, 1:] += new - size
        kept = s[behind | before]
        self.spans[: len(kept)], self.live = kept, len(kept)

    def apply(self, place: int, old: str | None, new: str | None, line: int | None) -> None:
        text, new = self.text, "" if new is None else new
        if line is not None and text is not None:
            new = f" {new.strip()} "
            at, size = text.line_end(line), 0
            start = at
        elif text is None or old is None or (at := text.find(old)) < 0:
            self.rows.append((place, False, None, None))
            return
        else:
            size, start = len(old), None
        text.splice(at, size, new)
        self.moved(at, size, len(new))
        start = text.find(new) if start is None else start
        self.rows.append((place, True, start, start + len(new)))
        if self.live == len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros((max(16, self.live), 3), np.int64)])
        self.spans[self.live] = (len(self.rows) - 1, at, at + len(new))
        self.live += 1

    def done(self) -> tuple[list, list]:
        """(the rows; where each edit's text is now, None where a later edit cut it)."""
        last: list = [None] * len(self.rows)
        for r, a, b in self.spans[: self.live].tolist():
            last[r] = (a, b)
        return self.rows, last


def applied(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The edits of ``plan`` (doc_id, place, old, new, line) made in ``docs`` (doc_id, content), each in the text that the ones before it left.

    An edit with a ``line`` inserts ``new``, stripped and with a space on each side, behind that line; others replace
    the first ``old``, and fail where there is none. Rows with a place are edits: ok, the span that the edit had when it
    was made (a replacement's is where the new text first stands), and ``last_start`` and ``last_end``, where the
    text that it put in stands in the end, null if a later edit cut it. Rows without a place are the documents with
    their final content.

    A document is followed by its edits in one sorted partition and folded as rows come, so only one document's text
    and spans are held at a time. Edits of documents that are missing, and edits without ``old`` and ``line``, fail; a
    null ``new`` is empty; of edits with one place that with the lesser old, new, line comes first. Documents with a
    null content have it empty if they are inserted into or not; a doc_id has to be unique and not null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.select("doc_id", F.lit(0).alias("side"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("old"), F.coalesce("content", F.lit("")).alias("new"), F.lit(None).cast("long").alias("line"))
    both = both.unionByName(plan.select(F.col("doc_id").cast(kind).alias("doc_id"), F.lit(1).alias("side"), F.col("place").cast("long").alias("place"), "old", "new", F.col("line").cast("long").alias("line")))
    columns = ["doc_id", "side", "place", "old", "new", "line"]

    def run(batches):
        name, held = None, None
        schema = pa.schema([("place", pa.int64()), ("ok", pa.bool_()), *[(c, pa.int64()) for c in ("char_start", "char_end", "last_start", "last_end")], ("content", pa.string())])

        def out(ids: pa.DataType):
            rows, last = held.done()
            found = [{"place": p, "ok": ok, "char_start": a, "char_end": b, "last_start": x and x[0], "last_end": x and x[1]} for (p, ok, a, b), x in zip(rows, last, strict=True)]
            if held.text is not None:
                found.append({"content": held.text.whole()})
            batch = pa.RecordBatch.from_pylist(found, schema)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(found), ids), *batch.columns], names=["doc_id", *schema.names])

        for batch in batches:
            ids = batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, side, place, old, new, line = row
                if held is None or doc != name or side == 0:
                    if held is not None:
                        yield out(ids)
                    name, held = doc, Edits(new if side == 0 else None)
                if side:
                    held.apply(place, old, new, line)
        if held is not None:
            yield out(ids)

    return both.repartition("doc_id").sortWithinPartitions(*columns).mapInArrow(run, APPLIED.format(id=kind))


def injected(docs: DataFrame, plan: DataFrame, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents after all edits; labels of the edits that were made): ``applied``, written once. Labels have the plan's columns, the span of the edit and whether later edits made that span ``stale``. The numbers of edits that were made and that failed are metrics of that pass, in ``seen``."""
    made = applied(docs, plan)
    if seen is not None:
        made = made.observe(seen, F.count_if("ok").alias("made"), F.count_if(~F.col("ok")).alias("failed"))
    made = written(made)
    texts = made.where("place is null").select("doc_id", "content")
    spans = made.where("ok").select("doc_id", "place", "char_start", "char_end", "last_start", "last_end")
    labels = plan.join(spans, ["doc_id", "place"])
    stale = ~(F.col("char_start").eqNullSafe(F.col("last_start")) & F.col("char_end").eqNullSafe(F.col("last_end")))
    return texts, labels.withColumn("stale", stale)


def rationale(mechanism: Column, source: Column, scope: Column) -> Column:
    """Fixed wording of a label's rationale."""
    return F.when(scope == "inter_doc", F.concat(mechanism, F.lit(" applied: fact from document "), source)).otherwise(F.concat(mechanism, F.lit(" applied to fact in document "), source))


def failures(made: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, place, reason) of the edits in ``applied``'s rows that failed."""
    lost = made.where("not ok").select("doc_id", "place").join(docs.select("doc_id", F.lit(True).alias("there")), "doc_id", "left")
    return lost.select("doc_id", "place", F.when(F.col("there"), NOT_FOUND).otherwise(NO_DOCUMENT).alias("reason"))
