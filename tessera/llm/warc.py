"""WARC archives: written from pages with revisit records, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, sized, table, tuned, written

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads of fewer bytes are stored each time.
REVISIT_BYTES = 1000
#: Records of an archive file at most, bytes of a url that is written, and bytes of a record in which its head ends.
RECORDS, URL_BYTES, HEAD_BYTES = 10_000, 32_768, 65_536
DATE = "2020-01-01T00:00:00Z"
NAMED = "page_id long, url string, record_type string, refers_to long, named string, named_bytes long"
#: A segment: the bytes between two magics, the n-th of a byte range (``block``) of an archive; its head's length (null where it has none) and the payload's length, and the payload's digest where the segment holds all of it.
SEGMENT = f"archive string, block long, n long, size long, ends boolean, body long, length long, digest string, {NAMED}"
CHAINED = f"archive string, offset long, body long, length long, digest string, {NAMED}, parts array<struct<block: long, n: long>>"
HEADER = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)


def header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload another of a larger page_id has too."""
    keys = written(pages.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest"))
    shared = written(keys.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return written(keys.join(sized(shared), "payload_digest").where("page_id <> refers_to").distinct())


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, its length in bytes and its SHA-1."""
    out = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    return out.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})


def write_warc(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Archives of a record for each row of ``pages`` (page_id, url, html), as files of whole records under ``path``.

    A null html is an empty payload. Of equal payloads of ``least`` bytes or more, the record of the largest page_id
    is a response and the others are revisits that refer to it and hold no payload; rows that repeat that page_id are
    responses too, as are those with a null page_id. Line breaks in a url are left out; a null url has no header, nor
    has one of over URL_BYTES bytes, so that every head ends within HEAD_BYTES.
    A record is the head, an empty line and the payload; the writer's line separator is the record's end, so any
    store that Spark writes to will do. No pages leave no records. Other columns are ignored.
    """
    pages = payloads(pages)
    rows = pages.join(sized(revisits(pages, least)), ["page_id", "payload_digest"], "left")
    stored = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    record = F.concat(
        F.lit(MAGIC.decode()),
        header("WARC-Type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", F.when(F.octet_length("url") <= URL_BYTES, F.regexp_replace("url", "[\r\n]", ""))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(stored).cast("string")),
        F.lit("\r\n"),
        stored,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path)


def reachable(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Which records the chain from offset 0 reaches, by pointer jumping: each round marks the successors of what is marked and doubles the length of all jumps."""
    n = len(starts)
    at = np.minimum(np.searchsorted(starts, nexts), n)
    jump = np.append(np.where((at < n) & (starts[np.minimum(at, n - 1)] == nexts), at, n), n) if n else np.zeros(1, np.int64)
    marked = np.append(starts == 0, False)
    while True:
        more = marked.copy()
        more[jump[marked]] = True
        more[n] = False
        if (more == marked).all():
            return marked[:n]
        marked, jump = more, jump[jump]


def page_number(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def arrow(kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of the columns that a schema string names."""
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<struct<block: long, n: long>>": pa.list_(pa.struct([("block", pa.int64()), ("n", pa.int64())]))}
    named = [x.split(" ", 1) for x in re.split(r", (?![^<]*>)", kinds)]
    columns = zip(*rows, strict=True) if rows else [[]] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(archive, block, value): the bytes between magics. The reader gives each task byte ranges of archives, and a segment to the task in whose range it begins."""
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return raw.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def numbered(batches):
    """(archive, block, n, value) of each segment; a byte range's segments come in order."""
    last, n = None, 0
    for batch in batches:
        for archive, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n = n + 1 if (archive, block) == last else 0
            last = (archive, block)
            yield archive, block, n, value.as_py()


def headed(value: bytes) -> tuple:
    """What a segment holds as a row of SEGMENT, from size on. It is the beginning of a candidate record if a head with a length ends within HEAD_BYTES."""
    end = END.encode()
    body = value.find(end, 0, HEAD_BYTES)
    found = dict(HEADER.findall(value[:body].replace(b"\r", b""))) if body >= 0 else {}
    size = found.get(b"Content-Length", b"")
    if not size.isdigit():
        return (len(value), value.endswith(end), *[None] * 9)
    body, length, named = body + len(end), int(size), found.get(b"X-Payload-Length", b"")
    whole = body + length <= len(value)
    url, kind = found.get(b"WARC-Target-URI"), found.get(b"WARC-Type", b"").decode("utf-8", "replace")
    return (
        len(value), value.endswith(end), body, length, hashlib.sha1(value[body : body + length]).hexdigest() if whole else None,
        page_number(found.get(b"WARC-Record-ID")), url and url.decode("utf-8", "replace"), kind, page_number(found.get(b"WARC-Refers-To")),
        found.get(b"WARC-Payload-Digest", b"").decode("utf-8", "replace").removeprefix("sha1:"), int(named) if named.isdigit() else 0,
    )


def heads(batches):
    rows = []
    for archive, block, n, value in numbered(batches):
        rows.append((archive, block, n, *headed(value)))
        if len(rows) == 2000:
            yield arrow(SEGMENT, rows)
            rows = []
    yield arrow(SEGMENT, rows)


def chain(t: pa.Table) -> pa.Table:
    """The records of one archive that the chain of boundaries reaches from its start, each with the segments that it covers.

    A candidate's successor is where its head, length and end say that the next record begins; it stands only if a
    segment ends there, with the mark of a record's end.
    """
    rows = t.sort_by([("block", "ascending"), ("n", "ascending")])
    size = rows["size"].to_numpy()
    # Before the first magic there is a segment too, of no bytes in an archive that begins with a record.
    ends = np.cumsum(size + len(MAGIC)) - len(MAGIC)
    starts = ends - size - len(MAGIC)
    body, length = (rows[c].fill_null(-1).to_numpy() for c in ("body", "length"))
    nexts = starts + len(MAGIC) + body + length + len(END)
    at = np.searchsorted(ends, nexts)
    stop = np.minimum(at, len(ends) - 1)
    sound = (body >= 0) & (starts >= 0) & (ends[stop] == nexts) & rows["ends"].to_numpy(zero_copy_only=False)[stop]
    sound = np.flatnonzero(sound)
    block, n = rows["block"].to_pylist(), rows["n"].to_pylist()
    kept = sound[reachable(starts[sound], nexts[sound])]
    out = rows.take(pa.array(kept)).select(["archive", "body", "length", "digest", *[x.split()[0] for x in NAMED.split(", ")]])
    out = out.add_column(1, "offset", pa.array(starts[kept]))
    parts = [[{"block": block[k], "n": n[k]} for k in range(i, at[i] + 1)] for i in kept]
    return out.append_column("parts", pa.array(parts, pa.list_(pa.struct([("block", pa.int64()), ("n", pa.int64())]))))


def joined(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """(archive, offset, payload, digest) of ``records``, put together from the segments that each covers."""

    def values(batches):
        for archive, block, n, value in numbered(batches):
            yield arrow("archive string, block long, n long, value binary", [(archive, block, n, value)])

    def put(batches):
        for batch in batches:
            rows = []
            for archive, offset, body, length, parts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                payload = MAGIC.join(p["value"] for p in sorted(parts, key=lambda p: p["pos"]))[body : body + length]
                rows.append((archive, offset, payload, hashlib.sha1(payload).hexdigest()))
            yield arrow("archive string, offset long, payload binary, digest string", rows)

    wanted = records.select("archive", "offset", "body", "length", F.posexplode("parts").alias("pos", "part"))
    wanted = wanted.select("archive", "offset", "body", "length", "pos", "part.*")
    found = segments(spark, path).mapInArrow(values, "archive string, block long, n long, value binary").join(wanted, ["archive", "block", "n"])
    found = found.groupBy("archive", "offset", "body", "length").agg(F.collect_list(F.struct("pos", "value")).alias("parts"))
    return found.mapInArrow(put, "archive string, offset long, payload binary, digest string")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``: archive, offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact and the payload (null if not wanted).

    Tasks take byte ranges and emit a slim row for each place where a record may begin; the chain of boundaries is
    followed over these rows, archive by archive, by pointer jumping. Only records that the chain from the file's start
    reaches count, whatever payloads hold; it ends at a record that is not followed by another or by the file's end.
    Length and digest are the payload's own for a response and, for a revisit, those that it names. ``intact`` tells
    whether a response's digest is the one named. An archive that does not begin with a record gives none.
    """
    tuned(spark)
    chained = written(written(segments(spark, path).mapInArrow(heads, SEGMENT)).groupBy("archive").applyInArrow(chain, CHAINED))
    apart = chained if payload else chained.where("size(parts) > 1")
    if apart.limit(1).count():
        whole = joined(spark, path, apart).withColumnRenamed("digest", "own")
        chained = chained.join(whole, ["archive", "offset"], "left")
    else:
        chained = chained.withColumn("own", F.lit(None).cast("string")).withColumn("payload", F.lit(None).cast("binary"))
    own, response = F.coalesce("own", "digest"), F.col("record_type") != "revisit"
    return chained.select(
        "archive", "offset", "page_id", "url", "record_type", "refers_to",
        F.when(response, F.col("length")).otherwise(F.col("named_bytes")).alias("payload_bytes"),
        F.when(response, own).otherwise(F.col("named")).alias("payload_digest"),
        (~response | (own == F.col("named"))).alias("intact"),
        F.col("payload") if payload else F.lit(None).cast("binary").alias("payload"),
    )


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc_round_trip": op1_warc_round_trip}
ORACLES = {
    "op1_warc_round_trip": f"""
    with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
    q as (select *, max(page_id) over (partition by payload_digest) as last from p)
    select page_id, payload_bytes, payload_digest,
           case when payload_bytes >= {REVISIT_BYTES} and page_id <> last then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= {REVISIT_BYTES} and page_id <> last then last end as refers_to
    from q"""
}
