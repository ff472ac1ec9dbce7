"""Duplicates of clicks within windows that expire, by a stateful stream: all windows of a shard are one Arrow table in one state value."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.llm.common import shared_dir, table

BATCHES, TTL_HOURS, LATE_HOURS = 12, 72, 48
#: Copies for each shard, over all batches, and the least number of shards.
ROWS_A_SHARD, LEAST_SHARDS = 50_000, 64
HOUR_MS = 3_600_000
FED = "click_id long, hour long, hash binary, crc long, n long, shard int, at timestamp, batch int"
CLOSED = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
BLOB = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("repeats", pa.int64()), ("conflicts", pa.int64()), ("crc", pa.int64()), ("hash", pa.binary(32))])
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores, and new ones at each start: no space set aside, those of ended starts closed soon.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    # A second file beside each file of the checkpoint costs as much as the file.
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


class Windows:
    """Open windows as a struct of arrays in order of id, at most one for an id; packed into one Arrow message."""

    def __init__(self, ids, start, repeats, conflicts, crc, digest):
        self.columns = [ids, start, repeats, conflicts, crc, digest]
        self.ids, self.start, self.repeats, self.conflicts, self.crc, self.digest = self.columns

    @classmethod
    def none(cls) -> Windows:
        return cls(*(np.zeros(0, np.int64) for _ in range(5)), np.zeros((0, 4), np.uint64))

    @classmethod
    def unpacked(cls, blob: bytes) -> Windows:
        batch = pa.ipc.read_record_batch(pa.py_buffer(blob), BLOB)
        ints = [batch.column(k).to_numpy() for k in range(5)]
        return cls(*ints, np.frombuffer(batch.column(5).buffers()[1], ">u8", 4 * len(batch)).reshape(-1, 4).astype(np.uint64))

    def packed(self) -> bytes:
        digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(self.ids), [None, pa.py_buffer(self.digest.astype(">u8").tobytes())])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in self.columns[:5]), digest], schema=BLOB).serialize().to_pybytes()

    def taken(self, rows: np.ndarray) -> Windows:
        return Windows(*(c[rows] for c in self.columns))

    def frame(self, batch: int) -> pd.DataFrame:
        digest = self.digest.astype(">u8").tobytes()
        hashes = [digest[k : k + 32] for k in range(0, len(digest), 32)]
        return pd.DataFrame({"click_id": self.ids, "start_hour": self.start, "closed_batch": np.full(len(self.ids), batch), "n_repeats": self.repeats, "n_conflicts": self.conflicts, "conflict_crc": self.crc, "hash": hashes})


def folded(opened: Windows, ids, hour, digest, crc, n, ttl: int = TTL_HOURS) -> tuple[Windows, Windows]:
    """(windows closed by a row, windows left open) after a batch's rows of a shard; ``n`` equal rows count as one row n times.

    Rows and windows are merged by id. An id's rows are in order of hour and hash. Its open window takes all rows up to
    its deadline; the next row closes it and opens another, and so on, for all ids at once in each step.
    """
    order = np.lexsort((digest[:, 3], digest[:, 2], digest[:, 1], digest[:, 0], hour, ids))
    ids, hour, digest, crc, n = ids[order], hour[order], digest[order], crc[order], n[order]
    each, first = np.unique(ids, return_index=True)
    last = np.append(first[1:], len(ids))
    group = np.repeat(np.arange(len(each)), last - first)
    base = min(hour.min(), opened.start.min(initial=hour.min()))
    wide = np.int64(hour.max() - base + ttl + 2)
    key = group * wide + (hour - base)
    # Merge join of sorted ids: each id's open window, or -1.
    at = np.searchsorted(opened.ids, each)
    has = (at < len(opened.ids)) & (opened.ids[np.minimum(at, len(opened.ids) - 1)] == each) if len(opened.ids) else np.zeros(len(each), bool)
    window = np.where(has, at, -1)
    start = [opened.start]
    opener = [np.full(len(opened.ids), -1)]  # row that opened it
    of = np.full(len(ids), -1)  # window of each row
    closed, live, next_, made = [], np.arange(len(each)), first.copy(), len(opened.ids)
    current = np.where(window >= 0, opened.start[np.maximum(window, 0)] if len(opened.ids) else 0, 0)
    while len(live):
        old = live[window[live] >= 0]
        upto = np.minimum(np.searchsorted(key, old * wide + np.clip(current[old] + ttl - base, -1, wide - 1), "right"), last[old])
        upto = np.maximum(upto, next_[old])
        size = upto - next_[old]
        rows = np.repeat(next_[old] - np.cumsum(size) + size, size) + np.arange(size.sum())
        of[rows] = np.repeat(window[old], size)
        next_[old] = upto
        live = live[next_[live] < last[live]]
        closed.append(window[live][window[live] >= 0])
        window[live], current[live] = made + np.arange(len(live)), hour[next_[live]]
        start.append(current[live])
        opener.append(next_[live])
        made += len(live)
    start, opener, closed = np.concatenate(start), np.concatenate(opener), np.concatenate(closed)
    fresh = opener >= 0
    out = Windows(
        np.append(opened.ids, ids[opener[fresh]]), start, np.append(opened.repeats, np.full(fresh.sum(), -1)), np.append(opened.conflicts, np.zeros(fresh.sum(), np.int64)), np.append(opened.crc, np.zeros(fresh.sum(), np.int64)), np.concatenate([opened.digest, digest[opener[fresh]]])
    )
    np.add.at(out.repeats, of, n)
    unlike = np.flatnonzero((digest != out.digest[of]).any(axis=1))
    np.add.at(out.conflicts, of[unlike], n[unlike])
    np.add.at(out.crc, of[unlike], n[unlike] * crc[unlike])
    gone = np.zeros(made, bool)
    gone[closed] = True
    left = out.taken(np.flatnonzero(~gone))
    return out.taken(np.flatnonzero(gone)), left.taken(np.argsort(left.ids, kind="stable"))


class Deduplicator(StatefulProcessor):
    """Folds a batch's rows of a shard into its blob; a timer at the earliest deadline calls shards without rows.

    The watermark that a start finds is the one that the batch ``previous`` left: deadlines it has passed are masked
    out before rows are folded, and count as closed after that batch. Rows behind it are dropped here, for Spark drops
    only what the watermark before it had passed. From ``end`` on it has passed every deadline of
    the last batch.
    """

    def __init__(self, batch: int, previous: int, end: int, ttl: int = TTL_HOURS):
        self.batch, self.previous, self.end, self.ttl = batch, previous, end, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blob = handle.getValueState("windows", "blob binary")

    def read(self) -> Windows:
        return Windows.unpacked(bytes(self.blob.get()[0])) if self.blob.exists() else Windows.none()

    def deadline(self, windows: Windows) -> int:
        return int(windows.start.min() + self.ttl) * HOUR_MS

    def rewrite(self, before: int | None, windows: Windows) -> None:
        """The blob, and one timer at its earliest deadline."""
        after = self.deadline(windows) if len(windows.ids) else None
        if before is not None and before != after:
            self.handle.deleteTimer(before)
        if after is None:
            self.blob.clear()
            return
        self.blob.update((windows.packed(),))
        if before != after:
            self.handle.registerTimer(after)

    def expired(self, windows: Windows, watermark: int) -> tuple[list[pd.DataFrame], Windows]:
        passed = (windows.start + self.ttl) * HOUR_MS <= watermark
        closed = windows.taken(np.flatnonzero(passed))
        return [closed.frame(self.batch if watermark >= self.end else self.previous)] * bool(passed.any()), windows.taken(np.flatnonzero(~passed))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        frames = [f for f in (x[x["click_id"].notna() & (x["hour"] * HOUR_MS > watermark)] if watermark else x[x["click_id"].notna()] for x in rows) if len(f)]
        if not frames:
            return
        f = pd.concat(frames, ignore_index=True)
        opened = self.read()
        before = self.deadline(opened) if len(opened.ids) else None
        out, opened = self.expired(opened, watermark)
        digest = np.frombuffer(b"".join(f["hash"]), ">u8").reshape(-1, 4).astype(np.uint64)
        closed, left = folded(opened, *(f[c].to_numpy(np.int64) for c in ("click_id", "hour")), digest, *(f[c].to_numpy(np.int64) for c in ("crc", "n")), self.ttl)
        self.rewrite(before, left)
        yield from out
        if len(closed.ids):
            yield closed.frame(self.batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened = self.read()
        if len(opened.ids):
            out, left = self.expired(opened, timerValues.getCurrentWatermarkInMs())
            # The timer that fired goes by itself; the shard has no other.
            self.rewrite(None, left)
            yield from out

    def close(self) -> None:
        pass


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; times without a zone are UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def copies(clicks: DataFrame) -> DataFrame:
    """(click_id, hour, lag, hash, crc): copies j = 0 to click_id % 3 of each click; ``lag`` is when the copy is sent. Clicks without an id or a time of arrival have none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    some = clicks.select("click_id", "client_id", "kind", "value", "props", utc_micros(clicks, "ts").alias("us"), utc_micros(clicks, "arrived_at").alias("arrived_us"))
    some = some.where("click_id is not null and arrived_us is not null").withColumn("j", F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int"))))
    some = some.withColumn("c", F.crc32(F.concat_ws(":", "click_id", "j").cast("binary")))
    hour = F.expr("(arrived_us - pmod(arrived_us, 3600000000)) div 3600000000 + 6 * j * (c % 10)")
    cents = F.coalesce(F.floor(F.col("value") * 100 + 0.5).cast("string"), F.lit(""))
    digest = F.sha2(F.concat_ws("|", text("client_id"), text("kind"), cents, text("us"), text("props"), (F.col("c") % 3).cast("string")).cast("binary"), 256)
    some = some.select("click_id", hour.alias("hour"), F.expr("c div 10 % 200").alias("delay"), digest.alias("digest"))
    return some.select("click_id", "hour", (F.col("hour") + F.col("delay")).alias("lag"), F.unhex("digest").alias("hash"), F.crc32(F.col("digest").cast("binary")).alias("crc"))


def staged(rows: DataFrame, path: str, batches: int, rows_a_shard: int, least_shards: int) -> int:
    """Writes copies under ``path`` by batch; the hour of a last row far ahead of all times, without an id, that moves the watermark past every deadline. Equal copies of a batch are one row with their count, so a click that recurs doesn't grow its group."""
    ends = rows.agg(F.min("lag").alias("low"), F.max("lag").alias("high"), F.max("hour").alias("hour"), F.count("*").alias("n")).first()
    if not ends.n:
        return 0
    far = ends.hour + 10_000
    shards = max(least_shards, -(-ends.n // rows_a_shard))
    rows = rows.withColumn("batch", F.expr(f"(lag - ({ends.low})) * {batches} div ({ends.high - ends.low + 1})").cast("int"))
    rows = rows.groupBy("batch", "click_id", "hour", "hash", "crc").agg(F.count("*").alias("n")).withColumn("shard", F.pmod(F.xxhash64("click_id"), F.lit(shards)).cast("int"))
    end = rows.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (("click_id", "long"), ("hash", "binary"), ("crc", "long"), ("n", "long"))], F.lit(far).alias("hour"), F.lit(0).alias("shard"), F.lit(batches - 1).alias("batch"))
    rows = rows.unionByName(end).withColumn("at", F.timestamp_seconds(F.col("hour") * 3600))
    rows.select("click_id", "hour", "hash", "crc", "n", "shard", "at", "batch").write.option("compression", "zstd").partitionBy("batch").parquet(path)
    return far


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder of the shared file system; False if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(source)):
        return False
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved")
    return True


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]):
    """The session with ``conf``, which is taken back at the end."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def deduplicated(rows: DataFrame, batches: int = BATCHES, ttl: int = TTL_HOURS, late: int = LATE_HOURS, rows_a_shard: int = ROWS_A_SHARD, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """(click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash): the windows of ``copies``.

    Copies are cut into ``batches`` by their ``lag`` and fed in order to a stream that is started anew for each on one
    checkpoint. The watermark lies ``late`` hours behind the greatest hour of earlier batches, which the checkpoint
    keeps from start to start: rows behind it are dropped, and deadlines and timers that it has passed close windows.
    A step without rows after the last batch closes the rest.
    Shards are as many as the rows ask for. Copies of one click in a batch that differ in hour or hash are folded
    together in its shard's task; equal ones arrive as one row. Rows that repeat are repeats like others; no rows give
    none; a batch may be empty; extra columns are ignored.
    """
    spark = rows.sparkSession
    top = shared_dir(spark)
    waiting, feed, checkpoint, out = (f"{top}/{x}" for x in ("waiting", "feed", "checkpoint", "closed"))
    end = (staged(rows, waiting, batches, rows_a_shard, least_shards) - late) * HOUR_MS - 1
    previous = 0
    for batch in range(batches):
        if not moved(spark, f"{waiting}/batch={batch}", f"{feed}/batch={batch}"):
            continue
        with configured(spark, STATE | {"spark.sql.streaming.noDataMicroBatches.enabled": str(batch == batches - 1).lower()}):
            stream = spark.readStream.schema(FED).parquet(feed).drop("batch")
            # A millisecond more: what lies at the watermark itself counts as passed.
            stream = stream.withWatermark("at", f"{late} hours 1 millisecond").groupBy("shard")
            closed = stream.transformWithStateInPandas(statefulProcessor=Deduplicator(batch, previous, end, ttl), outputStructType=CLOSED, outputMode="append", timeMode="EventTime")
            query = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        previous = batch
    if not end > 0:
        return spark.createDataFrame([], CLOSED.replace("hash binary", "hash string"))
    return spark.read.schema(CLOSED).parquet(out).withColumn("hash", F.lower(F.hex("hash")))


def op13_click_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(copies(table(spark, sf_dir, "clicks")))


QUERIES = {"op13_click_dedup": op13_click_dedup}
ORACLES: dict[str, str] = {
    # crc32 by its table of 256 remainders, a byte at a time.
    "op13_click_dedup": r"""with recursive poly as (select b, b as x, 0 as i from range(0, 256) t(b) union all select b, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i + 1 from poly where i < 8),
    crc as (select list(x order by b) as r from poly where i = 8),
    j as (select *, unnest(range(0, click_id % 3 + 1)) as j from clicks where click_id is not null and arrived_at is not null),
    c as (select j.*, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(click_id || ':' || j, '.'), lambda s: ascii(s)::bigint)), lambda a, b: xor(a >> 8, r[(xor(a, b) & 255) + 1])), 4294967295) as c from j, crc),
    h as (select click_id, epoch_us(arrived_at) // 3600000000 + 6 * j * (c % 10) as hour, c // 10 % 200 as delay,
      sha256(concat_ws('|', coalesce(client_id::varchar, ''), coalesce(kind, ''), coalesce(floor(100 * value + 0.5)::bigint::varchar, ''), coalesce(epoch_us(ts)::varchar, ''), coalesce(props, ''), (c % 3)::varchar)) as hash from c),
    b as (select *, ((hour + delay - min(hour + delay) over ()) * 12 // (max(hour + delay) over () - min(hour + delay) over () + 1)) as batch from h),
    most as (select batch, max(max(hour)) over (order by batch rows between unbounded preceding and 1 preceding) as m, max(max(hour)) over (order by batch) as upto from (select batch, hour from b union all select unnest(range(0, 12)), null) group by batch),
    seq as (select b.*, row_number() over (partition by click_id order by b.batch, hour, hash) as k from b join most using (batch) where b.batch = 0 or m is null or hour >= m - 48),
    -- The batch after which a window that starts at some hour closes.
    ends as (select start, coalesce(min(batch), 11) as closes from (select distinct hour as start from seq) left join most on start + 72 < upto - 48 and batch < 11 group by start),
    late as (select start, batch, min(closes) as closes from (select e.start, o.batch, n.batch as closes from ends e, (select unnest(range(0, 12)) as batch) o, most n where n.batch >= o.batch and (n.batch = 11 or e.start + 72 < n.upto - 48)) group by all),
    walk as (select click_id, k, batch, hour, hash, k as opener, hour as start, batch as opened from seq where k = 1
      union all select s.click_id, s.k, s.batch, s.hour, s.hash, case when keep then opener else s.k end, case when keep then start else s.hour end, case when keep then opened else s.batch end
      from (select w.click_id, w.opener, w.start, w.opened, s.k, s.batch, s.hour, s.hash, s.hour <= w.start + 72 and s.batch <= l.closes as keep from walk w join seq s on s.click_id = w.click_id and s.k = w.k + 1 join late l on l.start = w.start and l.batch = w.opened) s),
    win as (select click_id, opener, any_value(start) as start, any_value(opened) as opened, count(*) - 1 as n_repeats from walk group by all),
    nxt as (select click_id, opener, lead(opened) over (partition by click_id order by opener) as next from win),
    odd as (select w.click_id, w.opener, count(*) as n_conflicts, sum(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(w.hash, '.'), lambda s: ascii(s)::bigint)), lambda a, b: xor(a >> 8, r[(xor(a, b) & 255) + 1])), 4294967295))::bigint as conflict_crc
      from walk w join seq s on s.click_id = w.click_id and s.k = w.opener cross join crc where w.hash <> s.hash group by all)
    select w.click_id, w.start as start_hour, least(l.closes, coalesce(next, 11))::bigint as closed_batch, n_repeats, coalesce(n_conflicts, 0) as n_conflicts, coalesce(conflict_crc, 0) as conflict_crc, s.hash
    from win w join nxt using (click_id, opener) join late l on l.start = w.start and l.batch = w.opened join seq s on s.click_id = w.click_id and s.k = w.opener left join odd o on o.click_id = w.click_id and o.opener = w.opener""",
}
