"""Windows of clicks against a fold row by row."""

import datetime
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np

from tessera.llm import clickdedup as c

CLICKS = "click_id long, ts timestamp, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour string, batch int"
EPOCH = datetime.datetime(1970, 1, 1)


def micros(t):
    return None if t is None else (t - EPOCH) // datetime.timedelta(microseconds=1)


def brute(rows, batches):
    text = lambda x: "" if x is None else str(x)
    copies = []
    for click, ts, arrived, client, kind, value, props in rows:
        for j in range(click % 3 + 1) if click is not None and arrived is not None else ():
            crc = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (crc % 10)
            cents = "" if value is None else str(math.floor(100 * value + 0.5))
            digest = hashlib.sha256("|".join((text(client), text(kind), cents, text(micros(ts)), text(props), str(crc % 3))).encode()).hexdigest()
            copies.append((hour + crc // 10 % 200, click, hour, digest))
    if not copies:
        return []
    low, high = min(x[0] for x in copies), max(x[0] for x in copies)
    by, out, opened, most = defaultdict(list), [], {}, None
    for lag, *row in copies:
        by[(lag - low) * batches // (high - low + 1)].append(tuple(row))
    for b in range(batches):
        for click, hour, digest in sorted(by[b]):
            if most is not None and hour < most - 48:
                continue
            w = opened.get(click)
            if w and hour <= w[1] + 72:
                w[3] += 1
                if digest != w[6]:
                    w[4], w[5] = w[4] + 1, w[5] + zlib.crc32(digest.encode())
            else:
                if w:
                    out.append((*w[:2], b, *w[3:]))
                opened[click] = [click, hour, b, 0, 0, 0, digest]
        most = max([x[1] for x in by[b]] + ([] if most is None else [most]), default=None)
        for click in list(opened):
            if b == batches - 1 or (most is not None and opened[click][1] + 72 < most - 48):
                w = opened.pop(click)
                out.append((*w[:2], b, *w[3:]))
    return sorted(out)


def clicks(rng, n):
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        at = start + datetime.timedelta(hours=rng.randrange(900), microseconds=rng.choice((0, 3_599_999_999)))
        # A third has one click_id.
        rows.append((rng.choice((5, rng.randrange(60), rng.randrange(60))), rng.choice((None, at)), at, rng.choice((None, 1)), rng.choice((None, "view")), rng.choice((None, 0.005, 1.115, -2.5)), rng.choice((None, '{"a": "|"}'))))
    return rows + rows[:20] + [(None, start, start, 1, "x", 1.0, ""), (3, start, None, 1, "x", 1.0, "")]


def test_windows(spark):
    rows = clicks(random.Random(2), 300)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], CLICKS)
    got = c.deduplicated(c.copies(df), batches=5, rows_a_shard=100, least_shards=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_empty_batches_and_one_instant(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start, start, 1, "x", 1.0, "") for i in (3, 3, 6)] + [(9, start, start + datetime.timedelta(hours=4000), 1, "x", 1.0, "")]
    got = c.deduplicated(c.copies(spark.createDataFrame([(*r, "", 1) for r in rows], CLICKS)), batches=3, least_shards=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3)


def test_no_clicks(spark):
    assert not c.deduplicated(c.copies(spark.createDataFrame([], CLICKS))).count()


def test_a_fold_is_that_of_single_rows():
    rng = random.Random(4)
    for _ in range(200):
        opened, want, closed = c.Windows.none(), {}, []
        mine: list[c.Windows] = []
        for _ in range(3):
            rows = sorted((rng.randrange(4), rng.randrange(200), rng.randrange(3), rng.randrange(1, 3)) for _ in range(rng.choice((1, 2, 9, 30))))
            cols = [np.array(x, np.int64) for x in zip(*rows, strict=True)]
            digest = np.zeros((len(rows), 4), np.uint64)
            digest[:, 3] = cols[2]
            gone, opened = c.folded(opened, cols[0], cols[1], digest, cols[2] + 10, cols[3], 50)
            opened = c.Windows.unpacked(opened.packed())
            mine.append(gone)
            for i, hour, h, n in rows:
                w = want.get(i)
                if not w or hour > w[1] + 50:
                    if w:
                        closed.append(tuple(w))
                    w = want[i] = [i, hour, -1, 0, 0, h]
                w[2] += n
                w[3] += n * (h != w[5])
                w[4] += n * (h != w[5]) * (h + 10)
        got = [tuple(int(x) for x in r) for w in mine for r in zip(*w.columns[:5], w.digest[:, 3], strict=True)]
        assert sorted(got) == sorted(closed)
        assert [tuple(int(x) for x in r) for r in zip(*opened.columns[:5], opened.digest[:, 3], strict=True)] == sorted(map(tuple, want.values()))
