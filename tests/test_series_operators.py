import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators.regular_grid import missing_steps, regular_grid
from gridloom.operators.trailing import DAY_NS, doubling_windows, silent_windows, trailing_totals
from gridloom.streaming.live import sliding

BLOCK = "block_id long, series_id long, samples array<struct<timestamp_ns: long, value: double>>, written_at timestamp_ntz, entity string, ts string, d string"


def test_doubling_equals_plain_sums(spark):
    rng = random.Random(1)
    rows = [(e, d, rng.randrange(100)) for e in "abc" for d in range(70)]
    dense = spark.createDataFrame(rows, "e string, d int, x long")
    got = {(r["e"], r["d"]): r for r in doubling_windows(dense, "e", "d", ["x"], [1, 3, 7, 30, 63]).collect()}
    by = {(e, d): x for e, d, x in rows}
    for (e, d), r in got.items():
        for w in (1, 3, 7, 30, 63):
            assert r[f"x_{w}"] == sum(by.get((e, k), 0) for k in range(d - w + 1, d + 1))
    with pytest.raises(ValueError):
        doubling_windows(dense, "e", "d", ["x"], [0])


def test_trailing_totals(spark):
    day = lambda d, ns=0: d * DAY_NS + ns
    w = lambda n: dt.datetime(2025, 1, 1, 0, 0, n)
    blocks = [
        (1, 1, [(day(20000), 5.0), (day(20000, DAY_NS - 1), 7.0), (day(20001), float("nan")), (day(20002), None), (None, 4.0)], w(1), "x", "y", "z"),
        (2, 1, [(day(20000), 6.0), (day(20001), 0.0)], w(2), None, None, None),  # sent again with another value: the later one counts
        (3, 1, None, None, None, None, None),
        (4, 2, [], w(1), None, None, None),
        (5, 3, [(day(20012), 1.0)], w(1), None, None, None),  # after the last day
        (6, None, [(day(20000), 1.0)], w(1), None, None, None),
        (7, 4, [(day(20000), 2.0)], w(1), None, None, None),
        (7, 4, [(day(20000), 2.0)], w(1), None, None, None),
    ]
    totals = trailing_totals(spark.createDataFrame(blocks, BLOCK), day(20010), [7, 30]).cache()
    rows = {(r["series_id"], (r["day"] - dt.date(1970, 1, 1)).days, r["window_days"]): r for r in totals.collect()}
    assert {k[0] for k in rows} == {1, 4} and len(rows) == 2 * 11 * 2
    assert (rows[1, 20001, 7]["total"], rows[1, 20001, 7]["n_samples"]) == (13, 3) and rows[1, 20001, 7]["average"] == pytest.approx(13 / 3)
    assert rows[1, 20010, 7]["average"] is None and rows[1, 20010, 7]["total"] == 0 and rows[1, 20010, 30]["daily_average"] == pytest.approx(13 / 30)
    assert rows[4, 20000, 7]["total"] == 2
    silent = {(r["series_id"], r["day_utc"]) for r in silent_windows(totals).collect()}
    days = [(dt.date(1970, 1, 1) + dt.timedelta(20000 + d)).isoformat() for d in range(11)]
    assert silent == {(1, d) for d in days[8:]} | {(4, d) for d in days[7:]}
    assert trailing_totals(spark.createDataFrame([], BLOCK), day(20010)).count() == 0


def test_regular_grid_against_plain_python(spark):
    rng = random.Random(2)
    rows = []
    for s in range(8):
        for _ in range(rng.choice([1, 4, 60])):
            t = rng.randrange(-20, 320)
            v = rng.choice([1.0, 2.0, float("nan"), None, math.inf])
            rows.append((rng.randrange(99), None if s == 7 else s, t, v, dt.datetime(2025, 1, 1, 0, rng.randrange(60)), "k", 1))
    rows += rows[:10] + [(1, 1, None, 5.0, None, "k", 1)]
    df = spark.createDataFrame(rows, "sample_id long, series_id long, timestamp_ns long, value double, ingested_at timestamp_ntz, k string, last long")
    got = {(r["series_id"], r["step_ts_ns"]): r for r in regular_grid(df, 5, 300, 10, 15).collect()}
    want = {}
    for s in range(7):
        mine = [(t, a, i, v) for i, x, t, v, a, *_ in rows if x == s and v is not None and not math.isnan(v) and t is not None and 5 <= t <= 300]
        if not mine:
            continue
        first, last = min(mine)[0], max(mine)[0]
        for t in range(5, 301, 10):
            if first <= t <= last:
                near = [m for m in mine if t - 15 <= m[0] <= t]
                want[s, t] = max(near) if near else None
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert (got[k]["status"] == "missing") == (m is None) and got[k]["reading_ts_ns"] == (m and m[0]) and got[k]["value"] == (m and m[3])
    assert missing_steps(regular_grid(df, 5, 300, 10, 15)).count() == sum(m is None for m in want.values())
    assert regular_grid(df.limit(0), 5, 300, 10, 15).count() == 0
    with pytest.raises(ValueError):
        regular_grid(df, 5, 300, 0, 15)


def test_stream(spark, tmp_path):
    rows = [(dt.datetime(2025, 1, 1, 0, m), "a" if m % 2 else None, None if m == 3 else float(m)) for m in range(20)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x string, value double")
    df.withColumn("ts", F.expr("CAST(ts AS TIMESTAMP)")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x string, value double").parquet(str(tmp_path / "in"))
    query = sliding(stream, ["x"], "10 minutes", "10 minutes", "1 minute").writeStream.format("memory").queryName("live").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    live = spark.table("live").collect()
    still = {(r["timestamp"], r["x"]): r for r in sliding(spark.read.parquet(str(tmp_path / "in")), ["x"], "10 minutes", "10 minutes", "1 minute").collect()}
    assert live and all(still[r["timestamp"], r["x"]]["sum"] == r["sum"] for r in live) and len(still) == 4
