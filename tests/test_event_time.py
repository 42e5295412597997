"""Replayed streams against the batch form and plain Python."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from prismatch.session import stage
from prismatch.streaming import event_time as E

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id bigint, k string, time timestamp, batch bigint, x bigint"


def _sums():
    return [F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")]


def _rows(spark, n=400, disorder=90, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        minute = rng.randrange(0, 1500)
        out.append((i, rng.choice(["a", "b", None]), START + timedelta(minutes=minute), (minute + rng.randrange(disorder)) // 300, rng.randrange(9)))
    return spark.createDataFrame([*out, (n, "a", None, 0, 1), (n + 1, "a", START, None, 1)], SCHEMA)


def _set(df):
    return sorted(map(str, df.collect()))


def test_replay_without_late_rows_is_the_batch_form(spark):
    rows = _rows(spark)
    timed = rows.where("time is not null and batch is not null")
    mark = timed.agg(F.max("time")).first()[0] - timedelta(hours=3)
    for build in (
        lambda r: E.tumbling(r, "30 minutes", _sums(), delay="3 hours", keys=["k"]),
        lambda r: E.sessions(r, "7 minutes", _sums(), delay="3 hours", keys=["k"]),
    ):
        closed = stage(build(timed.drop("batch"))).where(F.col("window.end") <= F.lit(mark))  # sessions are whole before the filter
        got = E.replay(rows, build)
        assert got.count() > 50 and _set(got) == _set(closed)
    assert _set(E.replay(rows, lambda r: E.once(r, ["id"], delay="3 hours")).select("id")) == _set(timed.select("id"))


def test_late_rows_are_what_the_watermark_drops(spark):
    rows = _rows(spark, disorder=600, seed=2)
    marked = E.late_rows(rows.withColumn("until", F.window("time", "30 minutes")["end"]), F.col("until"), delay_ms=600000)
    peak, late = {}, set()
    plain = [r for r in marked.collect()]
    for r in plain:
        peak[r.batch] = max(peak.get(r.batch, r.time), r.time)
    for r in plain:
        before = [t for b, t in peak.items() if b < r.batch]
        if before and r.until <= max(before) - timedelta(minutes=10):
            late.add(r.id)
    assert {r.id for r in plain if r.late} == late and 20 < len(late) < len(plain)
    mark = max(peak.values()) - timedelta(minutes=10)
    build = lambda r: E.tumbling(r, "30 minutes", _sums(), delay="10 minutes", keys=["k"])
    kept = E.tumbling(marked.where("not late"), "30 minutes", _sums(), delay="10 minutes", keys=["k"]).where(F.col("window.end") <= F.lit(mark))
    assert _set(E.replay(rows, build)) == _set(kept)


def test_repetitions_across_batches_and_empty_tables(spark):
    rows = _rows(spark, 60)
    again = rows.where("id % 2 = 0").withColumn("batch", F.col("batch") + 1)
    out = E.replay(rows.unionByName(again).unionByName(rows), lambda r: E.once(r, ["id"], delay="12 hours"))
    assert sorted(r.id for r in out.collect()) == list(range(60))
    none = E.replay(rows.limit(0), lambda r: E.sessions(r, "1 minute", _sums(), delay="1 minute", keys=["k"]))
    assert none.columns == ["k", "window", "n", "x"] and none.count() == 0
