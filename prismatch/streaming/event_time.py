"""Event-time windows, sessions and duplicates, over tables and over streams that arrive out of order.

Every function takes a batch or a streaming DataFrame. On a stream the watermark,
``delay`` behind the latest event time, closes windows and sessions and forgets
keys, so that the state holds what the last ``delay`` can still change and no more.
``replay`` plays a table in numbered micro-batches, each a run of its own that goes
on from the checkpoint of the one before; ``late_rows`` is the batch form of what
the watermark drops there. With a delay no shorter than the disorder nothing is late
and a replay returns what the batch form returns, as far as it is closed.

Defined cases: rows without an event time or a batch number take no part; a null key is a key;
equal rows count as often as they occur; without rows nothing is run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismatch.session import stage, staging_root


def _timed(rows: DataFrame, time: str, delay: str) -> DataFrame:
    return rows.where(F.col(time).isNotNull()).withWatermark(time, delay)


def tumbling(rows: DataFrame, width: str, aggs: Sequence[Column], *, delay: str, keys: Sequence[str] = (), time: str = "time") -> DataFrame:
    """``keys``, ``window`` (start and end) and ``aggs`` of windows of ``width``; partial sums are made before the shuffle."""
    return _timed(rows, time, delay).groupBy(*keys, F.window(time, width).alias("window")).agg(*aggs)


def sessions(rows: DataFrame, gap: str, aggs: Sequence[Column], *, delay: str, keys: Sequence[str], time: str = "time") -> DataFrame:
    """As ``tumbling``, over stretches of a key's rows that are at most ``gap`` apart.

    Stage a batch result before filtering by its window: the optimiser would apply
    the condition to single rows, before they are merged.
    """
    return _timed(rows, time, delay).groupBy(*keys, F.session_window(time, gap).alias("window")).agg(*aggs)


def once(rows: DataFrame, keys: Sequence[str], *, delay: str, time: str = "time") -> DataFrame:
    """The rows without repetitions of ``keys``; a stream forgets a key ``delay`` after the row that it kept."""
    timed = _timed(rows, time, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else timed.dropDuplicates(list(keys))


def late_rows(rows: DataFrame, end: Column, *, delay_ms: int, batch: str = "batch", time: str = "time") -> DataFrame:
    """``rows`` with ``late``: whether ``end``, where the row's window ends, was passed before its batch arrived.

    The watermark has whole milliseconds and stands behind all earlier batches, late rows included.
    """
    timed = rows.where(F.col(time).isNotNull() & F.col(batch).isNotNull())
    peaks = timed.groupBy(batch).agg(F.max(F.unix_millis(time)).alias("__peak"))  # one row per batch from here on
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    mark = peaks.select(batch, (F.max("__peak").over(before) - delay_ms).alias("__mark"))
    return timed.join(F.broadcast(mark), batch).select(*rows.columns, F.coalesce(F.unix_millis(end) <= F.col("__mark"), F.lit(False)).alias("late"))


def replay(rows: DataFrame, build: Callable[[DataFrame], DataFrame], *, batch: str = "batch", time: str = "time") -> DataFrame:
    """What ``build`` emits when the batches of ``rows`` arrive one after the other.

    The driver holds the batches' numbers alone. A run reads what its batch has added,
    closes what the watermark has passed by then, and leaves its state to the next.
    """
    spark = rows.sparkSession
    timed = stage(rows.where(F.col(time).isNotNull() & F.col(batch).isNotNull()), "arrivals")
    folder = f"{staging_root(spark).rstrip('/')}/prismatch-replay-{uuid.uuid4().hex}"
    shape = build(timed.drop(batch)).schema
    numbers = [r[0] for r in timed.select(batch).distinct().orderBy(batch).collect()]
    if not numbers:
        return spark.createDataFrame([], shape)
    for k in numbers:
        timed.where(F.col(batch) == k).drop(batch).write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(timed.drop(batch).schema).parquet(f"{folder}/in")
        sink = build(arrived).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        sink.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(shape).parquet(f"{folder}/out")
