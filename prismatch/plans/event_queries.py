"""Event-time windows over the event log, replayed as it might have arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatch.plans.registry import query
from prismatch.plans.views import table
from prismatch.streaming import event_time as E

# an event arrives up to twelve hours after it happened, and a week's arrivals are one micro-batch
_ARRIVED = """e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us,
 (epoch_us(ts) + ((event_id * 7919) % 13) * 3600000000) // 604800000000 AS batch FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
peak AS (SELECT batch, max(max(us // 1000)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e GROUP BY batch),
marked AS (SELECT e.*, us // 3600000000 * 3600 AS start_s, coalesce((us // 3600000000 + 1) * 3600000 <= before - 14400000, FALSE) AS late FROM e JOIN peak USING (batch))"""


def _arrivals(spark, sf):
    e = table(spark, sf, "events").where("event_id is not null")
    e = e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.col("ts").cast("timestamp").alias("time"))
    arrival = F.unix_micros("time") + F.col("event_id") * 7919 % 13 * 3600000000
    return e.withColumn("batch", F.floor(arrival / 604800000000))


def _start(name: str = "window"):
    return F.unix_seconds(F.col(f"{name}.start")).alias("start_s")


@query("event_windows", "WITH " + _ARRIVED + """ SELECT event_type, start_s, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM marked WHERE NOT late AND (start_s + 3600) * 1000 <= (SELECT max(us // 1000) FROM e) - 14400000 GROUP BY event_type, start_s""")
def event_windows(spark, sf):
    """Closed hours of the log by type; the watermark, four hours behind, drops what arrives later."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")]
    out = E.replay(_arrivals(spark, sf), lambda rows: E.tumbling(rows, "1 hour", aggs, delay="4 hours", keys=["event_type"]))
    return out.select("event_type", _start(), "n", "cents")


@query("late_events", "WITH " + _ARRIVED + " SELECT batch, event_type, count(*) AS n, count(*) FILTER (late) AS n_late FROM marked GROUP BY batch, event_type")
def late_events(spark, sf):
    """What that watermark drops, by batch and type."""
    end = F.window("time", "1 hour")["end"]
    marked = E.late_rows(_arrivals(spark, sf).withColumn("until", end), F.col("until"), delay_ms=4 * 3600000)
    return marked.groupBy("batch", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"))


@query("event_sessions", "WITH " + _ARRIVED + """, cut AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 7200000000 THEN 0 ELSE 1 END AS first FROM e),
numbered AS (SELECT user_id, us, sum(first) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM cut),
done AS (SELECT user_id, s, min(us) AS begin, max(us) + 7200000000 AS until, count(*) AS n FROM numbered GROUP BY user_id, s)
SELECT user_id, begin AS start_us, until - begin AS length_us, n FROM done WHERE until // 1000 <= (SELECT max(us // 1000) FROM e) - 54000000""")
def event_sessions(spark, sf):
    """Closed sessions of users, two hours apart; nothing is late, since the watermark is further behind than any arrival."""
    out = E.replay(_arrivals(spark, sf), lambda rows: E.sessions(rows, "2 hours", [F.count(F.lit(1)).alias("n")], delay="15 hours", keys=["user_id"]))
    begin, end = F.unix_micros("window.start"), F.unix_micros("window.end")
    return out.select("user_id", begin.alias("start_us"), (end - begin).alias("length_us"), "n")


@query("event_repeats", "SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL")
def event_repeats(spark, sf):
    """Every event once, although a third of them arrive in their own batch and in the next."""
    rows = _arrivals(spark, sf)
    again = rows.where("event_id % 3 = 0").withColumn("batch", F.col("batch") + 1)
    out = E.replay(rows.unionByName(again), lambda r: E.once(r, ["event_id"], delay="15 hours"))
    return out.select("event_id", "user_id", "event_type", F.unix_micros("time").alias("us"))
