"""Preference formatting: one prompt and two masked completions from a pair of conversations.

The common prefix ends at the first turn whose messages differ between chosen and
rejected. It is rendered once, from the chosen side; what follows is rendered for
each side, and only its assistant messages are marked for training. Turns stay
rows until the end: nothing is collected for a conversation unless ``assemble``
is asked to.

Defined cases: a null turn comes last, null roles and texts are empty; several
messages of one turn are compared as a multiset and ordered by role, then text;
equal conversations have an empty completion on both sides; rows without a
conversation id, and pairs with one side only, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.operators.graph import skew_safe_lookup
from prismatch.operators.ordering import with_position
from prismatch.session import stage

LAST = (1 << 62) - 1


def _clean(turns: DataFrame, conv: str) -> DataFrame:
    return turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.coalesce(F.col("turn").cast("bigint"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def pair_by_opening(turns: DataFrame) -> DataFrame:
    """``conv_id, pair_id, side``: all conversations in the order of their opening message and id, paired as they follow.

    Conversations with one opening thus meet. The first of a pair is chosen
    (side 0), the second rejected (side 1); the smaller id names the pair, and
    the last of an odd number stays alone. The order is global and distributed,
    so an opening that most conversations share is no single task's work.
    """
    opening = _clean(turns, "conv_id").groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("o"))
    keys = opening.select("conv_id", F.col("o.role").alias("role"), F.col("o.text").alias("text"))
    placed = stage(with_position(keys, [F.col("role"), F.col("text"), F.col("conv_id")], "at").select("conv_id", "at"), "openings")
    numbered = placed.select("conv_id", (F.col("at") % 2).cast("int").alias("side"), F.floor(F.col("at") / 2).alias("slot"))
    both = numbered.groupBy("slot").agg(F.min("conv_id").alias("pair_id"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return numbered.join(both, "slot").select("conv_id", "pair_id", "side")


def preference_rows(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per rendered message: ``pair_id, part`` (prompt, chosen or rejected), ``turn``, ``role``, ``rendered``, ``train``.

    ``pairs`` has ``conv_id, pair_id, side`` (0 chosen, 1 rejected).
    """
    rows = stage(skew_safe_lookup(_clean(turns, "conv_id"), pairs, "conv_id"), "pair-turns")
    uneven = rows.groupBy("pair_id", "turn", "role", "text").agg(F.sum(1 - 2 * F.col("side")).alias("d")).where("d <> 0")
    ends = uneven.groupBy("pair_id").agg(F.min("turn").alias("end"))
    placed = skew_safe_lookup(rows, ends, "pair_id", "left").withColumn("shared", F.col("end").isNull() | (F.col("turn") < F.col("end")))
    kept = placed.where(~F.col("shared") | (F.col("side") == 0))
    part = F.when(F.col("shared"), "prompt").when(F.col("side") == 0, "chosen").otherwise("rejected")
    return kept.select(
        "pair_id", part.alias("part"), "turn", "role", render(F.col("role"), F.col("text")).alias("rendered"),
        (~F.col("shared") & (F.col("role") == "assistant")).alias("train"),
    )


def assemble(rows: DataFrame) -> DataFrame:
    """One record per pair: ``prompt``, ``chosen``, ``rejected`` and for both completions the trained character spans.

    A record is one training sample and is held by one task.
    """
    sides = rows.groupBy("pair_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("turn", "role", "rendered", "train")))).alias(p) for p in ("prompt", "chosen", "rejected")]
    )

    def spans(col: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.length(x["rendered"])
            span = F.array(F.struct(acc["at"].alias("begin"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(x["train"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(col, start, add, lambda acc: acc["out"])

    text = lambda c: F.array_join(F.transform(c, lambda x: x["rendered"]), "")
    return sides.select(
        "pair_id", text(F.col("prompt")).alias("prompt"), text(F.col("chosen")).alias("chosen"), text(F.col("rejected")).alias("rejected"),
        spans(F.col("chosen")).alias("chosen_train"), spans(F.col("rejected")).alias("rejected_train"),
    )


PREFERENCE_SQL = """
WITH clean AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(CAST(turn AS BIGINT), 4611686018427387903) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
opening AS (
  SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM clean) WHERE n = 1),
ranked AS (
  SELECT conv_id, row_number() OVER (ORDER BY role, text, conv_id) - 1 AS pos FROM opening),
numbered AS (
  SELECT conv_id, pos % 2 AS side, min(conv_id) OVER (PARTITION BY pos // 2) AS pair_id, count(*) OVER (PARTITION BY pos // 2) AS n FROM ranked),
turns AS (
  SELECT c.*, p.pair_id, p.side FROM clean c JOIN numbered p USING (conv_id) WHERE p.n = 2),
ends AS (
  SELECT pair_id, min(turn) AS stop FROM (
    SELECT pair_id, turn, role, text FROM turns GROUP BY ALL HAVING sum(1 - 2 * side) <> 0) GROUP BY pair_id),
placed AS (
  SELECT t.*, (e.stop IS NULL OR t.turn < e.stop) AS shared FROM turns t LEFT JOIN ends e USING (pair_id))
SELECT pair_id, CASE WHEN shared THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part, turn, role,
       '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, (NOT shared AND role = 'assistant') AS train
FROM placed WHERE NOT shared OR side = 0
"""


def preference_query(turns: DataFrame) -> DataFrame:
    return preference_rows(turns, pair_by_opening(turns))
