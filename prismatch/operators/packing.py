"""Greedy packing of whole groups into splits, without a sequential pass over the groups.

Groups go, largest first, to the split that is furthest below its target. The
choice looks sequential, but it only depends on how many items each split has,
and groups of one size are interchangeable. For a run of equal sizes every
split offers a falling series of deficits, and the greedy choice is the merge of
these series. So

* the state is folded over the *distinct sizes* only (N items have at most
  sqrt(2 N) of them), and
* each group finds its own split from its place in the run by a search in the
  merged series, in parallel.

The arithmetic is that of the plain loop, so ties fall the same way. With a
seed, the loop's tie jitter is reproduced by jumping the generator to the item.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismatch.operators.graph import skew_safe_lookup
from prismatch.operators.ordering import with_position
from prismatch.session import stage

SPLITS = ("train", "val", "test")
FRACTIONS = (0.8, 0.1, 0.1)
JITTER = 1e-9


class Deficits:
    """Deficit series of every split for items that share a run."""

    def __init__(self, target: np.ndarray, got: np.ndarray, size: np.ndarray, relative: bool):
        self.target, self.got, self.size = target, got, size
        self.scale = np.maximum(target, 1.0) if relative else np.ones_like(target)
        self.k = target.shape[1]

    def value(self, s: int, j: np.ndarray) -> np.ndarray:
        """Deficit of split ``s`` once it took ``j`` items of the run."""
        return (self.target[:, s] - (self.got[:, s] + j * self.size)) / self.scale[:, s]

    def above(self, s: int, v: np.ndarray, inclusive: bool) -> np.ndarray:
        """Number of entries of the series of ``s`` that are > v (or >= v)."""

        def beats(j):
            h = self.value(s, j)
            return h >= v if inclusive else h > v

        j = np.ceil((self.target[:, s] - v * self.scale[:, s] - self.got[:, s]) / self.size)
        j = np.maximum(j, 0.0)
        while True:
            up = beats(j)
            if not up.any():
                break
            j = j + up
        while True:
            down = (j > 0) & ~beats(j - 1)
            if not down.any():
                return j
            j = j - down

    def place(self, s: int, j: np.ndarray) -> np.ndarray:
        """Place of item ``j`` of split ``s`` in the merged order (ties go to the earlier split)."""
        v = self.value(s, j)
        return j + sum(self.above(o, v, inclusive=o < s) for o in range(self.k) if o != s)

    def at(self, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split of the item at each place, and the items per split up to and with it."""
        n = len(ordinal)
        split, level = np.zeros(n, np.int64), np.zeros(n)
        for s in range(self.k):
            lo, hi = np.zeros(n), ordinal.astype(float)
            while (lo < hi).any():
                mid = np.floor((lo + hi) / 2)
                left = self.place(s, mid) >= ordinal
                hi = np.where(left, mid, hi)
                lo = np.where(left, lo, np.minimum(mid + 1, hi))
            hit = self.place(s, lo) == ordinal
            split[hit], level[hit] = s, self.value(s, lo)[hit]
        counts = np.stack([
            np.where(split >= o, self.above(o, level, True), self.above(o, level, False)) for o in range(self.k)
        ], axis=1)
        return split, counts

    def at_jittered(self, ordinal: np.ndarray, item: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`at` when each choice adds ``U * 1e-9`` per split to the deficits.

        Only deficits within the jitter of each other can change places. Those
        around the item are replayed from the first one on; all before are settled.
        """
        split, counts = self.at(ordinal)
        n = len(ordinal)
        own = np.choose(split, [self.value(s, np.maximum(counts[:, s] - 1, 0)) for s in range(self.k)])
        hi = own.copy()
        while True:  # widen upwards over chains of near ties
            before = hi.copy()
            for s in range(self.k):
                j = self.above(s, hi, False) - 1
                v = self.value(s, np.maximum(j, 0))
                near = (j >= 0) & (v <= hi + JITTER)
                hi = np.where(near, np.maximum(hi, v), hi)
            if (hi == before).all():
                break
        taken = np.stack([self.above(s, hi, False) for s in range(self.k)], axis=1)
        todo = (ordinal - taken.sum(axis=1)).astype(int)
        first = item - todo
        draws = _uniforms(seed, first, todo + 1, self.k)
        out = np.zeros(n, np.int64)
        for step in range(int(todo.max()) + 1 if n else 0):
            live = todo >= step
            heads = np.stack([self.value(s, taken[:, s]) for s in range(self.k)], axis=1)
            pick = np.argmax(heads + draws[:, min(step, draws.shape[1] - 1)] * JITTER, axis=1)
            out = np.where(live, pick, out)
            taken[np.flatnonzero(live), pick[live]] += 1
        return out, taken


def _uniforms(seed: int, first: np.ndarray, steps: np.ndarray, k: int) -> np.ndarray:
    """Draws ``[item, step, split]`` of one stream that spends ``k`` numbers per item."""
    width = int(steps.max()) if len(steps) else 1
    lo, hi = int(first.min()), int(first.max()) + width
    if hi - lo <= 4 * len(first) + 1024:
        block = np.random.Generator(np.random.PCG64(seed).advance(lo * k)).random((hi - lo, k))
        return block[(first - lo)[:, None] + np.arange(width)[None, :]]
    rows = [np.random.Generator(np.random.PCG64(seed).advance(int(f) * k)).random((width, k)) for f in first]
    return np.stack(rows)


def stream_uniforms(seed: int, index: np.ndarray) -> np.ndarray:
    """Element ``index`` of ``default_rng(seed).random(...)`` for any index set."""
    return _uniforms(seed, np.asarray(index, dtype=np.int64), np.ones(len(index), np.int64), 1)[:, 0, 0]


def _with(df: DataFrame, **more: T.DataType) -> T.StructType:
    """Schema of ``df`` with columns added."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in more.items()]])


def pack(
    groups: DataFrame,
    *,
    group: str = "group",
    size: str = "size",
    stratum: str | None = None,
    fractions: Sequence[float] = FRACTIONS,
    names: Sequence[str] = SPLITS,
    relative: bool = False,
    seed: int | None = None,
) -> DataFrame:
    """``(stratum,) group, size, split`` for a table of group sizes.

    ``relative=True`` ranks splits by ``(target - got) / target`` and orders
    equal sizes by group; the seed adds a tie jitter of 1e-9. ``relative=False``
    ranks by ``target - got``; the seed shuffles groups of equal size.
    """
    fr = [float(f) for f in fractions]
    k = len(fr)
    work = groups.select(
        (F.col(stratum) if stratum else F.lit("")).alias("__s"), F.col(group).alias("__g"), F.col(size).cast("bigint").alias("__n")
    )
    tie = [F.col("__g").asc()]
    if seed is not None and not relative:
        work = with_position(work, [F.col("__s"), F.col("__g")], "__i")

        def shuffle(batches):
            for pdf in batches:
                pdf["__j"] = stream_uniforms(seed, pdf["__i"].to_numpy()) if len(pdf) else 0.0
                yield pdf.drop(columns="__i")

        work = work.mapInPandas(shuffle, _with(work.drop("__i"), __j=T.DoubleType()))
        tie = [F.col("__j").asc(), F.col("__g").asc()]
    placed = stage(with_position(work, [F.col("__s").asc(), F.col("__n").desc(), *tie], "__p"), "placed")
    run = placed.groupBy("__s", "__n").agg(F.count(F.lit(1)).alias("__m"), F.min("__p").alias("__first"))
    jittered = relative and seed is not None

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n", ascending=False).reset_index(drop=True)
        target = np.array([fr]) * float((pdf["__n"] * pdf["__m"]).sum())
        got = np.zeros((1, k))
        start = int(pdf["__first"].min())
        states = []
        for n, m, first in zip(pdf["__n"], pdf["__m"], pdf["__first"]):
            states.append(got[0].tolist())
            d = Deficits(target, got, np.array([float(n)]), relative)
            last = np.array([m - 1])
            counts = d.at_jittered(last, last + (first - start), seed)[1] if jittered else d.at(last)[1]
            got = got + counts * float(n)
        return pdf.assign(__got=states, __target=[target[0].tolist()] * len(pdf), __start=start)

    state = stage(run.groupBy("__s").applyInPandas(
        fold, _with(run, __got=T.ArrayType(T.DoubleType()), __target=T.ArrayType(T.DoubleType()), __start=T.LongType())), "runs")
    key = F.struct("__s", "__n")
    n_runs = state.count()
    left = placed.withColumn("__k", F.to_json(key))
    right = state.select(F.to_json(key).alias("__k"), "__first", "__got", "__target", "__start")
    joined = left.join(F.broadcast(right), "__k") if n_runs <= 100_000 else skew_safe_lookup(left, right, "__k")
    joined = joined.select("__s", "__g", "__n", "__p", "__first", "__got", "__target", "__start")

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            d = Deficits(np.stack(pdf["__target"]), np.stack(pdf["__got"]), pdf["__n"].to_numpy(float), relative)
            ordinal = (pdf["__p"] - pdf["__first"]).to_numpy()
            if jittered:
                split = d.at_jittered(ordinal, (pdf["__p"] - pdf["__start"]).to_numpy(), seed)[0]
            else:
                split = d.at(ordinal)[0]
            yield pd.DataFrame({"__s": pdf["__s"], "__g": pdf["__g"], "__n": pdf["__n"], "split": [names[s] for s in split]})

    out = joined.mapInPandas(assign, _with(joined.select("__s", "__g", "__n"), split=T.StringType()))
    head = [F.col("__s").alias(stratum)] if stratum else []
    return out.select(*head, F.col("__g").alias(group), F.col("__n").alias(size), "split")
