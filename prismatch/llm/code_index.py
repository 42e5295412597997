"""Nearest neighbours by multi-index hashing of learned, rotated binary codes.

Vectors are centred, turned into their principal axes and rotated so that the
signs lose least (iterative quantisation, fitted with the axes on a bounded
sample). The code's bits are cut into substrings of 16 bits, each with a table
from its value to the rows. Codes within Hamming distance ``r`` agree with the
query's in one of ``m`` substrings up to ``r // m`` bits (pigeonhole), so probing
those values retrieves every such code; the floats of the retrieved rows rank
them. The radius is read from the sample: the share ``COVER`` of its true
neighbours lies within it. A part of the index in which it finds fewer than
``k`` rows is probed again with a larger one.

Every row is indexed. Queries reach the tasks in parts of ``PART`` rows, and a
task keeps ``k`` rows a query for all its rows.

Defined cases: null and zero vectors, and those with null or non-finite
components or of another length than most, take no part; equal distances are
ordered by id; repeated ids are separate candidates, but no row of a query's own
id is one; no valid vector, or no query, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.session import stage

SAMPLE = 4096  # rows for axes, rotation and radius
PROBES = 256  # of these, queries for the radius
BITS = 64
SUB = 16
ROUNDS = 50
COVER = 0.985
SHARD = 1 << 16  # rows of one set of tables
PART = 1 << 14  # queries sent to the tasks at a time
_POP = np.array([bin(i).count("1") for i in range(1 << SUB)], np.uint8)
_BY_WEIGHT = np.argsort(_POP, kind="stable").astype(np.int64)
_BALL = np.cumsum(np.bincount(_POP, minlength=SUB + 1))  # values within each distance


@dataclass
class Codes:
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    @property
    def parts(self) -> int:
        return -(-self.bits // SUB)

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """[row, substring] values of the codes."""
        on = (x - self.mean) @ self.turn > 0
        on = np.pad(on, ((0, 0), (0, self.parts * SUB - self.bits)))
        return np.packbits(on.reshape(len(x), self.parts, SUB), axis=2).view(">u2")[:, :, 0].astype(np.int64)


def fit(sample: np.ndarray, k: int) -> Codes:
    mean = sample.mean(0)
    values, axes = np.linalg.eigh(np.cov((sample - mean).T).reshape(sample.shape[1], -1) if len(sample) > 1 else np.eye(sample.shape[1]))
    del values
    axes = axes[:, ::-1][:, :BITS]
    z = (sample - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(z.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ w).T
    codes = Codes(mean, axes @ turn, 0)
    sub = codes.substrings(sample)
    seen = []
    for i in range(min(PROBES, len(sample))):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        seen.append(_POP[sub[near] ^ sub[i]].sum(1))
    seen = np.sort(np.concatenate(seen)) if seen else np.zeros(0)
    codes.radius = int(seen[min(int(COVER * len(seen)), len(seen) - 1)]) if len(seen) else codes.bits
    return codes


class Tables:
    """One shard of the index: for every substring the rows in the order of its value."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray):
        self.codes, self.ids, self.x, self.sub = codes, ids, x, codes.substrings(x)
        self.rows = np.argsort(self.sub, 0, kind="stable").T
        self.keys, self.begin, self.end = [], [], []
        for p in range(codes.parts):
            key, begin = np.unique(self.sub[self.rows[p], p], return_index=True)
            self.keys.append(key)
            self.begin.append(begin)
            self.end.append(np.r_[begin[1:], len(ids)])

    def _retrieve(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes lie within ``radius``."""
        hit = np.zeros(len(self.ids), bool)
        reach = min(radius // self.codes.parts, SUB)
        for p in range(self.codes.parts):
            keys = self.keys[p]
            if _BALL[reach] < len(keys):  # probe the ball's values
                probe = query[p] ^ _BY_WEIGHT[: _BALL[reach]]
                at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                at = at[keys[at] == probe]
            else:  # fewer values are in use than in the ball
                at = np.flatnonzero(_POP[keys ^ query[p]] <= reach)
            begin, n = self.begin[p][at], self.end[p][at] - self.begin[p][at]
            hit[self.rows[p][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]] = True
        rows = np.flatnonzero(hit)
        return rows[_POP[self.sub[rows] ^ query].sum(1) <= radius]

    def nearest(self, own: int, sub: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        radius = self.codes.radius
        while True:
            rows = self._retrieve(sub, radius)
            rows = rows[self.ids[rows] != own]
            if len(rows) >= k or radius >= self.codes.parts * SUB:
                break
            radius += self.codes.parts
        d = np.sqrt(((self.x[rows] - vector) ** 2).sum(1))
        if len(d) > k:
            near = d <= np.partition(d, k - 1)[k - 1]  # with all ties
            rows, d = rows[near], d[near]
        best = np.lexsort((self.ids[rows], d))[:k]
        return self.ids[rows[best]], d[best]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of every query's best ``k``, by query and rank."""
    order = np.lexsort((vec, score, query))
    q = query[order]
    head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)]))
    return order[rank < k]


def _searcher(model, part, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (own, vectors) = model.value, part.value
        subs = codes.substrings(vectors)
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def probe(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = pa.Table.from_batches(held)
            tables = Tables(codes, t["vec_id"].to_numpy(), _matrix(t["vector"]))
            found = [tables.nearest(int(q), s, v, k) for q, s, v in zip(own, subs, vectors, strict=True)]
            query = np.concatenate([kept[0], np.repeat(own, [len(i) for i, _ in found])])
            vec, score = np.concatenate([kept[1], *[i for i, _ in found]]), np.concatenate([kept[2], *[d for _, d in found]])
            best = _top(query, vec, score, k)
            return query[best], vec[best], score[best]

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= SHARD:
                kept, held, n = probe(held), [], 0
        if n:
            kept = probe(held)
        yield pa.record_batch([pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2])], ["query_id", "vec_id", "score"])

    return search


def _ranker(k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        query, vec, score = (t[c].to_numpy() for c in ("query_id", "vec_id", "score"))
        best = _top(query, vec, score, k)
        q = query[best]
        head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)])) + 1
        yield pa.record_batch([pa.array(q), pa.array(place.astype(np.int32)), pa.array(vec[best]), pa.array(score[best])], ["query_id", "rank", "vec_id", "score"])

    return rank


def valid_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    v = F.col("vector")
    kind = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    sound = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(v, lambda c: c != 0)
    kind = kind.where(sound)
    sizes = kind.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return kind.where(F.size("vector") == sizes[0].d) if sizes else kind


def search(rows: DataFrame, is_query: Column, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: nearest rows (Euclidean) of those rows for which ``is_query`` (of ``vec_id``) holds."""
    spark = rows.sparkSession
    shape = "query_id bigint, vec_id bigint, score double"
    index = stage(valid_vectors(rows, vec_id, vector), "vectors")
    sample = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    model = spark.sparkContext.broadcast(fit(_matrix(sample["vector"]), k))
    queries = index.where(is_query)
    parts = max(1, -(-queries.count() // PART))
    found = []
    for p in range(parts):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).toArrow()
        if own.num_rows:
            part = spark.sparkContext.broadcast((own["vec_id"].to_numpy(), _matrix(own["vector"])))
            found.append(index.mapInArrow(_searcher(model, part, k), shape))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.repartition("query_id").mapInArrow(_ranker(k), "query_id bigint, rank int, vec_id bigint, score double")


def neighbour_query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 100 == 0)
