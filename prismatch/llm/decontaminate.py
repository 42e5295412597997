"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of ``window`` consecutive item words (a shorter item is
one window). For every window length there is a shift table over blocks of two
words and buckets of test strings by the hash of their last block. A text is cut
into lanes that advance together in numpy: where the block at a lane's end has a
positive shift the lane jumps, where it is zero the bucket's strings are compared
word by word.

Defined cases: null or empty text has no words and no hits; items whose id or
text is null, or that have no words, take no part; repeated items count once per
id; repeated document rows each get their own result row; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.llm import words as W

WINDOW = 10
LANE = 256
#: benchmark text per search table; a larger benchmark is searched by several tables, one after the other
SHARD_BYTES = 8 << 20

_TYPE = "struct<n_words:bigint,spans:array<struct<s:int,e:int>>,items:array<string>>"


class Patterns:
    """Search tables for the test strings of one length ``m``."""

    def __init__(self, m: int, strings: dict[bytes, list[str]]):
        self.m, self.block = m, min(2, m)
        self.strings = list(strings)
        self.items = list(strings.values())
        w = W.words_of(pa.array(self.strings, pa.binary()), "alnum")
        grams = W.gram_hashes(W.hash_words(w), self.block)
        bits = max(12, (16 * len(self.strings) * m).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int32)
        first = w.first[:-1]
        for end in range(self.block, m + 1):  # the block that ends at word ``end``
            np.minimum.at(self.shift, (grams[first + end - self.block] & self.mask).astype(np.int64), m - end)
        suffix = grams[first + m - self.block]
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.firsts, self.lasts, self.buf = w.first[:-1], w.first[1:], w.buf
        self.starts, self.ends = w.starts, w.ends

    def search(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, test string) of every occurrence."""
        room = np.maximum(np.diff(w.first) - self.m + 1, 0)
        lanes = -(-room // LANE)
        part = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        base = np.repeat(w.first[:-1], lanes)
        cur = base + part * LANE
        stop = np.minimum(cur + LANE, base + np.repeat(room, lanes))
        found, hashes = [], []
        while len(cur):
            last = cur + self.m - 1
            h = W.hash_spans(w.buf, w.starts[last], w.ends[last])
            if self.block == 2:
                before = W.hash_spans(w.buf, w.starts[last - 1], w.ends[last - 1])
                h = W.mix(before * W.power_of(1) + h)
            else:
                h = W.mix(h)
            jump = self.shift[(h & self.mask).astype(np.int64)]
            hit = jump == 0
            if hit.any():
                found.append(cur[hit])
                hashes.append(h[hit])
            cur = cur + np.maximum(jump, 1)
            on = cur < stop
            cur, stop = cur[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, h = np.concatenate(found), np.concatenate(hashes)
        lo, hi = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
        n = hi - lo
        place = np.repeat(at, n)
        which = self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        return self._compare(w, place, which)

    def _compare(self, w: W.Words, place: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keep the places at which all words equal the test string's, byte by byte."""
        for j in range(self.m):
            if not len(place):
                break
            a, b = w.starts[place + j], self.starts[self.firsts[which] + j]
            size = w.ends[place + j] - a
            same = size == self.ends[self.firsts[which] + j] - b
            k = 0
            while True:
                more = np.flatnonzero(same & (size > k))
                if not len(more):
                    break
                left = W._MASK[np.minimum(size[more] - k, 8)]
                x = np.ndarray((len(w.buf) - 7,), "<u8", w.buf, strides=(1,))[a[more] + k] & left
                y = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, strides=(1,))[b[more] + k] & left
                same[more] = x == y
                k += 8
            place, which = place[same], which[same]
        return place, which


def windows(items: list[tuple[str, str]], window: int) -> dict[int, dict[bytes, list[str]]]:
    """Test strings by length, each with the ids of its items."""
    out: dict[int, dict[bytes, list[str]]] = {}
    w = W.words_of(pa.array([t for _, t in items], pa.string()), "alnum")
    raw = w.buf.tobytes()
    for r, (item, _) in enumerate(items):
        own = [raw[s:e] for s, e in zip(w.starts[w.first[r] : w.first[r + 1]], w.ends[w.first[r] : w.first[r + 1]], strict=True)]
        m = min(len(own), window)
        for i in range(len(own) - m + 1 if m else 0):
            ids = out.setdefault(m, {}).setdefault(b" ".join(own[i : i + m]), [])
            if item not in ids:
                ids.append(item)
    return out


def hits(column: pa.Array, tables: list[Patterns]) -> pa.Array:
    """One struct per text: its words, merged hit spans and the items that occur."""
    counts, spans, names = [], [], []
    for lo, hi in W.slices(column):
        w = W.words_of(column[lo:hi], "alnum")
        counts.append(w.counts())
        rows = hi - lo
        own_spans: list[list] = [[] for _ in range(rows)]
        own_names: list[set] = [set() for _ in range(rows)]
        at, until = [], []
        for t in tables:
            place, which = t.search(w)
            at.append(place)
            until.append(place + t.m)
            row = np.searchsorted(w.first, place, "right") - 1
            for r, k in np.unique(np.stack([row, which], 1), axis=0) if len(row) else ():
                own_names[r].update(t.items[k])
        start, end = np.concatenate(at or [np.zeros(0, int)]), np.concatenate(until or [np.zeros(0, int)])
        if len(start):
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            row = np.searchsorted(w.first, start, "right") - 1
            head = np.flatnonzero(np.r_[True, (start[1:] > end[:-1]) | (row[1:] != row[:-1])])
            tail = np.r_[head[1:], len(start)] - 1
            for r, s, e in zip(row[head], start[head] - w.first[row[head]], end[tail] - w.first[row[head]], strict=True):
                own_spans[r].append({"s": int(s), "e": int(e)})
        spans += own_spans
        names += [sorted(x) for x in own_names]
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))], ["n_words", "spans", "items"]
    )


def search_shards(benchmark: DataFrame, item: str, text: str, shard_bytes: int = SHARD_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Parts of the benchmark, each of at most about ``shard_bytes`` of text, as rows for one search table."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // shard_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        if part_rows := [(r.i, r.t) for r in part.collect()]:
            yield part_rows


def _searcher(packed: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf(_TYPE)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = [Patterns(m, strings) for m, strings in sorted(packed.value.items())]
        for batch in batches:
            yield hits(batch, tables)

    return search


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, out: str = "__hits",
) -> DataFrame:
    """Add ``out``: struct of ``n_words``, ``spans`` (merged hit word spans, end exclusive) and ``items`` (ids, sorted).

    One table of at most ``SHARD_BYTES`` of test strings is sent to the tasks per
    shard; documents are not shuffled.
    """
    spark, found = docs.sparkSession, []
    for shard in search_shards(benchmark, item_id, item_text):
        found.append(_searcher(spark.sparkContext.broadcast(windows(shard, window)))(F.col(text).cast("string")))
    if not found:  # no test strings: words are counted all the same
        found.append(_searcher(spark.sparkContext.broadcast({}))(F.col(text).cast("string")))
    names = [f"{out}_{k}" for k in range(len(found))]
    return docs.withColumns(dict(zip(names, found, strict=True))).withColumn(out, _union(names)).drop(*names)


def _union(names: list[str]) -> Column:
    if len(names) == 1:
        return F.col(names[0])
    spans = F.array_sort(F.concat(*[F.col(f"{n}.spans") for n in names]))
    none = F.slice(spans, 1, 0)

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e")))
        )
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] > last["e"], F.concat(acc, F.array(x))).otherwise(joined)

    return F.struct(
        F.col(f"{names[0]}.n_words").alias("n_words"),
        F.aggregate(spans, none, add).alias("spans"),
        F.array_sort(F.array_distinct(F.concat(*[F.col(f"{n}.items") for n in names]))).alias("items"),
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: word and hit counts, the number and digest of the items found."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("__hits.spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("__hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.0) -> DataFrame:
    """Keep the documents of whose words at most ``max_share`` are hit; all columns stay as they are."""
    found = contamination(docs, benchmark, out="__hits")
    n_hit = F.aggregate("__hits.spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return found.where(n_hit <= F.lit(max_share) * F.col("__hits.n_words")).drop("__hits")
