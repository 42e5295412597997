"""Maximal periodic runs of words, seeded by block convolution at dyadic scales.

A run is a stretch of words with smallest period ``q`` and a length of at least
``max(min_length, 2 q)`` that neither neighbouring word extends. For blocks of
``b`` words at every multiple of ``b`` (b = 2, 4, 8, ...) one scale looks for
periods from ``2 b`` to ``4 b - 1`` (the smallest one from 1 on): a run of such a
period holds a whole block whose words occur again one period later.

* The sum of squared differences between a block and what lies ``d`` words later
  is formed for all ``d`` of a scale at once, as block energy plus window energy
  less twice a correlation. The correlation is a number-theoretic transform modulo
  ``PRIME``: products of matrices of exact integers in doubles, all blocks of a
  scale in one batch. A sum of zero is a seed; comparing the words confirms it.
* Blocks with a word that does not occur again within the scale's reach can't be
  seeds and are left out, as are distances that a run already found explains.
* Seeds that follow each other at one distance are one chain. It is extended to
  both sides, in doubling steps; stretches found at several distances keep the
  smallest, which is their period.

Texts are searched whole. Memory is that of a slice of texts (or one longer text)
times a constant; nothing is shuffled. Words are told apart by 64-bit hashes.

Defined cases: null and empty texts have no words and no runs; ties do not occur
(start and period name a run); repeated rows get equal results; other columns
stay, except one named like ``out``, which is an error.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.llm import words as W

MIN_LENGTH = 12
#: 7 * 2^20 + 1, with 3 as a primitive root: transforms of up to 2^20 values, and 64 products of two residues fit in a double
PRIME = 7 * (1 << 20) + 1
ROOT = 3
RADIX = 64
#: longest block that is transformed; at larger scales it stands for the first words of its block
LONGEST = 1 << 16
#: values transformed at once
BATCH = 1 << 18
_TYPE = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def _mod(x: np.ndarray) -> np.ndarray:
    """Residues in place; a value may stay one step off the range, which later steps allow for."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    return x


@cache
def _powers(n: int, rows: int, cols: int, back: bool) -> np.ndarray:
    """w^(j k) for j < rows and k < cols, w an n-th root of unity (or its inverse)."""
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    w = pow(w, PRIME - 2, PRIME) if back else w
    table = np.empty(n, np.int64)
    table[0] = 1
    done = 1
    while done < n:  # doubling
        step = min(done, n - done)
        table[done : done + step] = table[:step] * pow(w, done, PRIME) % PRIME
        done += step
    return table[np.outer(np.arange(rows), np.arange(cols)) % n].astype(np.float64)


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in an order that ``inverse`` expects."""
    m, n = a.shape
    if n <= RADIX:
        return _mod(a @ _powers(n, n, n, False))
    inner = n // RADIX
    x = _mod(np.matmul(_powers(RADIX, RADIX, RADIX, False), a.reshape(m, RADIX, inner)))
    x = _mod(x * _powers(n, RADIX, inner, False))
    return transform(x.reshape(m * RADIX, inner)).reshape(m, n)


def inverse(a: np.ndarray) -> np.ndarray:
    """Back again, ``n`` times too large."""
    m, n = a.shape
    if n <= RADIX:
        return _mod(a @ _powers(n, n, n, True))
    inner = n // RADIX
    x = inverse(a.reshape(m * RADIX, inner)).reshape(m, RADIX, inner)
    x = _mod(x * _powers(n, RADIX, inner, True))
    return _mod(np.matmul(_powers(RADIX, RADIX, RADIX, True), x)).reshape(m, n)


def mismatch(block: np.ndarray, window: np.ndarray, shifts: int) -> np.ndarray:
    """Sums of squared differences of each row's block with its window at shifts 0, 1, ..., modulo ``PRIME``."""
    m, b = block.shape
    n = 1 << max(1, (window.shape[1] - 1).bit_length())
    x = np.zeros((m, n))
    x[:, 0] = block[:, 0]
    x[:, n - b + 1 :] = block[:, :0:-1]  # reversed, so that the product is a correlation
    y = np.zeros((m, n))
    y[:, : window.shape[1]] = window
    product = inverse(_mod(transform(x) * transform(y)))[:, :shifts]
    _mod(product)
    product *= pow(n, PRIME - 2, PRIME)
    _mod(product)
    square = np.zeros((m, window.shape[1] + 1))
    np.cumsum(_mod(window * window), 1, out=square[:, 1:])
    energy = square[:, b : b + shifts] - square[:, :shifts] + _mod(block * block).sum(1, keepdims=True)
    return np.remainder(energy - 2.0 * product, PRIME)


def _equal_ahead(x: np.ndarray, i: np.ndarray, d: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``i`` on (backwards for step -1) equal those ``d`` later, at most ``room``."""
    n = np.zeros(len(i), np.int64)
    on, width = np.flatnonzero(room > 0), 16
    while len(on):
        rows = max(1, BATCH // width)
        left = []
        for part in (on[k : k + rows] for k in range(0, len(on), rows)):
            reach = np.arange(width)
            at = i[part, None] + step * (n[part, None] + reach)
            inside = n[part, None] + reach < room[part, None]
            at = np.where(inside, at, i[part, None])
            same = inside & (x[at] == x[at + np.where(inside, d[part, None], 0)])
            run = np.where(same.all(1), width, np.argmin(same, 1))
            n[part] += run
            left.append(part[(run == width) & (n[part] < room[part])])
        on, width = np.concatenate(left), min(2 * width, 1 << 14)
    return n


def _smallest_periods(s: np.ndarray) -> np.ndarray:
    """Stretches (start, end, period) in order, each with the smallest of its periods."""
    s = s[np.lexsort((s[:, 2], s[:, 1], s[:, 0]))]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:, :2] != s[:-1, :2]).any(1)
    return s[new]


class _Search:
    """Runs of all rows of a slice."""

    def __init__(self, x: np.ndarray, first: np.ndarray, min_length: int):
        self.x, self.first, self.min_length = x, first, min_length
        self.values = x.astype(np.float64)
        size = np.diff(first)
        self.stop = np.repeat(first[1:], size)
        self.start = np.repeat(first[:-1], size)
        row = np.repeat(np.arange(len(size)), size)
        order = np.argsort(row * (int(x.max()) + 1 if len(x) else 1) + x, kind="stable")
        ahead = np.full(len(x), np.iinfo(np.int32).max, np.int64)
        same = (x[order[1:]] == x[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
        self.ahead = ahead  # words until the same word comes again
        self.cover_end, self.cover_period = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
        self.found: list[np.ndarray] = []

    def run(self) -> np.ndarray:
        """Rows (start, end, period) of all runs, sorted, in places of the slice."""
        least = -(-self.min_length // 2)
        b = 1
        while 2 * (2 * b) - 1 <= least:
            b *= 2
        far, width, low = self.ahead, 1, 1
        longest = int(np.diff(self.first).max(initial=0))
        while longest >= max(self.min_length, 2 * low):
            block = min(b, LONGEST)
            while width < block:
                far = np.maximum(far[:-width], far[width:]) if len(far) > width else far[:0]
                width *= 2
            self._scale(b, block, low, 4 * b, far)
            low, b = 4 * b, 2 * b
        if not self.found:
            return np.zeros((0, 3), np.int64)
        return _smallest_periods(np.concatenate(self.found))

    def _scale(self, stride: int, b: int, low: int, high: int, far: np.ndarray) -> None:
        """Seeds of blocks of ``b`` words at multiples of ``stride``, at distances low <= d < high."""
        size = np.diff(self.first)
        n = np.maximum((size - low - b) // stride + 1, 0)
        n[size < max(self.min_length, 2 * low)] = 0
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(self.first[:-1], n) + k * stride
        at = at[far[at] < high] if len(at) else at
        if not len(at):
            return
        reach = np.minimum(self.stop[at], at + high - 1 + b)
        at = at[~((self.cover_end[at] >= reach) & (self.cover_period[at] <= b))]
        seeds = []
        section = min(high - low, max(2 * b, 8))
        for d in range(low, high, section):
            seeds.append(self._seeds(at, b, d, min(section, high - d)))
        at, d = (np.concatenate(x) for x in zip(*seeds, strict=True))
        known = (self.cover_end[at] >= at + d + b) & (d % self.cover_period[at] == 0)
        self._extend(at[~known], d[~known], stride, b)

    def _seeds(self, at: np.ndarray, b: int, low: int, shifts: int) -> tuple[np.ndarray, np.ndarray]:
        width = shifts + b - 1
        rows = max(1, BATCH // (2 * width))
        places, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in (at[k : k + rows] for k in range(0, len(at), rows)):
            part = part[part + low + b <= self.stop[part]]
            if not len(part):
                continue
            ahead = part[:, None] + low + np.arange(width)
            inside = ahead < self.stop[part][:, None]
            window = np.where(inside, self.values[np.minimum(ahead, len(self.x) - 1)], 0.0)
            zero = mismatch(self.values[part[:, None] + np.arange(b)], window, shifts) == 0
            zero &= part[:, None] + low + np.arange(shifts) + b <= self.stop[part][:, None]
            r, s = np.nonzero(zero)
            places.append(part[r])
            distances.append(s + low)
        return np.concatenate(places), np.concatenate(distances)

    def _extend(self, at: np.ndarray, d: np.ndarray, stride: int, b: int) -> None:
        order = np.lexsort((at, d))
        at, d = at[order], d[order]
        stretches = []
        while len(at):
            head = np.r_[True, (d[1:] != d[:-1]) | (at[1:] != at[:-1] + stride) | (self.start[at[1:]] != self.start[at[:-1]])]
            i, q = at[head], d[head]
            right = _equal_ahead(self.x, i, q, self.stop[i] - q - i, 1)
            good = right >= b
            back = _equal_ahead(self.x, i[good] - 1, q[good], i[good] - self.start[i[good]], -1)
            stretches.append(np.stack([i[good] - back, i[good] + right[good] + q[good], q[good]], 1))
            reached = np.where(good, i + right, i + 1)[np.cumsum(head) - 1]
            rest = at + b > reached  # behind a chain's end, or behind a sum that was zero by chance
            rest[head] = False
            at, d = at[rest], d[rest]
        if not stretches:
            return
        s = np.concatenate(stretches)
        s = _smallest_periods(s[s[:, 1] - s[:, 0] >= np.maximum(self.min_length, 2 * s[:, 2])])
        self.found.append(s)
        for start, end, q in s.tolist():
            cover = self.cover_end[start:end]
            less = cover < end
            self.cover_period[start:end][less] = q
            cover[less] = end


def word_runs(first: np.ndarray, hashes: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, end, period) of the runs of all rows, in places of the slice."""
    _, x = np.unique(hashes, return_inverse=True)
    return _Search(x.astype(np.int64), first, min_length).run()


def _report(w: W.Words, runs: np.ndarray) -> pa.Array:
    """One struct for each row of a slice."""
    rows = len(w.first) - 1
    edge = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    kept = np.cumsum(edge)[:-1] <= 0
    row = np.searchsorted(w.first, runs[:, 0], "right") - 1
    at = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
    items = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - w.first[row]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"]
    )
    joined, offsets = W.joined_rows(w, kept)
    text = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(joined)).cast(pa.string())
    return pa.StructArray.from_arrays([pa.array(w.counts()), pa.ListArray.from_arrays(at, items), text], ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *, text: str = "text", out: str = "periodic", min_length: int = MIN_LENGTH) -> DataFrame:
    """Add struct ``out``: ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` holds the words that lie in the first period of every run that
    contains them, or in none, joined by single spaces.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")

    @F.arrow_udf(_TYPE)
    def search(column: pa.Array) -> pa.Array:
        parts = []
        for lo, hi in W.slices(column):
            w = W.words_of(column[lo:hi], lower=False)
            parts.append(_report(w, word_runs(w.first, W.hash_words(w), min_length)))
        return pa.concat_arrays(parts)

    return docs.withColumn(out, search(F.col(text).cast("string")))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The texts that the query searches: for a tenth of the ids, a tail of the words repeats a stretch of them."""
    h = F.crc32(doc_id.cast("bigint").cast("string").cast("binary"))
    g = F.floor(h / 10)
    word = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(word)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice(word, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(word, F.lit(1), a), tail), " ")).otherwise(text)


def run_digest(docs: DataFrame) -> DataFrame:
    """Per document: its runs' number, the longest one, and digests of all runs and of the collapsed text."""
    rows = docs.select("doc_id", repeated_tail(F.col("text").cast("string"), F.col("doc_id")).alias("text"))
    found = periodic_runs(rows)
    best = F.array_max(F.transform("periodic.runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("periodic.runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.size("periodic.runs").cast("bigint").alias("n_runs"),
        (-best["back"]).alias("start"), best["length"].alias("length"), (-best["less"]).alias("period"),
        lines.alias("__lines"), F.col("periodic.collapsed").alias("__collapsed"),
    ).select(
        "doc_id", "n_runs", "start", "length", "period",
        F.floor(1000 * F.col("length") / F.col("period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("__lines", F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("__collapsed", 256).alias("collapsed_sha256"),
    )
