"""Selection without sorting: a seeded sample of exact size, and order statistics of doubles.

Both narrow a range of numbers digit by digit. Every pass counts, for rows in the
range still open, the next digit; tasks add up their counts before they leave, and
what reaches the driver is one small histogram per group or place, whatever the
number of rows. Nothing is sorted, staged or moved but counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS, DIGIT_BITS = 60, 12
RADIX_BITS = 16


def sample_number(keys: list[str], seed: int) -> Column:
    """A number of ``HASH_BITS`` bits from seed and keys (the first hex digits of a SHA-256)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def bottom_k(df: DataFrame, k: int | Mapping[str, int], keys: list[str], seed: int, *, by: str | None = None) -> DataFrame:
    """The ``k`` rows with the smallest seeded numbers: a sample without replacement, the same under every partitioning.

    With ``by``, ``k`` names a size for each group (others are left out); there
    may be as many groups as the caller can name. Fewer rows than ``k`` are all
    taken. Rows that share their keys come in the order of their other columns.
    """
    sizes = {None: k} if by is None else dict(k)
    number = "number"
    while number in df.columns:
        number += "_"
    rows = df.withColumn(number, sample_number(keys, seed))
    group = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    where = lambda g: F.lit(True) if g is None else group == g
    open_, taken = {g: (0, HASH_BITS, n) for g, n in sizes.items() if n > 0}, []
    while open_:
        counts: dict = {g: {} for g in open_}
        within, digit = F.lit(False), F.lit(None).cast("bigint")
        for g, (prefix, shift, _) in open_.items():
            mine = where(g) & (F.shiftright(number, shift) == prefix)
            within = within | mine
            digit = F.when(mine, F.shiftright(number, max(shift - DIGIT_BITS, 0))).otherwise(digit)
        for r in rows.where(within).groupBy(group.alias("g"), digit.alias("d")).count().collect():  # 4,096 rows a group at most
            counts[r["g"]][r["d"]] = r["count"]
        again = {}
        for g, (prefix, shift, need) in open_.items():
            low, below = max(shift - DIGIT_BITS, 0), 0
            if sum(counts[g].values()) <= need:
                taken.append(where(g) & (F.shiftright(number, shift) == prefix))
                continue
            for d in sorted(counts[g]):
                if below + counts[g][d] > need:
                    break
                below += counts[g][d]
            taken.append(where(g) & (F.shiftright(number, shift) == prefix) & (F.shiftright(number, low) < d))
            if below < need and low:
                again[g] = (d, low, need - below)
            elif below < need:  # rows that share the number in all its bits
                tied = rows.where(where(g) & (F.col(number) == d)).orderBy(*[c for c in df.columns]).limit(need - below)
                taken.append(tied)
        open_ = again
    chosen, tied = F.lit(False), [t for t in taken if isinstance(t, DataFrame)]
    for t in taken:
        if not isinstance(t, DataFrame):
            chosen = chosen | t
    out = rows.where(chosen)
    for t in tied:
        out = out.unionByName(t)
    return out.drop(number)


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles (one zero, NaN last)."""
    raw = np.ascontiguousarray(values + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(np.isnan(values), np.uint64(0xFFFFFFFFFFFFFFFF), np.where(raw & sign, ~raw, raw | sign))


def _from_bits(bits: int) -> float:
    sign = 1 << 63
    raw = bits ^ sign if bits & sign else bits ^ ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _digits(prefixes: list[int], shift: int):
    """Per task: (prefix, digit, rows, smallest, largest) of values whose high bits are one of ``prefixes``."""
    wanted = np.array(sorted(prefixes), np.uint64)
    low = np.uint64(shift - RADIX_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(wanted) << RADIX_BITS
        rows = np.zeros(size, np.int64)
        least, most = np.full(size, np.iinfo(np.uint64).max, np.uint64), np.zeros(size, np.uint64)
        for b in batches:
            bits = _ordered_bits(b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
            at = np.zeros(len(bits), np.int64)
            if shift < 64:
                at = np.minimum(np.searchsorted(wanted, bits >> np.uint64(shift)), len(wanted) - 1)
                keep = wanted[at] == bits >> np.uint64(shift)
                bits, at = bits[keep], at[keep]
            cell = (at << RADIX_BITS) + ((bits >> low) & np.uint64((1 << RADIX_BITS) - 1)).astype(np.int64)
            np.add.at(rows, cell, 1)
            np.minimum.at(least, cell, bits)
            np.maximum.at(most, cell, bits)
        at = np.flatnonzero(rows)
        columns = [wanted[at >> RADIX_BITS].view(np.int64), at & ((1 << RADIX_BITS) - 1), rows[at], least[at].view(np.int64), most[at].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "digit", "n", "least", "most"])

    return run


def values_at(df: DataFrame, value: str, places: list[int]) -> list[float]:
    """The values at 0-based places of the sorted non-null column, by radix selection (four narrow scans at most)."""
    column = df.select(F.col(value).cast("double").alias("v"))
    state = {p: (0, p) for p in places}  # high bits known so far, place among the rows that have them
    found: dict[int, float] = {}
    flip = F.lit(-(1 << 63)).cast("bigint")  # unsigned order of signed numbers
    for shift in range(64, 0, -RADIX_BITS):
        if not state:
            break
        prefixes = sorted({s[0] for s in state.values()})
        parts = column.mapInArrow(_digits(prefixes, shift), "prefix bigint, digit bigint, n bigint, least bigint, most bigint")
        order = lambda c: F.col(c).bitwiseXOR(flip)
        hist = parts.groupBy("prefix", "digit").agg(F.sum("n").alias("n"), F.min(order("least")).alias("least"), F.max(order("most")).alias("most"))
        cells: dict[int, list] = {}
        for r in hist.collect():  # 65,536 rows a place at most
            cells.setdefault(r["prefix"] & ((1 << 64) - 1), []).append((r["digit"], r["n"], r["least"] + (1 << 63), r["most"] + (1 << 63)))
        again = {}
        for p, (prefix, place) in state.items():
            for digit, n, least, most in sorted(cells.get(prefix, [])):
                if place < n:
                    if least == most:
                        found[p] = _from_bits(least)
                    else:
                        again[p] = ((prefix << RADIX_BITS) | digit, place)
                    break
                place -= n
        state = again
    return [found[p] for p in places]
