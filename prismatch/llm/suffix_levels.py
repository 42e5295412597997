"""Removal of byte strings that occur earlier in the corpus, by families of suffix arrays.

Every string of ``LENGTH`` bytes elects one of its grams of ``GRAM`` bytes: the one
with the smallest hash, the leftmost of equals. Equal strings elect equal grams,
so a string can recur only where its gram does, and all strings that could be
equal meet in the slice of their gram.

1. Elected grams are counted over the corpus, added up per block of documents
   first. Only those counted twice or more go on.
2. Each block of documents cuts the *context* of every recurring gram out of its
   texts: all strings that elect it, laid over each other. Contexts that the
   block has earlier as a whole are told once.
3. A slice takes its contexts in the order of the documents, batch by batch. A
   batch gets a suffix array of its strings and is scanned against the suffix
   arrays of all levels; what is found there, or earlier in the batch, is removed,
   and what is new becomes a level. Levels of similar size are merged, so that
   their sizes grow geometrically (`Levels`).

Slices are cut fine enough by the size of the corpus that one fits in memory
whatever the repeated share; a task holds one at a time and reads a sorted stream.
A gram counted more than ``HOT`` times is split: each of its strings goes to a
slice of its own hash, as a fingerprint of 128 bits instead of its bytes. So no
slice holds more than a row per block for a string of such a gram.

Defined cases: null has no bytes; texts under ``LENGTH`` bytes lose nothing;
repeated rows of one document share its places, so none removes the other's
bytes; rows without an id count as one document behind all others, in which only
an earlier start removes; other columns stay, except one named like ``out``,
which is an error. Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prismatch.llm import words as W
from prismatch.llm.blocks import NO_ID, block_of

LENGTH = 100
GRAM = 32
SPREAD = LENGTH - GRAM + 1  # grams of a string
HOT = 4096
#: bytes of text for each slice of contexts, and contexts of a batch
SLICE_TEXT = 256 << 10
BATCH = 512
_PIECE = 256 << 10
_CONTEXTS = "slice bigint, block bigint, doc bigint, twin bigint, at int, n int, context binary"
_RUNS = "block bigint, doc bigint, twin bigint, s int, e int"
_CUT_FIELDS = "n_bytes bigint, n_removed bigint, spans array<struct<s:int,e:int>>, kept binary"


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the first byte in it, bytes, offsets); long texts come in pieces that overlap."""
    for lo, hi in W.slices(column, _PIECE):
        buf, offsets = W.text_bytes(column[lo:hi], lower=False)
        if hi - lo > 1 or offsets[-1] <= 2 * _PIECE:
            yield lo, 0, buf, offsets
            continue
        for s in range(0, int(offsets[-1]), _PIECE):
            stop = min(s + _PIECE + LENGTH - 1, int(offsets[-1]))
            yield lo, s, buf[s : stop + 8], np.array([0, stop - s])


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    n = len(buf) - 8 - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    h = eight[:n] * W._P1
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(32)
        h += eight[k : n + k]
        h *= W._P2
    return W.mix(h)


def elected(grams: np.ndarray) -> np.ndarray:
    """For each place, that of the leftmost smallest gram among the next ``SPREAD``."""
    best, at, width = grams, np.arange(len(grams), dtype=np.int32), 1
    while width < SPREAD and len(best):
        step = min(width, SPREAD - width)
        left, right = best[:-step], best[step:]
        at = np.where(right < left, at[step:], at[:-step])
        best = np.minimum(left, right)
        width += step
    return at


def _strings(offsets: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of the strings that elect one gram, the gram's place and the row."""
    at = elected(grams)
    edge = np.zeros(len(at) + 1, np.int8)
    begin, end = offsets[:-1], offsets[1:] - LENGTH + 1
    long = end > begin
    edge[begin[long]], edge[end[long]] = 1, -1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = at[1:] != at[:-1]
    first = np.flatnonzero(inside & (change[:-1] | np.r_[True, ~inside[:-1]][: len(at)]))
    last = np.flatnonzero(inside & (change[1:] | np.r_[~inside[1:], True][: len(at)]))
    return first, last, at[first].astype(np.int64), np.searchsorted(offsets, first, "right") - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, n): elected grams of a batch of (block, text)."""
    for b in batches:
        gram, block = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        blocks = b.column(0).to_numpy()
        for lo, _, buf, offsets in _pieces(b.column(1)):
            grams = gram_hashes(buf)
            _, _, at, row = _strings(offsets, grams)
            gram.append(W.signed(grams[at]))
            block.append(blocks[lo + row])
        gram, block = np.concatenate(gram), np.concatenate(block)
        order = np.lexsort((block, gram))
        gram, block = gram[order], block[order]
        new = np.ones(len(order), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])
        head = np.flatnonzero(new)
        yield pa.record_batch([pa.array(gram[head]), pa.array(block[head]), pa.array(np.diff(np.r_[head, len(order)]))], ["gram", "block", "n"])


def _bytes_of(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    edge = np.concatenate([[0], np.cumsum(size)])
    flat = np.arange(int(edge[-1])) + np.repeat(starts - edge[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(buf[flat])])


def _contexts(n_slices: int):
    """One block: its recurring grams' contexts, each told once, and the runs of strings that the block has earlier."""
    schema = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("context", pa.binary())])

    def extract(docs: pa.Table, keys: pa.Table) -> pa.Table:
        if not docs.num_rows or not keys.num_rows:
            return schema.empty_table()
        docs, shard = docs.combine_chunks(), keys["gram"].to_numpy()
        order = np.argsort(shard)
        shard, hot = shard[order], keys["hot"].to_numpy()[order]
        text, ids, twins = docs["text"].chunk(0), docs["id"].fill_null(NO_ID).to_numpy(), docs["twin"].to_numpy()
        number = docs["block"][0].as_py()
        bufs, rows = [], []
        for lo, skipped, buf, offsets in _pieces(text):
            grams = gram_hashes(buf)
            first, last, at, row = _strings(offsets, grams)
            key = W.signed(grams[at])
            where = np.minimum(np.searchsorted(shard, key), len(shard) - 1)
            on = shard[where] == key
            if not on.any():
                continue
            first, last, key, row, split = first[on], last[on], key[on], row[on], hot[where[on]]
            n = np.where(split, last - first + 1, 1)  # a hot gram's strings one by one
            piece = np.repeat(np.arange(len(first)), n)
            step = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
            split, start, row = split[piece], first[piece] + step, row[piece]
            n = np.where(split, 1, (last - first + 1)[piece])
            whole = W.signed(W.hash_spans(buf, start, start + n + LENGTH - 1))
            key = key[piece]
            key[split] = W.signed(_fingerprint(grams, start[split]))
            bufs.append(buf)
            own = np.full(len(start), len(bufs) - 1)
            rows.append((key, whole, ids[lo + row], twins[lo + row], start - offsets[row] + skipped, n, split, own, start))
        if not rows:
            return schema.empty_table()
        key, whole, doc, twin, place, n, split, own, start = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((place, doc, n, whole, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (whole[order][1:] != whole[order][:-1]) | (n[order][1:] != n[order][:-1])
        head = np.flatnonzero(new)
        leader = np.repeat(order[head], np.diff(np.r_[head, len(order)]))
        behind = order[(doc[order] > doc[leader]) | (place[order] > place[leader])]
        out = [_gone(schema, number, doc[behind], twin[behind], place[behind], place[behind] + n[behind])]
        first = order[head]
        for k, buf in enumerate(bufs):
            mine = first[(own[first] == k) & ~split[first]]
            part = np.mod(W.signed(W.mix(key[mine].view(np.uint64))), n_slices)
            out.append(_table(schema, part, number, doc[mine], twin[mine], place[mine], n[mine], _bytes_of(buf, start[mine], n[mine] + LENGTH - 1)))
        mine = first[split[first]]
        pair = np.ascontiguousarray(np.stack([key[mine], whole[mine]], 1)).view(np.uint8).ravel()
        prints = _bytes_of(pair, np.arange(len(mine)) * 16, np.full(len(mine), 16))
        out.append(_table(schema, n_slices + np.mod(whole[mine], n_slices), number, doc[mine], twin[mine], place[mine], n[mine], prints))
        return pa.concat_tables(out)

    return extract


def _fingerprint(grams: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of the strings that is independent of ``hash_spans``."""
    h = np.zeros(len(start), np.uint64)
    for k in (*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM):
        h = W.mix((h + grams[start + k]) * W._P3)
    return h


def _table(schema: pa.Schema, part, block: int, doc, twin, place, n, context: pa.Array) -> pa.Table:
    return pa.table([pa.array(part, pa.int64()), pa.repeat(pa.scalar(block, pa.int64()), len(doc)), pa.array(doc), pa.array(twin), pa.array(place, pa.int32()), pa.array(n, pa.int32()), context], schema=schema)


def _merged(s: np.ndarray, e: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs [s, e) of starts with what they belong to; those that touch are joined."""
    order = np.lexsort((s, *of[::-1]))
    s, e, of = s[order], e[order], [x[order] for x in of]
    new = np.ones(len(order), bool)  # runs of one document end in the order in which they start
    new[1:] = s[1:] > e[:-1]
    for x in of:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return s[head], np.maximum.reduceat(e, head) if len(head) else e, *(x[head] for x in of)


def _gone(schema: pa.Schema, block: int, doc: np.ndarray, twin: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Table:
    """Runs already known: rows without a context, dealt by document."""
    s, e, doc, twin = _merged(s, e, doc, twin)
    return _table(schema, -1 - np.mod(doc, 1 << 20), block, doc, twin, s, e - s, pa.nulls(len(doc), pa.binary()))


class Levels:
    """A logarithmic family of suffix arrays: batches go in, and each learns which of its strings came before."""

    def __init__(self, width: int):
        self.width = width
        #: sorted distinct strings, with document and place of the first of each; sizes at least halve from one to the next
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, strings: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which strings (in the order of doc and place) occurred at an earlier place."""
        order = np.argsort(strings, kind="stable")  # the batch's suffix array
        ranked = strings[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(order)])
        distinct, first_doc, first_place = ranked[head], doc[order[head]], place[order[head]]
        fresh = np.ones(len(head), bool)
        for level, level_doc, level_place in self.levels:
            at = np.minimum(np.searchsorted(level, distinct), len(level) - 1)
            same = level[at] == distinct
            first_doc = np.where(same, level_doc[at], first_doc)
            first_place = np.where(same, level_place[at], first_place)
            fresh &= ~same
        earlier = np.empty(len(order), bool)
        earlier[order] = (doc[order] > np.repeat(first_doc, size)) | (place[order] > np.repeat(first_place, size))
        self._insert((distinct[fresh], first_doc[fresh], first_place[fresh]))
        return earlier

    def _insert(self, level: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        if not len(level[0]):
            return
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            level = tuple(np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True))
            order = np.argsort(level[0], kind="stable")  # merges two sorted runs
            level = tuple(x[order] for x in level)
        self.levels.append(level)


class _Slice:
    """One slice's contexts, taken in the order of their documents."""

    def __init__(self) -> None:
        self.families: dict[int, Levels] = {}
        self.whole: dict[bytes, tuple[int, int]] = {}

    def add(self, doc: np.ndarray, at: np.ndarray, n: np.ndarray, context: pa.Array) -> tuple[np.ndarray, ...]:
        """Runs [s, e) of strings that came before, and the contexts they are from."""
        raw = context.to_pylist()
        seen = [self.whole.setdefault(c, (d, p)) for c, d, p in zip(raw, doc.tolist(), at.tolist(), strict=True)]
        first = np.array(seen, np.int64).reshape(-1, 2)
        known = (doc > first[:, 0]) | (at > first[:, 1])  # equal as a whole
        out = [(at[known], (at + n)[known], np.flatnonzero(known))]
        rest = np.flatnonzero(~known)
        size = np.array([len(x) for x in raw], np.int64)[rest]
        width = size - n[rest] + 1
        for w in np.unique(width):
            mine = rest[width == w]
            family = self.families.setdefault(int(w), Levels(int(w)))
            buf = np.frombuffer(b"".join(raw[k] for k in mine), np.uint8)
            base = np.cumsum(size[width == w]) - size[width == w]
            owner = np.repeat(np.arange(len(mine)), n[mine])
            step = np.arange(len(owner)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
            strings = np.lib.stride_tricks.sliding_window_view(buf, int(w))[base[owner] + step]
            strings = np.ascontiguousarray(strings).view(f"S{w}").ravel()
            d, p = doc[mine][owner], at[mine][owner] + step
            order = np.lexsort((p, d))
            earlier = np.empty(len(order), bool)
            earlier[order] = family.add(strings[order], d[order], p[order])
            out.append((p[earlier], p[earlier] + 1, mine[owner][earlier]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc, twin, s, e): starts of removed strings. Rows come sorted by slice, document and place."""
    number, current = None, _Slice()
    for b in batches:
        part, block, doc, twin, at, n = (b.column(k).to_numpy().astype(np.int64) for k in range(6))
        known = np.flatnonzero(part < 0)
        runs = [(at[known], (at + n)[known], known)]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
        for lo, hi in zip(edges.tolist(), np.r_[edges[1:], len(part)].tolist(), strict=True):
            if part[lo] < 0:
                continue
            if part[lo] != number:
                number, current = part[lo], _Slice()
            for k in range(lo, hi, BATCH):
                own = slice(k, min(k + BATCH, hi))
                s, e, row = current.add(doc[own], at[own], n[own], b.column(6)[own.start : own.stop])
                runs.append((s, e, row + k))
        s, e, row = (np.concatenate(x) for x in zip(*runs, strict=True))
        s, e, block, doc, twin = _merged(s, e, block[row], doc[row], twin[row])
        yield pa.record_batch([pa.array(block), pa.array(doc), pa.array(twin), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["block", "doc", "twin", "s", "e"])


def _rows(docs: DataFrame, doc_id: str, text: str, extra: dict[str, str]) -> DataFrame:
    """``block, id, twin, text`` and the extra columns by their new names."""
    value = F.col(f"`{text}`").cast("string")
    own = [F.col(f"`{old}`").alias(new) for new, old in extra.items()]
    return docs.select(block_of(docs, doc_id, text).alias("block"), F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.xxhash64(value).alias("twin"), value.alias("text"), *own)


def _starts(rows: DataFrame) -> DataFrame:
    """``block, id, twin, s, e``: runs [s, e) of byte places at which a string begins that starts earlier in the corpus."""
    rows = rows.select("block", "id", "twin", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = rows.select("block", "text").mapInArrow(_counts, "gram bigint, block bigint, n bigint")
    n = F.sum("n").over(Window.partitionBy("gram"))
    keys = counted.withColumn("n", n).where("n > 1").select("block", "gram", (F.col("n") > HOT).alias("hot"))
    contexts = rows.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(_contexts(1 + int(total) // SLICE_TEXT), _CONTEXTS)
    return contexts.repartition("slice").sortWithinPartitions("slice", "doc", "at").mapInArrow(_settle, _RUNS)


def repeated_starts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, twin, s, e``: runs [s, e) of byte places at which a string begins that starts earlier in the corpus.

    ``twin`` is the text's hash: rows that share an id, or have none (``doc`` is then
    the largest bigint), may differ in their texts.
    """
    return _starts(_rows(docs, doc_id, text, {})).drop("block")


def _cut(column: pa.Array, owner: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """Sizes, removed runs and kept bytes of all texts; runs of starts come sorted by the row that owns them."""
    out = []
    for lo, hi in W.slices(column):
        spare, offsets = W.text_bytes(column[lo:hi], lower=False)
        own = slice(*np.searchsorted(owner, (lo, hi)))
        base = offsets[owner[own] - lo]
        edge = np.zeros(len(spare) - 7, np.int64)
        np.add.at(edge, base + s[own], 1)
        np.add.at(edge, base + e[own] - 1 + LENGTH, -1)
        gone = np.zeros(len(spare) - 6, bool)  # a kept byte before and behind
        np.greater(np.cumsum(edge)[:-1], 0, out=gone[1:-1])
        begin, end = gone[1:] & ~gone[:-1], gone[:-1] & ~gone[1:]
        inner = offsets[1:-1]
        both = inner[gone[inner] & gone[np.minimum(inner + 1, len(gone) - 1)]]  # a run ends with its text
        begin[both] = end[both] = True
        first, last = np.flatnonzero(begin), np.flatnonzero(end)
        row = np.searchsorted(offsets, first, "right") - 1
        kept = np.concatenate([[0], np.cumsum(~gone[1:-1])])
        at = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
        spans = pa.StructArray.from_arrays([pa.array(first - offsets[row], pa.int32()), pa.array(last - offsets[row], pa.int32())], ["s", "e"])
        rest = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(kept[offsets].astype(np.int32)), pa.py_buffer(spare[:-8][~gone[1:-1]])])
        size = np.diff(offsets)
        out.append(pa.StructArray.from_arrays([pa.array(size), pa.array(size - np.diff(kept[offsets])), pa.ListArray.from_arrays(at, spans), rest], ["n_bytes", "n_removed", "spans", "kept"]))
    return pa.chunked_array(out)


def _row_keys(doc: np.ndarray, twin: np.ndarray) -> np.ndarray:
    return W.mix(doc.view(np.uint64) * W._P1) + twin.view(np.uint64)


def _cutter(columns: list[str]):
    """One block: the given columns of its rows, and what is cut from their texts."""

    def cut(docs: pa.Table, runs: pa.Table) -> pa.Table:
        key = _row_keys(docs["id"].fill_null(NO_ID).to_numpy(), docs["twin"].to_numpy())
        order = np.argsort(key, kind="stable")
        wanted = _row_keys(*(np.ascontiguousarray(runs[c].to_numpy()) for c in ("doc", "twin"))) if runs.num_rows else key[:0]
        lo, hi = np.searchsorted(key[order], wanted, "left"), np.searchsorted(key[order], wanted, "right")
        n = hi - lo  # rows alike share their runs
        of = np.repeat(np.arange(len(wanted)), n)
        owner = order[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        sort = np.argsort(owner, kind="stable")
        s, e = (runs[c].to_numpy().astype(np.int64)[of][sort] if runs.num_rows else np.zeros(0, np.int64) for c in ("s", "e"))
        found = _cut(docs["text"].combine_chunks(), owner[sort], s, e)
        return pa.table([*(docs[c] for c in columns), found], names=[*columns, "cut"])

    return cut


def _cut_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of ``_rows`` and struct ``cut``; texts and runs meet by block, as texts and grams did."""
    schema = StructType([f for f in rows.schema if f.name in columns]).add("cut", StructType.fromDDL(_CUT_FIELDS))
    return rows.groupBy("block").cogroup(_starts(rows).groupBy("block")).applyInArrow(_cutter([f.name for f in schema][:-1]), schema)


def cut_strings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", out: str = "cut") -> DataFrame:
    """Add struct ``out``: ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs of bytes, end exclusive) and ``kept`` (the other bytes)."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    extra = {f"c{k}": c for k, c in enumerate(docs.columns)}
    found = _cut_rows(_rows(docs, doc_id, text, extra), list(extra))
    return found.select(*[F.col(new).alias(old) for new, old in extra.items()], F.col("cut").alias(out))


def string_digest(docs: DataFrame) -> DataFrame:
    """Per document: its bytes, those removed, the number of removed runs and the digest of the rest."""
    found = _cut_rows(_rows(docs, "doc_id", "text", {}), ["id"])
    return found.select(
        F.col("id").alias("doc_id"), "cut.n_bytes", "cut.n_removed", F.size("cut.spans").cast("bigint").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256")
    )
