"""Fill-in-middle arrangement of documents by a piece table.

A document is never copied while it is worked on. It is one descriptor
``(buffer, begin, end)`` over the batch's text, which stays as it is; a second
buffer holds the marks. Cutting splits the descriptor in three, an arrangement
permutes descriptors of text and marks, and digests run over the bytes that the
descriptors point to, in their order. An arranged text is taken apart again at its
marks; the inverse permutation of the descriptors over it restores the document.

Units are lines (``[^\\n]*\\n|[^\\n]+``) or code points. Where a document is cut
and how it is arranged follows from a digest of seed and id alone, so results do
not depend on partitions, order or retries. No shuffle is needed.

Defined cases: a null text is empty; an empty text, one that holds a mark, or one
beyond ``rate`` stays plain (its cuts are null); a null id hashes like an empty
one; repeated rows get equal results; other columns stay, whatever their names,
except one named like ``out``, which is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatch.llm import words as W

SEED = 7
#: prefix, suffix, middle
MARKS = ("<P>", "<S>", "<M>")
#: columns of a cut table: its three parts of text, then the three marks
PREFIX, MIDDLE, SUFFIX, MARK_P, MARK_S, MARK_M = range(6)
ARRANGED = {"psm": (MARK_P, PREFIX, MARK_S, SUFFIX, MARK_M, MIDDLE), "spm": (MARK_S, SUFFIX, MARK_P, PREFIX, MARK_M, MIDDLE)}
FORMS = ("plain", *ARRANGED)
_PIECES = "array<struct<source:string,begin:bigint,end:bigint>>"
_TYPE = f"struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,pieces:{_PIECES},output:string,output_sha256:string>"


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be found again without doubt: none may be empty, lie in another or overlap with one."""
    raw = [m.encode() for m in marks]
    if len(raw) != 3 or not all(raw) or len(set(raw)) < 3:
        raise ValueError("three different marks are needed")
    for a, b in [*permutations(raw, 2), *((m, m) for m in raw)]:
        if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError(f"marks {a!r} and {b!r} may overlap")


class PieceTable:
    """Descriptors of many documents: ``buffer``, ``begin`` and ``end`` have a row for each and a column for each piece."""

    def __init__(self, buffers: list[np.ndarray], buffer: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.buffers, self.buffer, self.begin, self.end = buffers, buffer, begin, end

    @classmethod
    def of_texts(cls, text: np.ndarray, offsets: np.ndarray, marks: tuple[str, ...]) -> PieceTable:
        begin, end = offsets[:-1, None], offsets[1:, None]
        return cls([text, np.frombuffer("".join(marks).encode(), np.uint8)], np.zeros_like(begin), begin, end)

    def cut(self, *at: np.ndarray) -> PieceTable:
        """Split one-piece documents at rising places of their buffer."""
        edges = np.column_stack([self.begin[:, 0], *at, self.end[:, 0]])
        return PieceTable(self.buffers, np.repeat(self.buffer, len(at) + 1, 1), edges[:, :-1], edges[:, 1:])

    def with_marks(self, marks: tuple[str, ...]) -> PieceTable:
        rows = len(self.begin)
        edge = np.cumsum([0, *(len(m.encode()) for m in marks)])
        own = (np.ones((rows, len(marks)), np.int64), np.tile(edge[:-1], (rows, 1)), np.tile(edge[1:], (rows, 1)))
        return PieceTable(self.buffers, *(np.hstack([a, b]) for a, b in zip((self.buffer, self.begin, self.end), own, strict=True)))

    def permute(self, order: np.ndarray) -> PieceTable:
        """Column ``j`` of a row is its former column ``order[row, j]``."""
        return PieceTable(self.buffers, *(np.take_along_axis(x, order, 1) for x in (self.buffer, self.begin, self.end)))

    def sizes(self) -> np.ndarray:
        return self.end - self.begin

    def digests(self) -> list[str]:
        """SHA-256 of every document, fed piece by piece."""
        views, out = [memoryview(b) for b in self.buffers], []
        for source, begin, end in zip(self.buffer.tolist(), self.begin.tolist(), self.end.tolist(), strict=True):
            h = hashlib.sha256()
            for k, a, b in zip(source, begin, end, strict=True):
                if b > a:
                    h.update(views[k][a:b])
            out.append(h.hexdigest())
        return out

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents' bytes written out, and their offsets."""
        size = self.sizes()
        at = np.concatenate([[0], np.cumsum(size.sum(1))])
        out = np.empty(int(at[-1]), np.uint8)
        to = (np.cumsum(size, 1) - size + at[:-1, None]).ravel()
        for k, source in enumerate(self.buffers):
            for s, a, n in zip(*(x.ravel()[(self.buffer.ravel() == k) & (size.ravel() > 0)].tolist() for x in (self.begin, to, size)), strict=True):
                out[a : a + n] = source[s : s + n]
        return out, at


def find(text: np.ndarray, offsets: np.ndarray, mark: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a mark, and the rows that hold them (it must lie inside one row)."""
    m = np.frombuffer(mark.encode(), np.uint8)
    at = np.flatnonzero(text[: max(len(text) - len(m) + 1, 0)] == m[0])
    for k in range(1, len(m)):
        at = at[text[at + k] == m[k]]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + len(m) <= offsets[row + 1]
    return at[inside], row[inside]


def unit_ends(text: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all units, and for each row the number of the first one."""
    stop = np.zeros(len(text), bool)
    if unit == "line":
        stop[:] = text == 0x0A
    elif unit == "char":
        stop[:-1] = (text[1:] & 0xC0) != 0x80
    else:
        raise ValueError(f"unknown unit {unit}")
    last = offsets[1:][np.diff(offsets) > 0] - 1
    stop[last] = True
    ends = np.flatnonzero(stop) + 1
    return ends, np.searchsorted(ends, offsets, "right")


def arrange(text: np.ndarray, offsets: np.ndarray, h: np.ndarray, *, unit: str, rate: int, spm: int, marks: tuple[str, str, str]) -> tuple[PieceTable, np.ndarray, np.ndarray, PieceTable]:
    """The arranged table, forms by number, units of each row and the table of parts (one slice of texts)."""
    rows = len(offsets) - 1
    ends, first = unit_ends(text, offsets, unit)
    n = np.diff(first)
    plain = (np.diff(offsets) == 0) | (h[:, 2] % 100 >= rate)
    for m in marks:
        plain[find(text, offsets, m)[1]] = True
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm, FORMS.index("spm"), FORMS.index("psm")))
    cut = np.sort(h[:, :2] % (n + 1)[:, None], 1)
    edge = np.concatenate([[0], ends])  # the end of unit k of a row, or the row's begin
    place = np.where(cut > 0, edge[np.minimum(first[:-1, None] + cut, len(edge) - 1)], offsets[:-1, None])
    parts = PieceTable.of_texts(text, offsets, marks).cut(place[:, 0], place[:, 1])
    order = np.array([range(6), *ARRANGED.values()])[form]
    table = parts.with_marks(marks).permute(order)
    table.end[plain, 3:] = table.begin[plain, 3:]  # a plain document is its three parts without marks
    return table, form, n, parts


def dismantle(text: np.ndarray, offsets: np.ndarray, form: np.ndarray, marks: tuple[str, str, str]) -> PieceTable:
    """Descriptors over arranged texts in the order of the documents they came from."""
    rows = len(offsets) - 1
    edges = np.repeat(offsets[1:, None], 7, 1)
    edges[:, 0] = offsets[:-1]
    for k, m in enumerate(marks):
        at, row = find(text, offsets, m)
        on = form[row] > 0
        at, row = at[on], row[on]
        slot = np.array([[0] * 6, *ARRANGED.values()])[form[row]]
        col = np.argmax(slot == 3 + k, 1)
        edges[row, col] = at
        edges[row, col + 1] = at + len(m.encode())
    plain = form == 0
    edges[plain, 1:] = offsets[1:][plain, None]
    table = PieceTable([text], np.zeros((rows, 6), np.int64), edges[:, :-1], edges[:, 1:])
    back = np.argsort(np.array([range(6), *ARRANGED.values()]), 1)[form][:, :3]  # the inverse permutation, without marks
    return table.permute(back)


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _characters(text: np.ndarray, table: PieceTable) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return total[table.end] - total[table.begin]


def _arranger(unit: str, rate: int, spm: int, marks: tuple[str, str, str]) -> Callable:
    @F.arrow_udf(_TYPE)
    def udf(column: pa.Array, seeds: pa.Array) -> pa.Array:
        h = np.stack([x.to_numpy(zero_copy_only=False) for x in seeds.flatten()], 1).astype(np.int64) if len(seeds) else np.zeros((0, 4), np.int64)
        out = []
        for lo, hi in W.slices(column):
            spare, offsets = W.text_bytes(column[lo:hi], lower=False)
            text = spare[:-8]
            table, form, n, parts = arrange(text, offsets, h[lo:hi], unit=unit, rate=rate, spm=spm, marks=marks)
            chars = _characters(text, parts)
            plain = form == 0
            used = (table.sizes() > 0).ravel()
            base = np.where(table.buffer == 0, offsets[:-1, None], 0)
            piece = pa.StructArray.from_arrays(
                [pa.array(("text", "mark")).take(pa.array(table.buffer.ravel()[used])), pa.array((table.begin - base).ravel()[used]), pa.array((table.end - base).ravel()[used])],
                ["source", "begin", "end"])
            at = pa.array(np.concatenate([[0], np.cumsum(used.reshape(-1, 6).sum(1))]), pa.int32())
            out.append(pa.StructArray.from_arrays(
                [pa.array(n), pa.array(FORMS).take(pa.array(form)), pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1], mask=plain),
                 pa.ListArray.from_arrays(at, piece), _strings(*table.texts()), pa.array(table.digests(), pa.string())],
                ["n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]))
        return pa.concat_arrays(out)

    return udf


def seeds_of(doc_id: str, seed: int) -> Column:
    """Four unsigned numbers: the first 8-digit groups of the hex SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit(""))), 256)
    return F.struct(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)])


def fill_in_middle(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", out: str = "fim", seed: int = SEED, rate: int = 100, spm: int = 50,
    unit: str = "line", marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Add struct ``out``: units ``n``, ``form``, sizes of prefix and middle in code points, ``pieces`` (descriptors), ``output`` and its digest.

    ``rate`` and ``spm`` are per cent: of documents arranged at all, and of these with the suffix first.
    """
    check_marks(marks)
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    return docs.withColumn(out, _arranger(unit, rate, spm, marks)(F.col(text).cast("string"), seeds_of(doc_id, seed)))


def _forms(column: pa.Array) -> np.ndarray:
    return np.array([FORMS.index(x or "plain") for x in column.to_pylist()], np.int64)


def restored(output: Column | str, form: Column | str, *, marks: tuple[str, str, str] = MARKS) -> Column:
    """The document's text, from an arranged text and its form (null: empty)."""

    @F.arrow_udf("string")
    def udf(column: pa.Array, forms: pa.Array) -> pa.Array:
        parts = []
        for lo, hi in W.slices(column):
            spare, offsets = W.text_bytes(column[lo:hi], lower=False)
            parts.append(_strings(*dismantle(spare[:-8], offsets, _forms(forms[lo:hi]), marks).texts()))
        return pa.concat_arrays(parts)

    return udf(output, form)


def restored_sha256(output: Column | str, form: Column | str, *, marks: tuple[str, str, str] = MARKS) -> Column:
    """Digest of ``restored``, fed piece by piece without writing the text out."""

    @F.arrow_udf("string")
    def udf(column: pa.Array, forms: pa.Array) -> pa.Array:
        out: list[str] = []
        for lo, hi in W.slices(column):
            spare, offsets = W.text_bytes(column[lo:hi], lower=False)
            out += dismantle(spare[:-8], offsets, _forms(forms[lo:hi]), marks).digests()
        return pa.array(out, pa.string())

    return udf(output, form)


def middle_digest(docs: DataFrame) -> DataFrame:
    """Per document: its units, form and cut sizes, the digest of the arranged text and of the text rebuilt from it."""
    found = fill_in_middle(docs.select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output_sha256",
        restored_sha256("fim.output", "fim.form").alias("restored_sha256"),
    )


MIDDLE_SQL = r"""
WITH seeds AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM seeds),
cuts AS (
  SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(l[b + 1:n], ''), '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
