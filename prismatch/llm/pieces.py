"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A slice of texts becomes one array of code points. It is cut wherever no piece
of the vocabulary holds the two neighbouring characters, so nothing can merge
across a cut; equal segments are encoded once. In every round each segment finds
the smallest rank among its pairs, all pairs of that rank merge at once (leftmost
first where they overlap), and finished segments leave the arrays. Ranks whose
merge could make a better pair next to another one of the same rank merge only at
their leftmost place. Runs of spaces merge last and in one step, as repeated leftmost
merges would cut them. Characters that no piece covers
become their bytes.

Defined cases: null and empty texts have no ids and decode to an empty text;
equal rows have equal results; other columns stay. Texts of any length are
encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatch.llm import words as W

SPACE = "▁"
NONE = np.int32(1 << 30)
_MULT = np.uint64(0x9E3779B97F4A7C15)
PIECE_MODEL = "piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """Tables of one model; their size depends on the vocabulary alone."""

    symbol: np.ndarray  # by code point: its symbol, ``n`` where no piece holds the character
    n: int  # symbols: all pieces, then characters that only longer pieces hold
    pieces: int
    joins: np.ndarray  # hashed pairs of symbols that are neighbours inside a piece
    slots: np.ndarray  # open hash table of mergeable pairs
    merged: np.ndarray
    rank: np.ndarray  # by symbol
    single: np.ndarray  # by rank: merge one place of a segment per round
    space: int  # the piece of one space
    spaces: np.ndarray  # [length, place]: the whitespace piece that begins there in a run no longer than the longest piece, else -1
    bytes_from: int  # id of the piece of byte 0
    text: tuple[np.ndarray, np.ndarray]  # bytes of all pieces, offsets
    digits: tuple[np.ndarray, np.ndarray]  # decimal ids with a comma in front, offsets


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(strings) + b"\0" * 8, np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)


def load_vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback):
        raise ValueError("a BPE model with byte fallback, identity normalisation and a space in front is needed")
    normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
    if any(p.type in (4, 5) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    score = np.array([p.score for p in model.pieces])
    symbols = dict(normal)
    for p in normal:
        for c in p:
            symbols.setdefault(c, len(model.pieces) + len(symbols) - len(normal) if c not in normal else normal[c])
    n = len(model.pieces) + len(symbols) - len(normal)
    _, rank = np.unique(-score, return_inverse=True)
    blanks = {len(p): i for p, i in normal.items() if set(p) == {SPACE}}
    if 1 not in blanks or any(SPACE in p[1:] for p in normal if set(p) != {SPACE}):
        raise ValueError("spaces may only lead a piece")
    runs = [i for k, i in blanks.items() if k > 1]
    if runs and not (np.ptp(score[runs]) == 0 and score[runs[0]] < min(score[i] for p, i in normal.items() if len(p) > 1 and i not in runs)):
        raise ValueError("whitespace pieces must be the last to merge")
    longest = max(blanks)
    if any(_run_pieces(k, blanks) != [longest] * (k // longest) + _run_pieces(k % longest, blanks) for k in range(longest, 4 * longest)):
        raise ValueError("runs of spaces must begin with the longest whitespace piece")
    spaces = np.full((longest + 1, longest), -1, np.int32)
    for k in range(1, longest + 1):
        at = 0
        for part in _run_pieces(k, blanks):
            spaces[k, at] = blanks[part]
            at += part
    single = np.zeros(rank.max() + 1, bool)
    pairs, joins = {}, set()
    counted = np.bincount(rank[[i for p, i in normal.items() if len(p) > 1]], minlength=len(single))
    single |= counted > 1
    for p, i in normal.items():
        if len(p) < 2 or set(p) == {SPACE}:
            continue
        joins.update((symbols[a], symbols[b]) for a, b in zip(p, p[1:], strict=False))
        for k in range(1, len(p)):
            a, b = symbols.get(p[:k]), symbols.get(p[k:])
            if a is not None and b is not None:
                pairs[a * (n + 1) + b] = i
    for p, i in normal.items():  # p = left + a, left ends in x, a begins x: merging x may let p take the next x's beginning
        for k in range(2, len(p)) if len(p) > 2 else ():
            left, a = p[:k], p[k:]
            for x in (left[j:] for j in range(len(left) - 1)):
                if len(x) > len(a) and x.startswith(a) and x in normal and rank[i] < rank[normal[x]] and x[len(a) :] in symbols:
                    single[rank[normal[x]]] = True
    table = np.full(0x110000, n, np.int32)
    for c, s in symbols.items():
        if len(c) == 1:
            table[ord(c)] = s
    hashed = np.zeros(1 << 22, bool)
    for a, b in joins:
        hashed[_spread(np.array([a * (n + 1) + b], np.int64), 22)] = True
    bits = max(16, (len(pairs) * 8).bit_length())
    slots, merged = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int32)
    for key, i in pairs.items():
        at = int(_spread(np.array([key], np.int64), bits)[0])
        while slots[at] >= 0:
            at += 1
        slots[at], merged[at] = key, i
    strings = []
    for p in model.pieces:
        strings.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode())
    first_byte = next(i for i, p in enumerate(model.pieces) if p.type == 6)
    return Vocabulary(table, n, len(model.pieces), hashed, slots, merged, rank.astype(np.int32), single, blanks[1], spaces, first_byte, _table(strings), _table([b",%d" % i for i in range(len(model.pieces))]))


def _run_pieces(n: int, blanks: dict[int, int]) -> list[int]:
    """Lengths of the pieces of ``n`` spaces: equal scores, so the leftmost pair that makes a piece merges first."""
    parts, at = [1] * n, 0
    while at < len(parts) - 1:
        if parts[at] + parts[at + 1] in blanks:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            at = max(at - 1, 0)
        else:
            at += 1
    return parts


def _spread(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * _MULT) >> np.uint64(64 - bits)).astype(np.int64)


def _merge_of(v: Vocabulary, key: np.ndarray) -> np.ndarray:
    """Piece of each pair, ``-1`` where none."""
    bits = (len(v.slots) - 64).bit_length() - 1
    at = _spread(key, bits)
    seen = v.slots[at]
    out = np.where(seen == key, v.merged[at], -1)
    on = np.flatnonzero((seen != key) & (seen >= 0))
    while len(on):
        at[on] += 1
        seen = v.slots[at[on]]
        hit = seen == key[on]
        out[on[hit]] = v.merged[at[on[hit]]]
        on = on[(seen >= 0) & ~hit]
    return out


def _merge_rounds(v: Vocabulary, symbol: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that remain of segments that begin at ``start``, and where each segment begins among them."""
    size = np.diff(np.r_[start, len(symbol)])
    final = size.copy()
    out_symbol = symbol.copy()  # a finished segment's symbols lie at its begin
    on = np.flatnonzero(size > 1)
    at = np.arange(size[on].sum()) - np.repeat(np.cumsum(size[on]) - size[on], size[on]) + np.repeat(start[on], size[on])
    s, n = symbol[at], size[on]
    while len(on):
        head = np.cumsum(n) - n
        seg = np.repeat(np.arange(len(on)), n)
        inner = np.ones(len(s), bool)
        inner[head + n - 1] = False  # the last symbol of a segment has no pair
        left = np.flatnonzero(inner)
        got = np.full(len(s), -1, np.int32)
        got[left] = _merge_of(v, s[left].astype(np.int64) * (v.n + 1) + s[left + 1])
        rank = np.where(got >= 0, v.rank[np.maximum(got, 0)], NONE)
        best = np.minimum.reduceat(rank, head)
        take = (rank == best[seg]) & (got >= 0)
        place = np.flatnonzero(take)
        if len(place):
            # of touching places every other one, from the left
            run = np.r_[True, (place[1:] != place[:-1] + 1) | (seg[place[1:]] != seg[place[:-1]])]
            first = np.flatnonzero(run)
            number = np.arange(len(place)) - np.repeat(first, np.diff(np.r_[first, len(place)]))
            keep = number % 2 == 0
            alone = v.single[best[seg[place]]]
            if alone.any():
                lead = np.r_[True, seg[place[1:]] != seg[place[:-1]]]
                keep &= ~alone | lead
            place = place[keep]
            s[place] = got[place]
        drop = np.zeros(len(s), bool)
        drop[place + 1] = True
        done = best == NONE
        if done.any():
            leave = done[seg]
            for_out = np.flatnonzero(leave)
            target = np.arange(len(for_out)) - np.repeat(np.cumsum(n[done]) - n[done], n[done]) + np.repeat(start[on[done]], n[done])
            out_symbol[target] = s[for_out]
            final[on[done]] = n[done]
            drop |= leave
        n = n - np.bincount(seg[place], minlength=len(n))
        s, on, n = s[~drop], on[~done], n[~done]
    keep = np.repeat(final, size) > np.arange(len(symbol)) - np.repeat(start, size)
    return out_symbol[keep], np.cumsum(final) - final


def encode_slice(v: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the offsets of each."""
    length = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    joined = "".join(SPACE + t for t in texts if t).replace(" ", SPACE).encode("utf-32-le", "surrogatepass")
    if not joined:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(joined + b"\0" * 8, np.uint8)
    code = np.frombuffer(joined, "<u4")
    symbol = v.symbol[code]
    cut = np.ones(len(code), bool)
    cut[1:] = ~v.joins[_spread(symbol[:-1].astype(np.int64) * (v.n + 1) + symbol[1:], 22)]
    row_begin = np.cumsum(length) - length
    cut[row_begin[length > 0]] = True
    begin = np.flatnonzero(cut)
    end = np.r_[begin[1:], len(code)]
    _, one, which = np.unique(W.hash_spans(raw, begin * 4, end * 4), return_index=True, return_inverse=True)
    size = end - begin
    flat = np.arange(len(code))
    twin = flat - np.repeat(begin, size) + np.repeat(begin[one[which]], size)
    if (size != size[one[which]]).any() or (code != code[np.minimum(twin, len(code) - 1)]).any():  # equal hashes of unequal segments
        one = which = np.arange(len(begin))
    own = size[one]
    at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[one], own)
    start = np.cumsum(own) - own
    left, left_begin = _merge_rounds(v, symbol[at], start)
    # characters without a piece become bytes: one id for each
    count = np.diff(np.r_[left_begin, len(left)])
    origin = np.repeat(np.arange(len(one)), count)
    bare = np.flatnonzero(left >= v.pieces)
    if len(bare):
        # the segment of an uncovered character is that character alone, or holds only single characters around it
        place = _places(v, left, left_begin, at, start, bare, origin)
        utf8 = [chr(int(c)).encode("utf-8", "surrogatepass") for c in code[place]]
        extra = np.ones(len(left), np.int64)
        extra[bare] = [len(b) for b in utf8]
        ids = np.repeat(left, extra)
        first = np.cumsum(extra) - extra
        filled = np.concatenate([np.frombuffer(b, np.uint8) for b in utf8]).astype(np.int32) + v.bytes_from
        spot = np.repeat(first[bare], extra[bare]) + np.arange(len(filled)) - np.repeat(np.cumsum(extra[bare]) - extra[bare], extra[bare])
        ids[spot] = filled
        count = np.bincount(origin, extra, len(one)).astype(np.int64)
    else:
        ids = left
    base = np.cumsum(count) - count
    n = count[which]
    out = ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(base[which], n)].astype(np.int32)
    total = np.concatenate([[0], np.cumsum(n)])
    offsets = total[np.searchsorted(begin, np.r_[row_begin, len(code)])]
    return _space_runs(v, out, offsets)


def _places(v: Vocabulary, left, left_begin, at, start, bare, origin) -> np.ndarray:
    """Character place of uncovered symbols: the characters that the symbols before them in the segment hold are counted."""
    width = np.ones(v.n + 1, np.int64)
    chars = np.diff(v.text[1])  # bytes; recount in characters below
    buf, off = v.text
    lead = np.concatenate([[0], np.cumsum((buf[: off[-1]] & 0xC0) != 0x80)])
    width[: v.pieces] = np.maximum(lead[off[1:]] - lead[off[:-1]], 1) if len(chars) else 1
    w = width[np.minimum(left, v.n)]
    before = np.cumsum(w) - w
    return at[start[origin[bare]] + before[bare] - before[left_begin[origin[bare]]]]


def _space_runs(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of single spaces inside a row, cut into whitespace pieces."""
    longest = len(v.spaces) - 1
    blank = ids == v.space
    if longest < 2 or not (blank[1:] & blank[:-1]).any():
        return ids, offsets
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    row_first = offsets[:-1][np.diff(offsets) > 0]
    opens[row_first] = blank[row_first]
    first = np.flatnonzero(opens)
    place = np.flatnonzero(blank)
    run = np.searchsorted(first, place, "right") - 1
    size = np.bincount(run, minlength=len(first))
    number = place - first[run]
    chunk = np.minimum(longest, size[run] - number // longest * longest)
    piece = v.spaces[chunk, number % longest]
    head = piece >= 0
    ids = ids.copy()
    ids[place[head]] = piece[head]
    keep = np.ones(len(ids), bool)
    keep[place[~head]] = False
    return ids[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _concat(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table entries of all ids one after another, and where each begins."""
    buf, off = table
    size = (off[1:] - off[:-1])[ids]
    begin = np.concatenate([[0], np.cumsum(size)])
    return buf[np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(off[ids], size)], begin


def decode_slice(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """UTF-8 of each row's text; the space in front of the first piece goes."""
    raw, begin = _concat(v.text, ids)
    raw, at = raw.tobytes(), begin[offsets]
    return [raw[a + 1 : b] if b > a and raw[a] == 0x20 else raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _whole(data: bytes) -> bytes:
    """Broken sequences, which only ids of single bytes can spell, become the replacement character."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode(errors="replace").encode()


def vocabulary_of(spark: SparkSession, model: str):
    return spark.sparkContext.broadcast(load_vocabulary(model))


def encode(docs: DataFrame, model: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of each whole text."""
    shared = vocabulary_of(docs.sparkSession, model)

    def run(column: pa.Array) -> pa.Array:
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo, hi in W.slices(column):
            ids, offsets = encode_slice(shared.value, column[lo:hi].to_pylist())
            parts.append(ids)
            sizes.append(np.diff(offsets))
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))

    return docs.withColumn(out, F.arrow_udf(_hinted(run), "array<int>")(F.col(text).cast("string")))


def decode(rows: DataFrame, model: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text that the ids spell (null ids: an empty text)."""
    shared = vocabulary_of(rows.sparkSession, model)

    def run(column: pa.Array) -> pa.Array:
        lists = column.to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
        flat = np.array([i for x in lists for i in x or ()], np.int64)
        return pa.array([_whole(b).decode() for b in decode_slice(shared.value, flat, offsets)], pa.string())

    return rows.withColumn(out, F.arrow_udf(_hinted(run), "string")(F.col(ids)))


def _hinted(run):
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return run


def token_digest(docs: DataFrame, model: str) -> DataFrame:
    """Per document: its number of ids, their digest and the digest of the decoded text."""
    shared = vocabulary_of(docs.sparkSession, model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = shared.value
        for column in batches:
            n, own, back = [], [], []
            for lo, hi in W.slices(column):
                ids, offsets = encode_slice(v, column[lo:hi].to_pylist())
                n.append(np.diff(offsets))
                raw, begin = _concat(v.digits, ids)
                raw, at = raw.tobytes(), begin[offsets]
                own += [hashlib.sha256(raw[a + 1 : b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                back += [hashlib.sha256(_whole(b)).hexdigest() for b in decode_slice(v, ids, offsets)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n or [np.zeros(0, np.int64)]), pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    digest = F.arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text").cast("string")).alias("d"))
    return found.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
