"""Exact cosine search as tiles of a matrix product.

The gallery is laid out once as an index: blocks of whole entries, one Parquet
row per block with a float32 matrix of at most ``BLOCK_BYTES``. An entry with more than ``hot_rows`` images
is spread over several blocks; such blocks report partial results that Spark
merges, so no entry has to fit into one task. Queries reach the blocks in parts:
they are staged, and parts of at most ``BROADCAST_BYTES`` (by their row count)
are broadcast one after another to tasks that scan the index; the index is never
shuffled. A task answers for all its blocks at once, so what leaves it is bounded
by the queries, not by queries times blocks.

Equal inputs give equal bits: vectors are split into a coarse and a fine part of so
few binary digits that their products and sums are exact in a double, whatever the
order in which a matrix product adds them. Pooled means add their values from the
largest down, in numpy and in Spark alike. Ranks thus need no rounded scores.

A tile never returns its similarities. It returns what the question needs: the
score of a target entry, the number of entries that beat it, the best k entries
of the block, or the partial sums of a loss.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismatch.session import shuffle_width, stage, staging_root

BROADCAST_BYTES = 8 << 20  # a task's work, its vectors in doubles and its held rows follow from it
KERNEL_QUERIES = 2048  # queries whose result rows with one block are formed at once
BLOCK_BYTES = 4 << 20  # of one block's matrix, and so of one row of the index
HELD_ROWS = 1 << 20  # result rows that a task holds before it merges them
TILE_CELLS = 2_000_000  # similarities held at once by a task (16 MB of doubles)
SETTLED_CELLS = 500_000  # of these, looked through at once for what must be exact
EPS = 1e-12

RULES = {"max": 1, "top3": 3, "top5": 5}


def rule_width(rule: str) -> int:
    """Number of views a pooling rule averages."""
    if rule not in RULES:
        raise ValueError(f"unknown pooling rule {rule!r}; expected one of {sorted(RULES)}")
    return RULES[rule]


@dataclass(frozen=True)
class GalleryIndex:
    """A staged gallery: one row per block."""

    blocks: DataFrame
    entry_type: T.DataType
    image_type: T.DataType
    dim: int
    n_rows: int
    n_entries: int
    n_blocks: int
    has_split: bool


def open_index(spark: SparkSession, path: str) -> GalleryIndex:
    """Open an index that :func:`build_index` wrote to ``path``."""
    blocks = spark.read.parquet(path)
    etype, itype = (blocks.schema[c].dataType.elementType for c in ("entries", "images"))
    n = F.size("images")
    row = blocks.agg(
        F.sum(n).alias("rows"), F.max("n_entries").alias("entries"), F.max("n_blocks").alias("blocks"),
        F.max((F.length("matrix") / (4 * n)).cast("int")).alias("dim"), F.max(F.exists("whole", lambda x: ~x)).alias("split"),
    ).first()
    return GalleryIndex(blocks, etype, itype, int(row["dim"]), int(row["rows"]), int(row["entries"]), int(row["blocks"]), bool(row["split"]))


def _arrow_type(t: T.DataType) -> pa.DataType:
    return pa.string() if isinstance(t, T.StringType) else pa.int64()


def _key_type(df: DataFrame, column: str) -> T.DataType:
    t = df.schema[column].dataType
    return T.StringType() if isinstance(t, T.StringType) else T.LongType()


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    if column.null_count or flat.size != len(column) * dim:
        raise ValueError(f"expected vectors of {dim} values without nulls")
    return flat.reshape(-1, dim)


class _Exact:
    """Rows as sums of a coarse part of 26 binary digits of the row's size and a fine part of 22 more.

    Unit rows also have a plain form in single precision, in which a matrix product tells what need not be exact.
    """

    def __init__(self, coarse: np.ndarray, fine: np.ndarray, near: np.ndarray | None = None):
        self.coarse, self.fine, self.near = coarse, fine, near

    def __getitem__(self, rows) -> _Exact:
        return _Exact(self.coarse[rows], self.fine[rows], None if self.near is None else self.near[rows])

    def compared(self, other: _Exact) -> tuple[np.ndarray, float]:
        """All dot products, and how far they may be from those of `dot` (inputs, products and sums are rounded)."""
        if self.near is None or other.near is None:
            return self.dot(other), 0.0
        return self.near @ other.near.T, (self.near.shape[1] + 8) * 2.0**-24

    def of_pairs(self, other: _Exact) -> np.ndarray:
        """Dot products row by row, the same bits as those of `dot`."""
        mixed = np.einsum("ij,ij->i", self.coarse, other.fine) + np.einsum("ij,ij->i", self.fine, other.coarse)
        return np.einsum("ij,ij->i", self.coarse, other.coarse) + mixed

    def dot(self, other: _Exact) -> np.ndarray:
        """All dot products. In each of the three matrix products every sum is exact (up to 4,096 dimensions)."""
        mixed = self.coarse @ other.fine.T + self.fine @ other.coarse.T
        return self.coarse @ other.coarse.T + mixed


def _unit(m: np.ndarray, normalise: bool) -> _Exact:
    m = m.astype(np.float64)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    if normalise:
        m, size = m / np.maximum(size, EPS), np.ones_like(size)
    _, exponent = np.frexp(size)
    grain = np.ldexp(1.0, exponent - 26)
    coarse = np.round(m / grain) * grain
    grain = np.ldexp(1.0, exponent - 48)
    near = m.astype(np.float32) if normalise and np.isfinite(m).all() else None
    return _Exact(coarse, np.round((m - coarse) / grain) * grain, near)


def build_index(
    gallery: DataFrame,
    *,
    entry: str = "entry",
    image: str = "render_id",
    vector: str = "emb",
    block_rows: int = 32768,
    hot_rows: int | None = None,
    path: str | None = None,
) -> GalleryIndex:
    """Shuffle the gallery once into blocks of whole entries and write it.

    Without ``path`` the index is staged for this session; with it, later
    sessions can use :func:`open_index`.
    """
    spark = gallery.sparkSession
    given, largest = hot_rows, block_rows
    src = gallery.select(F.col(entry).alias("entry"), F.col(image).alias("image"), F.col(vector).alias("vector"))
    etype, itype = _key_type(src, "entry"), _key_type(src, "image")
    src = src.withColumn("entry", F.col("entry").cast(etype)).withColumn("image", F.col("image").cast(itype))
    sizes = src.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"))
    top = F.max("dim").alias("dim")
    fit = F.greatest(F.lit(1), F.least(F.lit(largest), F.floor(BLOCK_BYTES / (4 * F.greatest(F.col("dim"), F.lit(1))))))
    many = F.lit(given) if given else F.greatest(F.floor(fit / 2), F.lit(1))
    stats = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("entries"), top, F.count_if(F.col("n") > many).alias("hot")).first()
    if not stats["rows"]:
        raise ValueError("the gallery is empty")
    n_rows, dim = int(stats["rows"]), int(stats["dim"])
    block_rows = max(1, min(largest, BLOCK_BYTES // (4 * max(dim, 1))))
    hot_rows = given or max(block_rows // 2, 1)
    cores = spark.sparkContext.defaultParallelism
    n_blocks = max(math.ceil(n_rows / block_rows), min(cores, math.ceil(n_rows / 256)))
    if stats["hot"]:
        # at most n_rows / hot_rows keys; hinted only while that is small
        hot = sizes.where(F.col("n") > hot_rows).select("entry", F.ceil(F.col("n") / hot_rows).alias("parts"))
        hot = F.broadcast(hot) if stats["hot"] <= 100_000 else hot
        src = src.join(hot, "entry", "left")
    else:
        src = src.withColumn("parts", F.lit(None).cast("bigint"))
    part = F.coalesce(F.pmod(F.xxhash64("image"), F.col("parts")), F.lit(0))
    src = src.select(
        "entry", "image", "vector", F.col("parts").isNull().alias("whole"),
        F.pmod(F.xxhash64("entry", part), F.lit(n_blocks)).alias("block"),
    )

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("entry", "ascending"), ("image", "ascending")])
        m = _matrix(t["vector"], dim)
        cols = [t[c].combine_chunks() for c in ("entry", "image", "whole")]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
        return pa.table(
            [pa.array([t["block"][0].as_py()], pa.int64()), *lists, pa.array([m.tobytes()], pa.binary())],
            names=["block", "entries", "images", "whole", "matrix"],
        )

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("entries", T.ArrayType(etype)),
        T.StructField("images", T.ArrayType(itype)), T.StructField("whole", T.ArrayType(T.BooleanType())),
        T.StructField("matrix", T.BinaryType()),
    ])
    packed = src.groupBy("block").applyInArrow(pack, schema)
    packed = packed.withColumn("n_entries", F.lit(int(stats["entries"]))).withColumn("n_blocks", F.lit(n_blocks))
    path = path or f"{staging_root(spark).rstrip('/')}/prismatch-index-{uuid.uuid4().hex}"
    # a row is a block of megabytes: close row groups by size from the first row on
    packed.write.mode("errorifexists").options(**{"parquet.block.size": 4 * BLOCK_BYTES, "parquet.page.size.row.check.min": 1}).parquet(path)
    blocks = spark.read.schema(packed.schema).parquet(path)
    return GalleryIndex(blocks, etype, itype, dim, n_rows, int(stats["entries"]), n_blocks, stats["hot"] > 0)


class _Block:
    """One gallery block inside a task: rows sorted by entry, then image."""

    def __init__(self, row: dict, dim: int, normalise: bool):
        entries = row["entries"].to_numpy(zero_copy_only=False)
        self.images = row["images"].to_numpy(zero_copy_only=False)
        self.vectors = _unit(np.frombuffer(row["matrix"], np.float32).reshape(-1, dim), normalise)
        change = np.flatnonzero(entries[1:] != entries[:-1]) + 1
        self.starts = np.concatenate([[0], change]).astype(np.int64)
        self.ends = np.concatenate([change, [len(entries)]]).astype(np.int64)
        self.names = entries[self.starts]
        self.whole = row["whole"].to_numpy(zero_copy_only=False)[self.starts].astype(bool)

    def __getitem__(self, e: int) -> _Block:
        """One entry by itself."""
        own, rows = copy(self), slice(self.starts[e], self.ends[e])
        own.images, own.vectors, own.names, own.whole = self.images[rows], self.vectors[rows], self.names[e : e + 1], self.whole[e : e + 1]
        own.starts, own.ends = np.zeros(1, np.int64), self.ends[e : e + 1] - self.starts[e]
        return own

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted entry in this block, or -1."""
        at = np.minimum(np.searchsorted(self.names, wanted), len(self.names) - 1)
        return np.where(self.names[at] == wanted, at, -1)


class _Queries:
    """Queries inside a task; ``entries`` (and ``scores``) of query ``i`` lie from ``head[i]`` to ``head[i + 1]``."""

    def __init__(self, t: pa.Table, dim: int, normalise: bool):
        t = t.sort_by("query_id").combine_chunks()
        self.ids = t["query_id"].to_numpy()
        self.vectors = _unit(_matrix(t["vector"], dim), normalise)
        self.entries = self.scores = None
        self.head = np.arange(len(self.ids) + 1)
        if "entries" in t.column_names:
            lists = t["entries"].combine_chunks()
            self.head = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
            self.entries = lists.flatten().to_numpy(zero_copy_only=False)
            self.scores = t["scores"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if "scores" in t.column_names else None
        elif "entry" in t.column_names:
            self.entries = t["entry"].to_numpy()

    def __getitem__(self, rows: slice) -> _Queries:
        part, own = copy(self), slice(self.head[rows.start], self.head[min(rows.stop, len(self.ids))])
        part.ids, part.vectors, part.head = self.ids[rows], self.vectors[rows], self.head[rows.start : rows.stop + 1] - own.start
        part.entries, part.scores = (None if x is None else x[own] for x in (self.entries, self.scores))
        return part

    def owners(self) -> np.ndarray:
        """The query of each of ``entries``."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.head))

    def pieces(self) -> Iterator[_Queries]:
        """The rows, ``KERNEL_QUERIES`` at a time."""
        for lo in range(0, len(self.ids), KERNEL_QUERIES):
            yield self[lo : lo + KERNEL_QUERIES]


def _leave_own(sim: np.ndarray, ids: np.ndarray, b: _Block) -> None:
    """A query never meets its own image."""
    order = np.argsort(b.images, kind="stable")
    at = np.minimum(np.searchsorted(b.images, ids, sorter=order), len(order) - 1)
    hit = b.images[order[at]] == ids
    sim[np.flatnonzero(hit), order[at[hit]]] = -np.inf


def _similarities(q: _Exact, ids: np.ndarray, b: _Block, own: bool) -> np.ndarray:
    sim = q.dot(b.vectors)
    if own:
        _leave_own(sim, ids, b)
    return sim


def _near_similarities(q: _Exact, ids: np.ndarray, b: _Block, own: bool) -> tuple[np.ndarray, float]:
    sim, slack = q.compared(b.vectors)
    if own:
        _leave_own(sim, ids, b)
    return sim, slack


def _pool(sim: np.ndarray, b: _Block, width: int) -> np.ndarray:
    """Mean of the ``width`` best finite similarities of every entry; -inf where there is none."""
    if width == 1:
        return sim if len(b.starts) == sim.shape[1] else np.maximum.reduceat(sim, b.starts, axis=1)
    out = np.full((sim.shape[0], len(b.starts)), -np.inf)
    lengths = b.ends - b.starts
    if sim.dtype == np.float32:  # as good as these are; long entries are read where they lie
        for e in np.flatnonzero(lengths > 256):
            top = np.partition(sim[:, b.starts[e] : b.ends[e]], lengths[e] - width, axis=1)[:, lengths[e] - width :].astype(float)
            ok = np.isfinite(top)
            n = ok.sum(axis=1)
            out[:, e] = np.where(n > 0, np.where(ok, top, 0.0).sum(axis=1) / np.maximum(n, 1), -np.inf)
        lengths = np.where(lengths > 256, 0, lengths)
    # entries of similar length are padded together, so one long entry does not widen all
    classes = np.where(lengths > 0, np.ceil(np.log2(np.maximum(lengths, 1))), -1).astype(int)
    for size in np.unique(classes[classes >= 0]):
        sel = np.flatnonzero(classes == size)
        wide = int(lengths[sel].max())
        idx = b.starts[sel][:, None] + np.arange(wide)[None, :]
        valid = idx < b.ends[sel][:, None]
        cube = np.where(valid[None], sim[:, np.minimum(idx, sim.shape[1] - 1)], -np.inf)
        if wide > width:
            cube = -np.partition(-cube, width - 1, axis=2)[:, :, :width]
        cube = -np.sort(-cube, axis=2)
        ok = np.isfinite(cube)
        n = ok.sum(axis=2)
        total = np.zeros(n.shape)
        for k in range(cube.shape[2]):  # from the largest down, as _top_mean does
            total = total + np.where(ok[:, :, k], cube[:, :, k], 0.0)
        out[:, sel] = np.where(n > 0, total / np.maximum(n, 1), -np.inf)
    return out


def _settled(q: _Exact, b: _Block, sim: np.ndarray, slack: float, rows: np.ndarray, places: np.ndarray, width: int, digits: int | None):
    """Exact pooled scores of entries (``places``) to ``rows`` of ``sim``, the column of their best image and its cosine.

    ``sim`` is off by at most ``slack``: only images that may be among the best ``width``,
    or show as the best one, are computed exactly. Equal cosines take the first image.
    """
    margin = 2 * slack + (0.0 if digits is None else 10.0**-digits)
    score, best, cosine = np.full(len(rows), -np.inf), b.starts[places], np.full(len(rows), -np.inf)
    lengths = (b.ends - b.starts)[places]
    classes = np.ceil(np.log2(lengths)).astype(int) if len(rows) else lengths
    for size in np.unique(classes):
        sel = np.flatnonzero(classes == size)
        wide = int(lengths[sel].max())
        step = max(1, SETTLED_CELLS // wide)
        for lo in range(0, len(sel), step):
            own = sel[lo : lo + step]
            head = b.starts[places[own]]
            if wide == sim.shape[1]:  # the block's only entry
                cube = sim[rows[own]]
            else:
                column = head[:, None] + np.arange(wide)[None, :]
                cube = sim[rows[own][:, None], np.minimum(column, sim.shape[1] - 1)]
                cube[column >= b.ends[places[own]][:, None]] = -np.inf
            if wide <= width:
                least = cube.min(axis=1)
            else:  # without slack there may be undefined values, which count as the smallest
                least = np.partition(cube, -width, axis=1)[:, -width] if slack else -np.partition(-cube, width - 1, axis=1)[:, width - 1]
            least = np.nextafter((least.astype(float) - margin).astype(cube.dtype), -np.inf, dtype=cube.dtype)
            pair, at = np.divmod(np.flatnonzero(cube >= least[:, None]), wide)
            some = np.isfinite(cube[pair, at])
            pair, at = pair[some], head[pair[some]] + at[some]
            value = np.concatenate([np.zeros(0), *(
                q[rows[own[pair[i : i + 4096]]]].of_pairs(b.vectors[at[i : i + 4096]]) for i in range(0, len(pair), 4096))])
            order = np.lexsort((at, -value, pair))
            nth = np.arange(len(pair)) - np.searchsorted(pair, pair)  # pairs follow each other
            total, n = np.zeros(len(own)), np.minimum(np.bincount(pair, minlength=len(own)), width)
            for k in range(width):  # from the largest down, as _top_mean does
                one = order[nth == k]
                total[pair[one]] += value[one]
            score[own] = np.where(n > 0, total / np.maximum(n, 1), -np.inf)
            shown = _round(value, digits)
            first = np.lexsort((at, -shown, pair))[nth == 0]
            best[own[pair[first]]], cosine[own[pair[first]]] = at[first], shown[first]
    return score, best, cosine


def _round(x: np.ndarray, digits: int | None) -> np.ndarray:
    return x if digits is None else np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _rounded(x, digits: int | None):
    """The same rounding as a column."""
    return x if digits is None else F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def _chunks(n_queries: int, n_rows: int, cells: int = 1) -> Iterator[slice]:
    """Queries that meet ``n_rows`` at once; ``cells`` in single precision take the room of one double."""
    step = max(1, cells * TILE_CELLS // max(n_rows, 1))
    for s in range(0, n_queries, step):
        yield slice(s, min(s + step, n_queries))


def _run(
    index: GalleryIndex,
    queries: DataFrame,
    kernel: Callable[[_Queries, _Block], pa.Table | None],
    schema: T.StructType,
    normalise: bool,
    broadcast_bytes: int = BROADCAST_BYTES,
    merge: Callable[[pa.Table], pa.Table] | None = None,
) -> DataFrame:
    """Run ``kernel`` on every query and block; ``merge`` joins the rows of a task's blocks."""
    spark, dim = queries.sparkSession, index.dim
    queries = stage(queries, "queries")
    targets = F.sum(F.size("entries")) if "entries" in queries.columns else F.lit(0)
    n, targets = queries.agg(F.count(F.lit(1)), targets).first()
    n_parts = max(1, math.ceil((n * (4 * dim + 64) + (targets or 0) * 40) / max(broadcast_bytes, 4 * dim + 64)))
    if n_parts > 1:  # every part is read by itself
        place = F.pmod(F.xxhash64("query_id"), F.lit(n_parts)).cast("int")
        path = f"{staging_root(spark).rstrip('/')}/prismatch-parts-{uuid.uuid4().hex}"
        queries.withColumn("part", place).repartition(min(n_parts, shuffle_width(spark)), "part").write.partitionBy("part").parquet(path)
        shape = T.StructType([*queries.schema.fields, T.StructField("part", T.IntegerType())])
        parts = spark.read.schema(shape).parquet(path)
    tiles = None
    for p in range(n_parts):
        part = (queries if n_parts == 1 else parts.where(F.col("part") == p).drop("part")).toArrow()
        scan = _scanner(spark.sparkContext.broadcast(part), dim, normalise, kernel, merge)
        found = index.blocks.select("entries", "images", "whole", "matrix").mapInArrow(scan, schema)
        tiles = found if tiles is None else tiles.unionByName(found)
    return tiles


def _scanner(shared, dim: int, normalise: bool, kernel, merge):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, held, rows, limit = _Queries(shared.value, dim, normalise), [], 0, HELD_ROWS
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("entries", "images", "whole")}
                block = _Block(row | {"matrix": batch.column("matrix")[i].as_buffer()}, dim, normalise)
                for piece in q.pieces():
                    out = kernel(piece, block)
                    if out is None or not out.num_rows:
                        continue
                    if merge is None:
                        yield from out.to_batches()
                        continue
                    held.append(out)
                    rows += out.num_rows
                    if rows >= limit:
                        held = [merge(pa.concat_tables(held))]
                        rows = held[0].num_rows
                        limit = max(HELD_ROWS, 2 * rows)  # merging again pays only after as much has come
        if held:
            yield from merge(pa.concat_tables(held)).to_batches()

    return scan


def _sums(keys: list[str], values: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Merge that adds ``values`` of equal ``keys``."""

    def merge(t: pa.Table) -> pa.Table:
        out = t.group_by(keys).aggregate([(v, "sum") for v in values])
        return pa.table({c: out[c if c in keys else f"{c}_sum"].cast(t.schema.field(c).type) for c in t.column_names})

    return merge


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _table(schema: T.StructType, columns: list) -> pa.Table:
    kinds = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}
    arrays = [pa.array(c, kinds[type(f.dataType)]) for c, f in zip(columns, schema.fields)]
    return pa.table(arrays, names=schema.names)


def _query_rows(queries: DataFrame, query_id: str, vector: str, **more: str) -> DataFrame:
    qtype = _key_type(queries, query_id)
    cols = [F.col(query_id).cast(qtype).alias("query_id"), F.col(vector).cast("array<float>").alias("vector")]
    return queries.select(*cols, *[F.col(c).alias(n) for n, c in more.items()])


def _asked(index: GalleryIndex, queries: DataFrame, query_id: str, target: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """``query_id, vector`` and ``query_id, entries``: a vector goes once with all its targets (a column of entries or of lists)."""
    many = isinstance(queries.schema[target].dataType, T.ArrayType)
    rows = _query_rows(queries, query_id, vector, entry=target)
    if many:
        rows = rows.withColumn("entry", F.explode("entry"))
    targets = rows.select("query_id", F.col("entry").cast(index.entry_type).alias("entry")).where("entry is not null")
    return rows.select("query_id", "vector").dropDuplicates(["query_id"]), targets.groupBy("query_id").agg(F.collect_set("entry").alias("entries"))


def _mean_down(value: str):
    """Mean of a group of at most five values, added from the largest down as _pool does."""
    best = F.sort_array(F.collect_list(value), asc=False)
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)


def _top_mean(df: DataFrame, keys: list[str], value: str, width: int, digits: int | None, out: str) -> DataFrame:
    """Mean of the best ``width`` values per key (the limit is applied before the shuffle)."""
    if width == 1:
        pooled = df.groupBy(*keys).agg(F.max(value).alias(out))
    else:
        w = Window.partitionBy(*keys).orderBy(F.col(value).desc())
        pooled = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= width)
        pooled = pooled.groupBy(*keys).agg(_mean_down(value).alias(out))
    return pooled.withColumn(out, _rounded(F.col(out), digits))


def target_scores(
    index: GalleryIndex,
    queries: DataFrame,
    *,
    rule: str = "top5",
    query_id: str = "query_id",
    target: str = "entry",
    vector: str = "emb",
    digits: int | None = None,
    exclude_self: bool = False,
    normalise: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Pooled score of one named entry per query row: ``query_id, entry, score``.

    Rows whose entry has no image in the gallery are absent from the result.
    """
    width = rule_width(rule)
    vectors, targets = _asked(index, queries, query_id, target, vector)
    q = vectors.join(targets, vectors["query_id"].eqNullSafe(targets["query_id"])).select(vectors["query_id"], "vector", "entries")
    schema = _schema(("query_id", q.schema["query_id"].dataType), ("entry", index.entry_type), ("value", T.DoubleType()))

    def kernel(qs: _Queries, b: _Block) -> pa.Table | None:
        at, owners = b.find(qs.entries), qs.owners()
        found = np.flatnonzero(at >= 0)
        if not found.size:
            return None
        rows, values = [], []
        order = found[np.argsort(at[found], kind="stable")]
        bounds = np.flatnonzero(np.diff(at[order])) + 1
        for members in np.split(order, bounds):
            e = at[members[0]]
            own = b[e]
            for part in _chunks(len(members), len(own.images)):
                m = members[part]
                asked = qs.vectors[owners[m]]
                if b.whole[e]:
                    sim, slack = asked.compared(own.vectors)
                else:  # its pieces meet later
                    sim, slack = asked.dot(own.vectors), 0.0
                if exclude_self:
                    sim[own.images[None, :] == qs.ids[owners[m]][:, None]] = -np.inf
                if b.whole[e]:
                    rows.append(m)
                    values.append(_settled(asked, own, sim, slack, np.arange(len(m)), np.zeros(len(m), np.int64), width, None)[0])
                    continue
                keep = min(width, sim.shape[1])
                best = -np.partition(-sim, keep - 1, axis=1)[:, :keep]
                rows.append(np.repeat(m, keep))
                values.append(best.ravel())
        rows, values = np.concatenate(rows), np.concatenate(values)
        ok = np.isfinite(values)
        return _table(schema, [qs.ids[owners[rows[ok]]], qs.entries[rows[ok]], values[ok]])

    best = _run(index, q, kernel, schema, normalise, broadcast_bytes)
    if not index.has_split:  # every entry lies in one block, which has pooled it
        return best.select("query_id", "entry", _rounded(F.col("value"), digits).alias("score"))
    return _top_mean(best, ["query_id", "entry"], "value", width, digits, "score")


def entry_ranks(
    index: GalleryIndex,
    queries: DataFrame,
    *,
    rule: str = "top5",
    ties: str = "alphabetical",
    query_id: str = "query_id",
    target: str = "entry",
    vector: str = "emb",
    digits: int | None = None,
    exclude_self: bool = False,
    normalise: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rank of a named entry among all gallery entries: ``query_id, entry, score, rank``.

    ``alphabetical`` breaks equal scores by entry id, ``optimistic`` gives every
    tied entry the best place. Entries without gallery images are not returned.
    """
    if ties not in ("alphabetical", "optimistic"):
        raise ValueError(f"unknown tie policy {ties!r}")
    width = rule_width(rule)
    shared = dict(rule=rule, query_id=query_id, target=target, vector=vector, digits=digits,
                  exclude_self=exclude_self, normalise=normalise, broadcast_bytes=broadcast_bytes)
    truth = target_scores(index, queries, **shared)
    vectors, _ = _asked(index, queries, query_id, target, vector)
    known = truth.groupBy("query_id").agg(F.collect_list(F.struct("entry", "score")).alias("t"))
    q = known.join(vectors, "query_id").select("query_id", "vector", F.col("t.entry").alias("entries"), F.col("t.score").alias("scores"))
    qid = q.schema["query_id"].dataType
    etype = index.entry_type
    schema = _schema(
        ("query_id", qid), ("entry", etype), ("score", T.DoubleType()), ("better", T.LongType()),
        ("other", etype), ("value", T.DoubleType()),
    )
    alphabetical = ties == "alphabetical"

    def kernel(qs: _Queries, b: _Block) -> pa.Table | None:
        found, out = [], []
        split = np.flatnonzero(~b.whole)
        for part in _chunks(len(qs.ids), len(b.images), 2):
            # a query is compared once, whatever the number of its targets
            one = qs[part]
            target, t = one.owners(), one.scores[:, None]
            sim, slack = _near_similarities(one.vectors, one.ids, b, exclude_self)
            pooled = _pool(sim, b, width).astype(float, copy=False)
            theirs = b.names[None, :] == one.entries[:, None]
            # where scores lie so near to a target's that rounding may decide, they are computed exactly
            unsure = (np.abs(pooled[target] - t) <= slack + (0.0 if digits is None else 2 * 10.0**-digits)) & ~theirs & b.whole[None, :]
            near = np.zeros(pooled.shape, bool)
            np.logical_or.at(near, target, unsure)
            rows, places = np.nonzero(near)
            pooled[rows, places] = _settled(one.vectors, b, sim, slack, rows, places, width, None)[0]
            pooled = _round(pooled, digits)[target]
            beats = pooled > t
            if alphabetical:
                beats |= (pooled == t) & (b.names[None, :] < one.entries[:, None])
            beats &= b.whole[None, :] & ~theirs
            found.append(beats.sum(axis=1))
            for e in split:
                own = b[e]
                piece = one.vectors.dot(own.vectors)
                if exclude_self:
                    _leave_own(piece, one.ids, own)
                keep = min(width, piece.shape[1])
                best = -np.partition(-piece, keep - 1, axis=1)[:, :keep][target]
                ok = np.isfinite(best)
                rows = np.repeat(np.arange(len(best)), ok.sum(axis=1))
                out.append(_table(schema, [
                    one.ids[target[rows]], one.entries[rows], one.scores[rows],
                    pa.nulls(len(rows), pa.int64()), np.repeat(b.names[e:e + 1], len(rows)), best[ok],
                ]))
        better = np.concatenate(found) if found else np.zeros(0, np.int64)
        # the target's own block always reports, so every ranked query has a row
        some = np.flatnonzero((better > 0) | (b.find(qs.entries) >= 0))
        out.append(_table(schema, [
            qs.ids[qs.owners()[some]], qs.entries[some], qs.scores[some], better[some],
            pa.nulls(len(some), _arrow_type(etype)), pa.nulls(len(some), pa.float64()),
        ]))
        return pa.concat_tables(out)

    add = _sums(["query_id", "entry", "score"], ["better"])

    def merge(t: pa.Table) -> pa.Table:
        counts, pieces = t.filter(t["value"].is_null()), t.filter(t["value"].is_valid())
        summed = add(counts.select(["query_id", "entry", "score", "better"]))
        empty = [pa.nulls(summed.num_rows, t.schema.field(c).type) for c in ("other", "value")]
        return pa.concat_tables([pa.table([*summed.columns, *empty], names=t.column_names), pieces])

    tiles = _run(index, q, kernel, schema, normalise, broadcast_bytes, merge)
    key = ["query_id", "entry", "score"]
    if index.has_split:
        tiles = stage(tiles, "beats")
        split = _top_mean(tiles.where("value is not null"), [*key, "other"], "value", width, digits, "score_other")
        wins = F.col("score_other") > F.col("score")
        if alphabetical:
            wins = wins | ((F.col("score_other") == F.col("score")) & (F.col("other") < F.col("entry")))
        split = split.groupBy(*key).agg(F.count_if(wins & (F.col("other") != F.col("entry"))).alias("better"))
        tiles = tiles.where("value is null").select(*key, "better").unionByName(split)
    return tiles.groupBy(*key).agg((F.sum("better") + 1).cast("bigint").alias("rank"))


def top_hits(
    index: GalleryIndex,
    queries: DataFrame,
    *,
    k: int = 20,
    rule: str = "top5",
    query_id: str = "query_id",
    vector: str = "emb",
    digits: int | None = None,
    exclude_self: bool = False,
    normalise: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Best ``k`` entries per query with their best image.

    Returns ``query_id, rank, entry, score, best_image, best_cosine``; equal
    scores are ordered by entry id, equal images by image id.
    """
    width = rule_width(rule)
    q = _query_rows(queries, query_id, vector).dropDuplicates(["query_id"])
    schema = _schema(
        ("query_id", q.schema["query_id"].dataType), ("entry", index.entry_type), ("value", T.DoubleType()),
        ("image", index.image_type), ("cosine", T.DoubleType()),
    )

    def kernel(qs: _Queries, b: _Block) -> pa.Table | None:
        ids, names, values, images, cosines = [], [], [], [], []

        def emit(i, e, v, img, c):
            ids.append(i), names.append(e), values.append(v), images.append(img), cosines.append(c)

        for part in _chunks(len(qs.ids), len(b.images), 2):
            one = qs[part]
            sim, slack = _near_similarities(one.vectors, one.ids, b, exclude_self)
            pooled = _pool(sim, b, width)
            if not b.whole.all():
                pooled[:, ~b.whole] = -np.inf
            n = min(k, pooled.shape[1])
            # every entry that may be at or above the k-th score is computed exactly, so ties are settled by the sort
            floor = (np.partition(pooled, -n, axis=1) if slack else -np.partition(-pooled, n - 1, axis=1)[:, ::-1])[:, -n].astype(float)
            floor = np.nextafter((floor - 2 * slack - (0.0 if digits is None else 2 * 10.0**-digits)).astype(pooled.dtype), -np.inf, dtype=pooled.dtype)
            r, e = np.divmod(np.flatnonzero(pooled >= floor[:, None]), pooled.shape[1])
            some = np.isfinite(pooled[r, e])  # a split entry is not pooled here
            r, e = r[some], e[some]
            score, best, cosine = _settled(one.vectors, b, sim, slack, r, e, width, digits)
            score = _round(score, digits)
            order = np.lexsort((e, -score, r))
            order = order[np.isfinite(score[order])]
            first = np.searchsorted(r[order], r[order], side="left")
            order = order[np.arange(len(order)) - first < n]
            r, e = r[order], e[order]
            emit(one.ids[r], b.names[e], score[order], b.images[best[order]], cosine[order])
            for j in np.flatnonzero(~b.whole):
                own = b[j]
                piece = one.vectors.dot(own.vectors)
                if exclude_self:
                    _leave_own(piece, one.ids, own)
                shown = _round(piece, digits)
                m = min(width, piece.shape[1])
                top = np.argsort(-_round(piece, digits), axis=1, kind="stable")[:, :m]
                rr = np.repeat(np.arange(len(piece)), m)
                cc = top.ravel()
                ok = np.isfinite(piece[rr, cc])
                rr, cc = rr[ok], cc[ok]
                emit(one.ids[rr], np.repeat(b.names[j:j + 1], len(rr)), piece[rr, cc], own.images[cc], shown[rr, cc])
        return _table(schema, [np.concatenate(c) for c in (ids, names, values, images, cosines)])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("query_id", "ascending"), ("value", "descending"), ("entry", "ascending")])
        ids = t["query_id"].to_numpy()
        head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return t.filter(pa.array(np.arange(len(ids)) - np.repeat(head, np.diff(np.r_[head, len(ids)])) < k))

    # pieces of a split entry cannot be ranked before they meet
    tiles = _run(index, q, kernel, schema, normalise, broadcast_bytes, None if index.has_split else merge)
    key = ["query_id", "entry"]
    if index.has_split:
        # the pieces of an entry may come from several blocks
        views = Window.partitionBy(*key).orderBy(F.col("value").desc(), F.col("image").asc())
        pooled = (
            tiles.withColumn("__n", F.row_number().over(views)).where(F.col("__n") <= width)
            .groupBy(*key)
            .agg(_mean_down("value").alias("score"), F.max("cosine").alias("best_cosine"),
                 F.min_by("image", F.struct(-F.col("cosine"), F.col("image"))).alias("best_image"))
        )
        pooled = pooled.withColumn("score", _rounded(F.col("score"), digits))
    else:
        pooled = tiles.select(*key, F.col("value").alias("score"), F.col("cosine").alias("best_cosine"), F.col("image").alias("best_image"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("entry").asc())
    return (
        pooled.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("bigint").alias("rank"), "entry", "score", "best_image", "best_cosine")
    )


def contrastive_terms(
    index: GalleryIndex,
    rows: DataFrame,
    *,
    temperature: float = 0.07,
    query_id: str = "render_id",
    label: str = "entry",
    vector: str = "emb",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per-row supervised contrastive loss: ``query_id, n_pos, loss`` (loss null without positives).

    ``index`` holds the same rows, keyed by label. Vectors are unit length, so a
    logit is at most 1/temperature; using that as the shift makes the partial
    exponential sums of all blocks addable.
    """
    q = _query_rows(rows, query_id, vector, entry=label)
    q = q.withColumn("entry", F.col("entry").cast(index.entry_type))
    schema = _schema(("query_id", q.schema["query_id"].dataType), ("mass", T.DoubleType()),
                     ("pos", T.DoubleType()), ("n_pos", T.LongType()))
    top = 1.0 / temperature

    def kernel(qs: _Queries, b: _Block) -> pa.Table:
        cols = [[], [], [], []]
        at = b.find(qs.entries)
        for part in _chunks(len(qs.ids), len(b.images)):
            logit = _similarities(qs.vectors[part], qs.ids[part], b, True) / temperature
            mass = np.exp(logit - top).sum(axis=1)
            live = np.isfinite(logit)
            sums = np.add.reduceat(np.where(live, logit, 0.0), b.starts, axis=1)
            here = np.add.reduceat(live.astype(np.int64), b.starts, axis=1)
            a = at[part]
            rows_ = np.arange(len(a))
            pos = np.where(a >= 0, sums[rows_, np.maximum(a, 0)], 0.0)
            n = np.where(a >= 0, here[rows_, np.maximum(a, 0)], 0)
            for c, v in zip(cols, (qs.ids[part], mass, pos, n)):
                c.append(v)
        return _table(schema, [np.concatenate(c) for c in cols])

    tiles = _run(index, q, kernel, schema, True, broadcast_bytes, _sums(["query_id"], ["mass", "pos", "n_pos"]))
    merged = tiles.groupBy("query_id").agg(F.sum("mass").alias("mass"), F.sum("pos").alias("pos"), F.sum("n_pos").alias("n_pos"))
    lse = F.log("mass") + F.lit(top)
    return merged.select(
        "query_id", "n_pos",
        F.when(F.col("n_pos") > 0, -(F.col("pos") - F.col("n_pos") * lse) / F.col("n_pos")).alias("loss"),
    )
