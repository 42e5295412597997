"""npz and tar archives as Spark data sources, for reading and for writing.

Reading: a file is cut into ranges by its size alone, so planning opens nothing.
The task of a range reads the archive's own directory (the npz members' headers,
the tar's member headers or the index that our writer puts beside it) and then
only the rows or members that begin in its range. Memory holds one Arrow batch of
an array, or one member. Compressed archives can't be entered in the middle; they
are streamed by the task of their first range.

Writing: tasks write below a folder of the job and report their files in commit
messages. The job's commit moves the files of the attempts that Spark committed
into place and then writes ``manifest-<job>.jsonl``; an aborted job, or the second
attempt of a task, leaves no part.

Paths may have any scheme that Hadoop lists and pyarrow opens (``file``, ``s3a``,
``gs``, ``hdfs``; links such as ``viewfs`` are resolved first).
"""

from __future__ import annotations

import fnmatch
import io
import json
import os
import struct
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from prismatch.operators.ordering import with_position

NPZ_BATCH_ROWS = 8192
SPLIT_BYTES = 64 << 20


# ---- files -----------------------------------------------------------------
def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a path or URI, and the path within it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def resolved(spark: SparkSession, path: str, *, create: bool = False) -> list[tuple[str, int]]:
    """(URI, size) of what a comma-separated list of globs names, by Hadoop, with links followed."""
    found = []
    for pattern in path.split(","):
        at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if create:
            fs.mkdirs(at)
        found += [(fs.resolvePath(s.getPath()).toString(), s.getLen()) for s in fs.globStatus(at) or ()]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def _listed(path: str) -> list[tuple[str, int]]:
    """The same without a session, for plain globs in the last part of a path."""
    found = []
    for pattern in path.split(","):
        folder, _, name = pattern.rpartition("/")
        fs, inner = file_system(folder or ".")
        for info in fs.get_file_info(pafs.FileSelector(inner)):
            if info.is_file and fnmatch.fnmatchcase(info.base_name, name):
                found.append((f"{folder}/{info.base_name}", info.size))
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


@dataclass
class Range(InputPartition):
    """Part ``k`` of ``parts`` equal ranges of a file."""

    uri: str
    size: int
    k: int
    parts: int

    @property
    def bytes(self) -> tuple[int, int]:
        return self.size * self.k // self.parts, self.size * (self.k + 1) // self.parts


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        files = json.loads(self.options["files"]) if "files" in self.options else _listed(self.options["path"])
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        cut = [(uri, size, max(1, -(-size // split))) for uri, size in files]
        return [Range(uri, size, k, parts) for uri, size, parts in cut for k in range(parts)]


# ---- npz -------------------------------------------------------------------
class _Array:
    """A one- or two-dimensional member of an npz file, read by rows."""

    def __init__(self, raw, archive: zipfile.ZipFile, name: str):
        info = archive.getinfo(f"{name}.npy")
        self.stream = archive.open(info)
        version = np.lib.format.read_magic(self.stream)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = header(self.stream)
        if fortran and len(self.shape) > 1 or self.dtype.hasobject:
            raise ValueError(f"{name}: rows must be stored one after the other, without objects")
        self.stored = info.compress_type == zipfile.ZIP_STORED
        self.row_bytes = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))
        self.raw, skip = raw, self.stream.tell()
        raw.seek(info.header_offset + 26)  # lengths of name and extra field in the local header
        self.start = info.header_offset + 30 + sum(struct.unpack("<HH", raw.read(4))) + skip
        if not self.stored:
            self.stream.close()
            self.stream = archive.open(info)
            self.stream.read(skip)

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """Rows ``lo`` to ``hi``; a compressed member gives them in order only."""
        size = (hi - lo) * self.row_bytes
        if self.stored:
            self.raw.seek(self.start + lo * self.row_bytes)
            data = self.raw.read(size)
        else:
            data = self.stream.read(size)
        if len(data) != size:
            raise ValueError("the archive ends within an array")
        return np.frombuffer(data, self.dtype).reshape(hi - lo, *self.shape[1:])


class NpzReader(ArchiveReader):
    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(partition.uri)
        with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
            ids, emb = _Array(raw, archive, "render_id"), _Array(raw, archive, "emb")
            if len(emb.shape) != 2 or len(ids.shape) != 1 or ids.shape[0] != emb.shape[0]:
                raise ValueError(f"{partition.uri}: expected a 2-D array with one id per row")
            n, k, parts = int(emb.shape[0]), partition.k, partition.parts
            if not (ids.stored and emb.stored):
                k, parts = (0, 1) if k == 0 else (1, 1)
            yield from self._batches(partition.uri, ids, emb, n * k // parts, min(n, n * (k + 1) // parts))

    def _batches(self, uri: str, ids: _Array, emb: _Array, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.field("element", pa.float32()))
        for s in range(lo, hi, NPZ_BATCH_ROWS):
            e = min(s + NPZ_BATCH_ROWS, hi)
            vectors, names = emb.rows(s, e).astype(np.float32), ids.rows(s, e)
            if not np.isfinite(vectors).all():
                raise ValueError(f"{uri}: vectors must be finite")
            offsets = pa.array(np.arange(e - s + 1) * vectors.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel())).cast(kind)
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(str).tolist(), pa.string()), lists], names=["render_id", "emb"])


# ---- tar -------------------------------------------------------------------
def _index_of(fs: pafs.FileSystem, path: str) -> np.ndarray | None:
    """Member offsets from the manifest beside a tar, if there is one that has them."""
    side = path.removesuffix(".tar") + ".parquet"
    if fs.get_file_info(side).type != pafs.FileType.File or "offset" not in pq.read_schema(side, filesystem=fs).names:
        return None
    return np.sort(pq.read_table(side, columns=["offset"], filesystem=fs)["offset"].to_numpy())


def _members(raw, start: int) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    raw.seek(start)
    with tarfile.open(fileobj=raw, mode="r:") as tar:
        while (member := tar.next()) is not None:
            tar.members = []  # headers passed are not kept
            yield tar, member


class TarReader(ArchiveReader):
    def read(self, partition: Range) -> Iterator[tuple]:
        suffix = self.options.get("suffix", "")
        flatten = str(self.options.get("flatten", "false")).lower() == "true"
        archive = partition.uri.rsplit("/", 1)[-1]
        for tar, m in self._own(partition):
            if m.isfile() and m.name.endswith(suffix):
                yield archive, os.path.basename(m.name) if flatten else m.name, m.size, tar.extractfile(m).read()

    def _own(self, partition: Range) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
        """Members whose header begins in the range."""
        fs, path = file_system(partition.uri)
        if not path.endswith(".tar"):
            if partition.k == 0:
                with fs.open_input_file(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for m in tar:
                        tar.members = []
                        yield tar, m
            return
        lo, hi = partition.bytes
        with fs.open_input_file(path) as raw:
            offsets = _index_of(fs, path) if lo else None
            if offsets is not None:
                at = np.searchsorted(offsets, lo)
                start = int(offsets[at]) if at < len(offsets) else hi
            elif lo:  # walk over the headers alone
                start = next((m.offset for _, m in _members(raw, 0) if m.offset >= lo), hi)
            else:
                start = 0
            if start < hi:
                for tar, m in _members(raw, start):
                    if m.offset >= hi:
                        break
                    yield tar, m


# ---- writers ---------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    """Files of one task attempt: lists of (temporary, final) names in the order in which they appear, and rows."""

    parts: list[tuple[list[tuple[str, str]], str, int]]


class PartWriter(DataSourceArrowWriter):
    """Commit protocol of both formats."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("parts are only added; name a new folder")
        self.options, self.job = options, options.get("job") or uuid.uuid4().hex
        self.folder = options["path"].rstrip("/")
        self.work = f"_temporary-{self.job}"

    def _attempt(self) -> tuple[pafs.FileSystem, str, str, str]:
        """File system, folder, work folder of this attempt and the task's number."""
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = file_system(self.folder)
        own = f"{self.work}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(f"{folder}/{own}", recursive=True)
        return fs, folder, own, f"{task.partitionId():05d}"

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.folder)
        lines = []
        for m in messages:
            for files, part, rows in m.parts if m else ():
                for temporary, final in files:
                    fs.move(f"{folder}/{temporary}", f"{folder}/{final}")
                lines.append(json.dumps({"part": part, "rows": rows}) + "\n")
        with fs.open_output_stream(f"{folder}/{self.work}.jsonl") as out:
            out.write("".join(lines).encode())
        fs.move(f"{folder}/{self.work}.jsonl", f"{folder}/manifest-{self.job}.jsonl")
        self._clear(fs, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(f"{folder}/{self.work}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.work}")


class NpzWriter(PartWriter):
    """``render_id, emb`` as npz parts of ``rows_per_part`` rows; a task holds one part."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        limit, half = int(self.options.get("rows_per_part", 65536)), str(self.options.get("half", "true")).lower() == "true"
        fs, folder, own, task = self._attempt()
        parts, held, count = [], [], 0

        def close() -> None:
            ids = np.array([str(x) for b in held for x in b.column("render_id").to_pylist()])
            emb = np.concatenate([_matrix(b.column("emb")) for b in held]).astype(np.float16 if half else np.float32)
            if not np.isfinite(emb).all() or (np.linalg.norm(emb.astype(np.float32), axis=1) <= 1e-8).any():
                raise ValueError("vectors must be finite and not zero")
            name = f"part-{task}-{len(parts):05d}-{self.job[:8]}.npz"
            buffer = io.BytesIO()
            np.savez(buffer, render_id=ids, emb=emb)
            with fs.open_output_stream(f"{folder}/{own}/{name}") as out:
                out.write(buffer.getbuffer())
            parts.append(([(f"{own}/{name}", name)], name, len(ids)))

        for batch in iterator:
            while batch.num_rows:
                piece = batch.slice(0, limit - count)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                count += piece.num_rows
                if count == limit:
                    close()
                    held, count = [], 0
        if count:
            close()
        return Written(parts)


def _matrix(column: pa.Array) -> np.ndarray:
    size = column.value_lengths()
    if column.null_count or len(size.unique()) > 1 or column.flatten().null_count:
        raise ValueError("vectors must be complete and of one size")
    return column.flatten().to_numpy().reshape(len(column), -1)


class TarWriter(PartWriter):
    """``shard, part, member, content`` as ``shard_<n>_p<m>.tar`` with a Parquet manifest that holds every member's offset.

    Rows of one part must follow each other in one task. The manifest is moved
    into place before its tar, so a tar without one never appears.
    """

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder, own, _ = self._attempt()
        parts, key, tar, out, rows = [], None, None, None, []

        def close() -> None:
            tar.close()
            out.close()
            stem = f"shard_{key[0]:03d}_p{key[1]:02d}"
            columns = zip(*rows, strict=True)
            table = pa.table(dict(zip(("member", "shard", "offset", "size"), map(list, columns), strict=True)))
            with fs.open_output_stream(f"{folder}/{own}/{stem}.parquet") as side:
                pq.write_table(table, side)
            parts.append(([(f"{own}/{stem}{x}", f"{stem}{x}") for x in (".parquet", ".tar")], stem, len(rows)))

        for batch in iterator:
            for *new, member, content in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "member", "content")), strict=True):
                if new != key:
                    if tar is not None:
                        close()
                    key, rows = new, []
                    out = fs.open_output_stream(f"{folder}/{own}/shard_{key[0]:03d}_p{key[1]:02d}.tar")
                    tar = tarfile.open(fileobj=out, mode="w|")
                info = tarfile.TarInfo(member)
                info.size = len(content)
                rows.append((member, key[0], tar.offset, info.size))
                tar.addfile(info, io.BytesIO(content))
                tar.members = []
        if tar is not None:
            close()
        return Written(parts)


class NpzSource(DataSource):
    """Rows ``render_id, emb`` of npz files; half precision widens to float. Option ``split_bytes`` sizes the ranges."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("render_id", T.StringType()), T.StructField("emb", T.ArrayType(T.FloatType()))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpzReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NpzWriter(self.options, overwrite)


class TarSource(DataSource):
    """Rows ``archive, member, size, content`` of tar or tgz files; option ``suffix`` filters members,
    ``flatten`` keeps base names only, ``split_bytes`` sizes the ranges."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> T.StructType:
        return T.StructType([
            T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()),
            T.StructField("size", T.LongType()), T.StructField("content", T.BinaryType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TarReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TarWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(TarSource)


def _load(spark: SparkSession, source: type[DataSource], pattern: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(files=json.dumps(resolved(spark, pattern)), **options).load()


def read_npz(spark: SparkSession, pattern: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    return _load(spark, NpzSource, pattern, split_bytes=split_bytes)


def read_tar(spark: SparkSession, pattern: str, suffix: str = "", flatten: bool = False, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    return _load(spark, TarSource, pattern, suffix=suffix, flatten=str(flatten).lower(), split_bytes=split_bytes)


def pending_archives(archives: DataFrame, done: DataFrame) -> DataFrame:
    """Archives without a completion mark."""
    return archives.join(done, "archive", "left_anti")


def _save(df: DataFrame, source: type[DataSource], folder: str, **options) -> DataFrame:
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(source)
    at = resolved(spark, folder, create=True)[0][0]
    df.write.format(source.name()).mode("append").options(job=job, **options).save(at)
    return spark.read.schema("part string, rows bigint").json(f"{folder.rstrip('/')}/manifest-{job}.jsonl")


def write_npz(df: DataFrame, folder: str, *, rows_per_part: int = 65536, half: bool = True) -> DataFrame:
    """Write ``render_id, emb`` as npz parts; returns ``part, rows`` of what was committed."""
    return _save(df.select(F.col("render_id").cast("string").alias("render_id"), "emb"), NpzSource, folder, rows_per_part=rows_per_part, half=str(half).lower())


def write_tar_parts(df: DataFrame, folder: str, *, members_per_part: int = 1600) -> DataFrame:
    """Write ``shard, member, content`` as ``shard_<n>_p<m>.tar`` parts with their manifests; returns ``part, rows``.

    A shard's members are numbered in the order of their names over the whole
    table, so parts of one shard are written by different tasks.
    """
    rows = df.select(F.col("shard").cast("int").alias("shard"), "member", F.col("content").cast("binary").alias("content"))
    at = with_position(rows, [F.col("shard"), F.col("member")], "at")
    first = F.broadcast(at.groupBy("shard").agg(F.min("at").alias("first")))  # shards are numbered by three digits
    part = F.floor((F.col("at") - F.col("first")) / members_per_part).cast("int")
    placed = at.join(first, "shard").select("shard", part.alias("part"), "member", "content")
    return _save(placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "member"), TarSource, folder)
