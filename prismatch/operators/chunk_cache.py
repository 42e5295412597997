"""Results kept by chunk and computed again only where a chunk has changed.

A chunk's signature covers the configuration and what its rows hold, in any
order. A run compares signatures with the manifest of the run before, computes the
rows of chunks whose signature no run has stored, and writes a new manifest that
links every chunk to the generation holding its results. Manifests are numbered
and never overwritten: a run that dies leaves no manifest, and of two runs that
start from the same one only the first to finish succeeds.

Defined cases: no rows give an empty result; chunks that are gone are no longer
linked; a chunk that returns to an earlier state is computed again unless the last
manifest links it; chunks of equal rows share a signature and are computed once
per chunk; null keys and values are told apart from each other and from absent rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prismatch.contracts import ContractError
from prismatch.functions.canonical import canonical_json
from prismatch.session import stage

_PIECE = 15  # hex digits of a row's digest in one summand


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of a row's columns as canonical JSON."""
    kind = StructType([df.schema[c] for c in columns])
    return F.sha2(canonical_json(F.struct(*[F.col(f"`{c}`") for c in columns]), kind), 256)


def chunk_signatures(df: DataFrame, chunk: str, columns: Sequence[str], config: str) -> DataFrame:
    """(chunk, n_rows, signature): one partial aggregation, the same for every order and partitioning of the rows.

    Four sums of 60-bit pieces of the row digests stand for the set of rows with its repeats.
    """
    digest = df.select(F.col(chunk).alias("chunk"), row_digest(df, columns).alias("d"))
    pieces = [F.conv(F.substring("d", 1 + k * _PIECE, _PIECE), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = digest.groupBy("chunk").agg(F.count("*").alias("n_rows"), *[F.sum(p).alias(f"s{k}") for k, p in enumerate(pieces)])
    parts = F.concat_ws(":", F.lit(config), F.col("n_rows").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)])
    return sums.select("chunk", "n_rows", F.sha2(parts, 256).alias("signature"))


@dataclass
class Run:
    """What a run did: ``chunks`` (chunk, n_rows, signature, generation, state) and ``result``, all current results."""

    result: DataFrame
    chunks: DataFrame


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished manifests, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [s.getPath() for s in files.listStatus(at)]
    done = [p for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def cached_chunks(
    df: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    path: str,
    *,
    chunk: str,
    columns: Sequence[str],
    config: str,
    check: Callable[[DataFrame, DataFrame], None] | None = None,
) -> Run:
    """Results of ``compute`` for all rows, of which only those in changed chunks are handed to it.

    ``compute`` maps rows to rows and keeps column ``chunk``; ``columns`` are all that a result depends on.
    ``check`` may compare stored results with the table (it is called with both before anything is reused).
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    now = stage(chunk_signatures(df, chunk, columns, config), "signatures")
    numbers = _numbers(spark, path)
    if numbers:
        stored = spark.read.parquet(f"{path}/manifest/{numbers[-1]}").select("chunk", "signature", "generation")
        if check is not None:
            check(df, read_chunks(spark, path))
    else:
        stored = spark.createDataFrame([], now.select("chunk", "signature").schema.add("generation", "string"))
    generation = uuid.uuid4().hex
    same = now.chunk.eqNullSafe(stored.chunk) & (now.signature == stored.signature)
    linked = now.join(stored, same, "left").select(now.chunk, "n_rows", now.signature, stored.generation)
    linked = stage(
        linked.select(
            "chunk", "n_rows", "signature",
            F.coalesce("generation", F.lit(generation)).alias("generation"),
            F.when(F.col("generation").isNull(), "computed").otherwise("reused").alias("state"),
        ),
        "linked",
    )
    todo = linked.where("state = 'computed'").select(F.col("chunk").alias("__chunk"), F.col("signature").alias("__signature"))
    rows = df.join(todo, F.col(chunk).eqNullSafe(F.col("__chunk")), "left_semi")
    compute(rows).withColumn("__chunk", F.col(chunk)).sortWithinPartitions("__chunk").write.mode("errorifexists").parquet(f"{path}/data/{generation}")
    number = numbers[-1] + 1 if numbers else 0
    linked.write.mode("errorifexists").parquet(f"{path}/manifest/{number}")
    return Run(read_chunks(spark, path, number), linked)


def read_chunks(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """Results that a manifest links (the last one by default)."""
    path = path.rstrip("/")
    if number is None:
        numbers = _numbers(spark, path)
        if not numbers:
            raise ContractError(f"{path}: no finished run")
        number = numbers[-1]
    links = spark.read.parquet(f"{path}/manifest/{number}").select(F.col("chunk").alias("__chunk"), F.col("generation").alias("__generation"))
    used = [r[0] for r in links.select("__generation").distinct().collect()]  # one per run that still holds results
    if not used:
        first = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
        some = first.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(first)[0].getPath().getName()
        return spark.read.parquet(f"{path}/data/{some}").drop("__chunk").where("false")
    out = None
    for generation in sorted(used):
        mine = links.where(F.col("__generation") == generation).select(F.col("__chunk").alias("__linked"))
        part = spark.read.parquet(f"{path}/data/{generation}")
        part = part.join(mine, F.col("__chunk").eqNullSafe(F.col("__linked")), "left_semi").drop("__chunk")
        out = part if out is None else out.unionByName(part)
    return out


def agreement(stored: DataFrame, fresh: DataFrame, key: str, value: str, cosine: Callable[[str, str], Column], least: float) -> None:
    """Raise unless every stored vector points where the fresh one of the same key does."""
    both = stored.select(F.col(key), F.col(value).alias("__old")).join(fresh.select(F.col(key), F.col(value).alias("__new")), key)
    worst = both.agg(F.min(F.coalesce(cosine("__old", "__new"), F.lit(-1.0)))).first()[0]
    if worst is not None and not worst > least:
        raise ContractError(f"stored {value} disagrees with a fresh one: cosine {worst}")
