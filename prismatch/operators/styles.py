"""Deterministic render styles: a pure function of (object, view, seed).

The random draws replay one numpy stream per row, ``default_rng(job_seed)``. The
streams' first states are computed for a whole Arrow batch, one generator draws
from them in turn, and values follow for the batch; the repairs are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismatch.functions.text import view_seed

CONFIG_VERSION = "render_v1"  # fixed value

# The axis space in draw order: name, kind, parameters (weights of values, or bounds).
AXES = (
    ("cartoon_style", "categorical", {"automatic": 0.70, "oval": 0.10, "rect": 0.10, "loop": 0.10}),
    ("ray_trace_mode", "integer", {0: 0.60, 1: 0.40}),
    ("color_scheme", "categorical", {"uniform": 0.25, "bychain": 0.20, "rainbow": 0.15, "chainbow": 0.10, "sse": 0.15, "mono": 0.08, "bfactor": 0.07}),
    ("uniform_hue", "uniform", (0.0, 1.0)),
    ("content", "categorical", {"cartoon_only": 0.55, "ligand_sticks": 0.25, "ligand_spheres": 0.10, "ions_spheres": 0.10}),
    ("background", "categorical", {"white": 0.55, "black": 0.12, "grey80": 0.12, "grey20": 0.08, "gradient": 0.13}),
    ("ambient_occlusion", "bernoulli", (0.50,)),
    ("cylindrical_helices", "bernoulli", (0.25,)),
    ("fancy_helices", "bernoulli", (0.25,)),
    ("flat_sheets", "bernoulli", (0.70,)),
    ("smooth_loops", "bernoulli", (0.30,)),
    ("loop_radius", "uniform", (0.15, 0.35)),
    ("orthoscopic", "bernoulli", (0.40,)),
    ("field_of_view", "uniform", (14.0, 35.0)),
    ("depth_cue", "bernoulli", (0.35,)),
    ("fog_start", "uniform", (0.30, 0.70)),
    ("light_count", "integer", {1: 0.25, 2: 0.50, 3: 0.25}),
    ("ambient", "uniform", (0.05, 0.35)),
    ("direct", "uniform", (0.20, 0.70)),
    ("reflect", "uniform", (0.20, 0.70)),
    ("shininess", "uniform", (20.0, 80.0)),
    ("cartoon_transparency", "mixture", (0.88, 0.10, 0.40)),
    ("antialias", "integer", {0: 0.50, 1: 0.50}),
    ("zoom_buffer", "uniform", (1.5, 3.0)),
    ("offcentre_x", "uniform", (-0.10, 0.10)),
    ("offcentre_y", "uniform", (-0.10, 0.10)),
)

# The style of view 0.
CANONICAL = {
    "cartoon_style": "automatic",
    "ray_trace_mode": 0,
    "color_scheme": "uniform",
    "uniform_hue": 0.55,
    "content": "cartoon_only",
    "background": "white",
    "ambient_occlusion": 0,
    "antialias": 1,
    "cartoon_transparency": 0.0,
    "cylindrical_helices": 0,
    "fancy_helices": 0,
    "flat_sheets": 1,
    "smooth_loops": 0,
    "loop_radius": 0.2,
    "orthoscopic": 0,
    "field_of_view": 20,
    "depth_cue": 0,
    "fog_start": 0.45,
    "light_count": 2,
    "ambient": 0.14,
    "direct": 0.45,
    "reflect": 0.45,
    "shininess": 55,
    "zoom_buffer": 2.0,
    "offcentre_x": 0.0,
    "offcentre_y": 0.0,
}

HELD_OUT_MODES = (2, 3)  # fixed values: ray trace modes kept out of training


def _field(kind: str) -> T.DataType:
    return {"categorical": T.StringType(), "integer": T.IntegerType(), "bernoulli": T.IntegerType()}.get(kind, T.DoubleType())


def _hashed(seeds: np.ndarray) -> np.ndarray:
    """Four 64-bit numbers for each 32-bit seed, as ``numpy.random.SeedSequence`` makes them."""
    by = [0x43B0D7E5, 0x931E8875]  # the next constant, and what it is multiplied with

    def constant() -> np.uint32:
        c = by[0]
        by[0] = c * by[1] & 0xFFFFFFFF
        return np.uint32(c)

    def stir(x: np.ndarray) -> np.ndarray:
        x = (x ^ constant()) * np.uint32(by[0])
        return x ^ (x >> np.uint32(16))

    pool = [stir(x) for x in (seeds.astype(np.uint32), *[np.zeros(len(seeds), np.uint32)] * 3)]
    for i in range(4):
        for j in range(4):
            if i != j:
                x = pool[j] * np.uint32(0xCA01F9DD) - stir(pool[i]) * np.uint32(0x4973F715)
                pool[j] = x ^ (x >> np.uint32(16))
    by[:] = 0x8B51F9DD, 0x58F38DED
    return np.stack([stir(pool[k % 4]) for k in range(8)], 1).view("<u8")


def _streams(seeds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``default_rng(seed)`` for each seed, four normal and then ``width`` uniform draws."""
    q, u = np.empty((len(seeds), 4)), np.empty((len(seeds), width))
    bits = np.random.PCG64(0)
    rng, state, full = np.random.Generator(bits), {}, (1 << 128) - 1
    start = {"bit_generator": "PCG64", "state": state, "has_uint32": 0, "uinteger": 0}
    for i, (high, low, inc_high, inc_low) in enumerate(_hashed(seeds).tolist()):
        inc = (((inc_high << 64 | inc_low) << 1) | 1) & full
        state["inc"], state["state"] = inc, ((inc + (high << 64 | low)) * 0x2360ED051FC65DA44385DF649FCCF645 + inc) & full
        bits.state = start
        rng.standard_normal(out=q[i])
        rng.random(out=u[i])
    return q, u


def _draw(u: np.ndarray, at: np.ndarray, kind: str, params) -> tuple[np.ndarray, np.ndarray]:
    """Values of one axis for all rows (places of categorical ones), and the next unread draw of each row."""
    rows = np.arange(len(u))
    first = u[rows, at]
    if kind in ("categorical", "integer"):
        cdf = np.cumsum(list(params.values()))
        cdf = cdf / cdf[-1]
        place = np.searchsorted(cdf, first, side="right")
        return place if kind == "categorical" else np.array(list(params), np.int64)[place], at + 1
    if kind == "bernoulli":
        return (first < params[0]).astype(np.int64), at + 1
    if kind == "uniform":
        lo, hi = params
        return lo + (hi - lo) * first, at + 1
    zero, lo, hi = params
    off = first < zero
    return np.where(off, 0.0, lo + (hi - lo) * u[rows, at + 1]), np.where(off, at + 1, at + 2)


def sample_styles(jobs: DataFrame, *, object_id: str = "object_id", view: str = "view", seed: int = 0,
                  held_out_ok: bool = False, axes=AXES, canonical: dict = CANONICAL) -> DataFrame:
    """One styled row per (object, view): quaternion, style columns, role, config version."""
    unknown = {kind for _, kind, _ in axes} - {"categorical", "integer", "bernoulli", "uniform", "mixture"}
    if unknown:
        raise ValueError(f"unknown axis kinds {sorted(unknown)}")
    table = list(axes)
    width = len(table) + sum(kind == "mixture" for _, kind, _ in table)
    base = jobs.select(F.col(object_id).alias("object_id"), F.col(view).cast("bigint").alias("view"), view_seed(object_id, view, seed).alias("job_seed"))
    quaternion = ("quat_w", "quat_x", "quat_y", "quat_z")
    schema = T.StructType([*base.schema.fields, *[T.StructField(q, T.DoubleType()) for q in quaternion],
                           *[T.StructField(n, _field(k)) for n, k, _ in table]])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q, u = _streams(b.column(2).to_numpy(), width)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            out = [*b.columns, *[pa.array(np.ascontiguousarray(x)) for x in q.T]]
            at = np.zeros(b.num_rows, dtype=np.int64)
            first = pc.fill_null(pc.equal(b.column(1), 0), False)
            for name, kind, params in table:
                value, at = _draw(u, at, kind, params)
                value = pa.array(list(params), pa.string()).take(pa.array(value)) if kind == "categorical" else pa.array(value)
                fixed = canonical[name] if kind == "categorical" else float(canonical[name])
                value = pc.if_else(first, pa.scalar(fixed).cast(value.type, safe=False), value)
                out.append(value.cast(pa.int32()) if kind in ("integer", "bernoulli") else value)
            yield pa.record_batch(out, names)

    names = schema.names
    return repair_styles(base.mapInArrow(draw, schema), held_out_ok).withColumn(
        "role", F.when(F.col("view") == 0, "eval_single").otherwise("train_view")).withColumn("config_version", F.lit(CONFIG_VERSION))


def repair_styles(styles: DataFrame, held_out_ok: bool = False) -> DataFrame:
    """Replace unreadable combinations, then (unless allowed) the held-out ones; view 0 is never changed."""
    sampled = F.col("view") != 0
    unreadable = sampled & (F.col("cartoon_style") == "loop") & (F.col("ray_trace_mode") == 1)
    out = styles.withColumn("ray_trace_mode", F.when(unreadable, 0).otherwise(F.col("ray_trace_mode")))
    if held_out_ok:
        return out
    banned = sampled & F.col("ray_trace_mode").isin(*HELD_OUT_MODES)
    combo = sampled & (F.col("cylindrical_helices") == 1) & (F.col("flat_sheets") == 0)
    return out.withColumn("ray_trace_mode", F.when(banned, 0).otherwise(F.col("ray_trace_mode"))).withColumn(
        "flat_sheets", F.when(combo, 1).otherwise(F.col("flat_sheets")))
