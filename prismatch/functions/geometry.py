"""Geometry and colour expressions for rendering and cropping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismatch.functions.vectors import ColumnLike, _col

# Canvas, long side of the fitted crop.
CANVAS = 512
LONG_SIDE = 464


def rotation_matrix(w: ColumnLike, x: ColumnLike, y: ColumnLike, z: ColumnLike) -> Column:
    """Row-major rotation matrix of a quaternion, normalised first."""
    w, x, y, z = map(_col, (w, x, y, z))
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n

    def diagonal(a: Column, b: Column) -> Column:
        return 1 - 2 * (a * a + b * b)

    return F.array(
        diagonal(y, z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), diagonal(x, z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), diagonal(x, y),
    )


def hsv_to_rgb(h: ColumnLike, s: ColumnLike, v: ColumnLike) -> Column:
    """Array (r, g, b) in 0..1; hue in turns."""
    h, s, v = map(_col, (h, s, v))

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(n) + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.array(channel(5), channel(3), channel(1))


def camera_shift(fraction: ColumnLike, distance: ColumnLike, field_of_view: ColumnLike) -> Column:
    """Off-centre shift for a fraction of the frame at the subject."""
    return _col(fraction) * 2 * F.abs(_col(distance)) * F.tan(F.radians(_col(field_of_view)) / 2)


def fit_canvas(width: ColumnLike, height: ColumnLike) -> Column:
    """Size and padding of a crop fitted to the canvas (sizes round half to even)."""
    w, h = _col(width), _col(height)
    scale = F.lit(float(LONG_SIDE)) / F.greatest(w, h)
    rw = F.greatest(F.lit(1), F.bround(w * scale).cast("int"))
    rh = F.greatest(F.lit(1), F.bround(h * scale).cast("int"))
    return F.struct(
        rw.alias("width"), rh.alias("height"),
        F.floor((F.lit(CANVAS) - rw) / 2).cast("int").alias("left"), F.floor((F.lit(CANVAS) - rh) / 2).cast("int").alias("top"),
        (scale > 1).alias("upscaled"),
    )


def box_inside(box: ColumnLike, width: ColumnLike, height: ColumnLike) -> Column:
    """A box [x0, y0, x1, y1] is non-empty and within the image."""
    b = _col(box)
    return (
        (F.size(b) == 4) & (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= _col(width))
        & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= _col(height))
    )


def box_to_pixels(box: ColumnLike, width: ColumnLike, height: ColumnLike) -> Column:
    """Per-mille box to pixels: lower corners floor, upper corners ceil."""
    b, w, h = _col(box), _col(width), _col(height)
    return F.array(F.floor(b[0] * w / 1000), F.floor(b[1] * h / 1000), F.ceil(b[2] * w / 1000), F.ceil(b[3] * h / 1000))
