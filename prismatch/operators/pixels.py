"""Statistics of decoded images, for stacks of images of one size.

Input rows hold ``height``, ``width`` and ``rgb`` (row-major bytes). The images of
an Arrow batch are put together by size into stacks, and everything is formed for
a whole stack at once: sums of a silhouette from its raw moments (two matrix
products give all of them), gradients by cells from summed-area tables, modal
colours from sorted runs. An image never leaves its row, so none of this shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUPS = ("shape", "hog", "color")  # fixed value: order of the combined vector
COLOUR_WEIGHT = 10.0  # fixed value: colour weight in the combined nuisance vector
STACK_PIXELS = 1 << 16  # pixels of a stack, whatever the size of its images: what is formed for a stack is many times as large
TINY = 1e-6


def per_stack(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[..., Column]:
    """Column function ``(rgb, height, width) -> array<double>`` of a function from stacks to rows; unreadable images give null.

    Marked non-deterministic so that the optimiser neither copies it into inferred
    filters nor moves it below a repartition.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(rgb: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        known = pd.DataFrame({"size": rgb.str.len(), "h": height, "w": width}).reset_index(drop=True).astype("float64")
        good = known[(known["size"] == 3 * known["h"] * known["w"]) & (known["size"] > 0)]
        out = np.full(len(rgb), None, object)
        raw = rgb.to_numpy()
        for (h, w), rows in good.groupby(["h", "w"]):
            h, w = int(h), int(w)
            step = max(1, STACK_PIXELS // (h * w))
            for part in (rows.index[k : k + step].to_numpy() for k in range(0, len(rows), step)):
                stack = np.frombuffer(b"".join(raw[part]), np.uint8).reshape(len(part), h, w, 3)
                out[part] = list(np.asarray(fn(stack), np.float64))
        return pd.Series(out, index=rgb.index)

    return run.asNondeterministic()


# ---- colours ---------------------------------------------------------------
def _bins(stack: np.ndarray, shift: int) -> np.ndarray:
    """One number per pixel from the high bits of its channels."""
    high = stack.astype(np.int64) >> shift
    bits = 8 - shift
    return ((high[..., 0] << 2 * bits) | (high[..., 1] << bits) | high[..., 2]).reshape(len(stack), -1)


def colour_histogram(stack: np.ndarray) -> np.ndarray:
    """8 x 8 x 8 histograms that sum to one."""
    bins = _bins(stack, 5)
    cells = bins + 512 * np.arange(len(bins))[:, None]
    return np.bincount(cells.ravel(), minlength=512 * len(bins)).reshape(-1, 512) / bins.shape[1]


def modal_colour(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most frequent colours (the smallest on a tie) and their counts, from the runs of sorted pixels."""
    run = np.sort(_bins(stack, 0), axis=1)
    place = np.arange(run.shape[1])
    start = np.maximum.accumulate(np.where(np.diff(run, axis=1, prepend=-1) != 0, place, 0), axis=1)
    length = place - start + 1
    end = np.argmax(length, axis=1)[:, None]
    packed = np.take_along_axis(run, end, 1)[:, 0]
    return np.stack([packed >> 16, packed >> 8 & 255, packed & 255], 1), np.take_along_axis(length, end, 1)[:, 0]


def ink_fraction(stack: np.ndarray) -> np.ndarray:
    """Shares of pixels that differ from the modal colour."""
    return 1.0 - modal_colour(stack)[1][:, None] / (stack.shape[1] * stack.shape[2])


def modal_mask(stack: np.ndarray, threshold: int = 30) -> np.ndarray:
    """Pixels whose channels differ from the modal colour by more than ``threshold`` in sum."""
    colour, _ = modal_colour(stack)
    return np.abs(stack.astype(np.int16) - colour[:, None, None, :].astype(np.int16)).sum(-1) > threshold


def frame_mask(stack: np.ndarray, threshold: float = 0.12) -> np.ndarray:
    """Pixels away from the median colour of the outermost rows and columns (corners count for both)."""
    unit = stack.astype(np.float32) / np.float32(255)
    sides = (unit[:, 0], unit[:, -1], unit[:, :, 0], unit[:, :, -1])
    middle = np.median(np.concatenate(sides, axis=1), axis=1)
    away = unit - middle[:, None, None, :].astype(np.float32)
    return np.sqrt(np.einsum("nhwc,nhwc->nhw", away, away)) > threshold


def masked_stats(values: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of a map over the masked pixels (zero where there are none)."""
    n = np.maximum(mask.sum((1, 2)), 1)
    mean = np.einsum("nhw,nhw->n", values, mask) / n
    off = (values - mean[:, None, None]) * mask
    return mean, np.sqrt(np.einsum("nhw,nhw->n", off, off) / n)


def colour_features(stack: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Ten colour statistics of the foregrounds; zeros for an empty mask."""
    unit, on = stack / 255.0, mask.astype(np.float64)
    high, low = unit.max(-1), unit.min(-1)
    saturation = (high - low) / np.maximum(high, TINY)
    stats = [masked_stats(x, on) for x in (unit[..., 0], unit[..., 1], unit[..., 2], saturation, high, low)]
    (mr, sr), (mg, sg), (mb, sb), (ms, ss), (mh, _), (ml, _) = stats
    return np.stack([mr, mg, mb, sr, sg, sb, ms, ss, mh, ml], 1)


# ---- silhouettes -----------------------------------------------------------
def raw_moments(mask: np.ndarray, order: int = 3) -> np.ndarray:
    """Sums of ``y^p x^q`` over the masks, with coordinates from the middle of the image."""
    h, w = mask.shape[1:]
    y, x = (np.vander(np.arange(n) - (n - 1) / 2, order + 1, increasing=True) for n in (h, w))
    return np.einsum("hp,nhq->npq", y, mask.astype(np.float64) @ x)


def central_moments(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moments about the centroids, by the binomial theorem, and the centroids (from the middle); empty masks give zeros."""
    mass = np.maximum(raw[:, 0, 0], TINY)
    centre = np.stack([raw[:, 1, 0], raw[:, 0, 1]], 1) / mass[:, None]
    k = raw.shape[1]
    choose = np.array([[np.prod(np.arange(p - r + 1, p + 1)) / max(np.prod(np.arange(1, r + 1)), 1) if r <= p else 0.0 for r in range(k)] for p in range(k)])
    power = np.subtract.outer(np.arange(k), np.arange(k)).clip(0)
    shift = [choose * (-centre[:, a, None, None]) ** power for a in (0, 1)]  # (y - c)^p as a row of powers of y
    return shift[0] @ raw @ shift[1].transpose(0, 2, 1), centre


def shape_invariants(central: np.ndarray) -> np.ndarray:
    """Signed logarithms of Hu's invariants; zeros for an empty mask."""
    mass = np.maximum(central[:, 0, 0], TINY)[:, None, None]
    order = np.add.outer(np.arange(4), np.arange(4)) / 2 + 1
    hu = hu_invariants(central / mass**order)
    return np.sign(hu) * np.log1p(np.abs(hu))


def hu_invariants(n: np.ndarray) -> np.ndarray:
    """Hu's seven invariants of a stack of matrices of normalised moments."""
    n20, n02, n11, n30, n03, n21, n12 = (n[:, p, q] for p, q in ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2)))
    a, b = n30 + n12, n21 + n03
    c, d = n30 - 3 * n12, 3 * n21 - n03
    return np.stack([
        n20 + n02,
        (n20 - n02) ** 2 + 4 * n11**2,
        c**2 + d**2,
        a**2 + b**2,
        c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2),
        (n20 - n02) * (a**2 - b**2) + 4 * n11 * a * b,
        d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2),
    ], axis=1)


def extents(mask: np.ndarray) -> np.ndarray:
    """Heights and widths of bounding boxes (zero without pixels)."""
    out = []
    for axis in (2, 1):
        line = mask.any(axis)
        out.append(np.where(line.any(1), line.shape[1] - np.argmax(line[:, ::-1], 1) - np.argmax(line, 1), 0))
    return np.stack(out, 1).astype(np.float64)


def silhouette(stack: np.ndarray) -> np.ndarray:
    """Blob geometry, edge strength, brightness (13 values) and seven shape invariants."""
    mask = frame_mask(stack)
    size = np.array(mask.shape[1:], np.float64)
    central, centre = central_moments(raw_moments(mask))
    area, box = central[:, 0, 0], extents(mask)
    blob = (area > 4)[:, None]  # fixed value: smaller ones have no geometry
    mass = np.maximum(area, TINY)
    share = np.where(blob, box / size, 0.0)
    fill = np.where(blob[:, 0], area / np.maximum(box.prod(1), 1), 0.0)
    middle = np.where(blob, (centre + (size - 1) / 2) / size, 0.0)
    spread = np.where(blob, np.sqrt(np.maximum(np.stack([central[:, 2, 0], central[:, 0, 2]], 1) / mass[:, None], 0.0)) / size, 0.0)
    grey = (stack.astype(np.float32) / np.float32(255)).mean(-1)
    step = [np.abs(np.diff(grey, axis=a)).mean((1, 2)) for a in (2, 1)]
    columns = [area / size.prod(), share[:, 0], share[:, 1], share[:, 0] / np.maximum(share[:, 1], TINY), fill, *middle.T, *spread.T, *step, grey.mean((1, 2)), grey.std((1, 2))]
    return np.hstack([np.stack(columns, 1), shape_invariants(central)])


def outline(mask: np.ndarray) -> np.ndarray:
    """Foreground pixels beside a background pixel of the image."""
    inside = np.ones_like(mask)
    for axis in (1, 2):
        ahead = np.ones_like(mask)
        back = np.ones_like(mask)
        lead, rest = [slice(None)] * 3, [slice(None)] * 3
        lead[axis], rest[axis] = slice(None, -1), slice(1, None)
        ahead[tuple(lead)], back[tuple(rest)] = mask[tuple(rest)], mask[tuple(lead)]
        inside &= ahead & back
    return (mask & ~inside).sum((1, 2))


def shape_features(mask: np.ndarray) -> np.ndarray:
    """Twelve silhouette numbers; zeros for an empty mask."""
    h, w = mask.shape[1:]
    central, centre = central_moments(raw_moments(mask))
    area, box, edge = central[:, 0, 0], extents(mask), outline(mask)
    mass = np.maximum(area, 1.0)
    # eigenvalues of the 2 x 2 covariance from its half trace and its deviator
    yy, xx, yx = (central[:, p, q] / np.maximum(area - 1, 1.0) for p, q in ((2, 0), (0, 2), (1, 1)))
    half, off = (yy + xx) / 2, np.hypot((yy - xx) / 2, yx)
    major, minor = np.maximum(half + off, TINY), np.maximum(half - off, TINY)
    y, x = np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2
    radius = np.hypot(y[None, :, None] - centre[:, 0, None, None], x[None, None, :] - centre[:, 1, None, None])
    reach = np.maximum((radius * mask).max((1, 2)), TINY)
    mean, deviation = masked_stats(radius, mask.astype(np.float64))
    inner = (mask & (radius < reach[:, None, None] / 2)).sum((1, 2)) / mass
    whole = np.maximum(box.prod(1), 1.0)
    columns = [area / (h * w), box[:, 1] / np.maximum(box[:, 0], 1.0), area / whole, edge / mass, edge**2 / mass, np.sqrt(major / minor),
               np.sqrt(major) / h, np.sqrt(minor) / h, mean / reach, deviation / reach, inner, box.prod(1) / (h * w)]
    return np.where((area > 0)[:, None], np.stack(columns, 1), 0.0)


# ---- gradients -------------------------------------------------------------
def hog(grey: np.ndarray, cell: int = 16, block: int = 2, bins: int = 9) -> np.ndarray:
    """Histograms of oriented gradients with clipped L2 block normalisation; cell means are differences of summed-area tables."""
    n, h, w = grey.shape
    gy, gx = np.zeros_like(grey), np.zeros_like(grey)
    gy[:, 1:-1], gx[:, :, 1:-1] = grey[:, 2:] - grey[:, :-2], grey[:, :, 2:] - grey[:, :, :-2]
    strength, angle = np.hypot(gy, gx), np.rad2deg(np.arctan2(gy, gx)) % 180
    which = np.minimum((angle / (180 / bins)).astype(int), bins - 1)
    rows, cols = h // cell, w // cell
    if rows < block or cols < block:
        return np.zeros((n, 0))
    corner = np.ix_(np.arange(n), np.arange(rows + 1) * cell, np.arange(cols + 1) * cell)
    cells = np.empty((n, rows, cols, bins))
    area = np.zeros((n, h + 1, w + 1))
    for b in range(bins):
        area[:, 1:, 1:] = np.where(which == b, strength, 0.0).cumsum(1).cumsum(2)
        at = area[corner]
        cells[..., b] = np.diff(np.diff(at, axis=1), axis=2) / cell**2
    cells = np.maximum(cells, 0.0)  # differences of equal sums may fall below zero by rounding
    around = np.lib.stride_tricks.sliding_window_view(cells, (block, block), axis=(1, 2))  # n, y, x, bins, in y, in x
    v = around.transpose(0, 1, 2, 4, 5, 3).reshape(n, rows - block + 1, cols - block + 1, -1)
    for clip in (0.2, np.inf):
        v = np.minimum(v / np.sqrt((v**2).sum(-1, keepdims=True) + 1e-10), clip)
    return v.reshape(n, -1)


def hog_features(cell: int = 16) -> Callable[[np.ndarray], np.ndarray]:
    return lambda stack: hog((stack / 255.0).mean(-1), cell)


def nuisance(groups: tuple[str, ...] = GROUPS, cell: int = 32) -> Callable[[np.ndarray], np.ndarray]:
    """Selected groups of nuisance features, always in the fixed order."""
    if unknown := set(groups) - set(GROUPS):
        raise ValueError(f"unknown feature groups {sorted(unknown)}")

    def run(stack: np.ndarray) -> np.ndarray:
        mask, parts = modal_mask(stack), []
        if "shape" in groups:
            # the published numbers feed the mask itself to the invariants, not its moments
            parts += [shape_features(mask), hu_invariants(mask[:, :4, :4].astype(np.float64))]
        if "hog" in groups:
            luma = np.round(stack.astype(np.float64) @ np.array([0.299, 0.587, 0.114])) / 255.0
            parts.append(hog(luma, cell))
        if "color" in groups:
            parts.append(colour_features(stack, mask))
        return np.hstack(parts)

    return run


def combined_nuisance(standard_silhouette: Column, colour: Column) -> Column:
    """Silhouette (already standardised) followed by the weighted colour histogram."""
    return F.concat(standard_silhouette, F.transform(colour, lambda x: x * COLOUR_WEIGHT))
