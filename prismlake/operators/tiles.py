"""Rasters as tiles: the same operators on arrays, one shuffle for any radius.

Pixels are gathered into tiles with a halo as wide as the operator's radius; a
pixel near a tile's edge is sent to the neighbours whose halo it is in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile without its halo.
SIZE = 256

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def apply(df: DataFrame, kernel: Kernel, channels: list[str], height: int, width: int, radius: int, size: int = SIZE) -> DataFrame:
    """Runs kernel(planes, border) on tiles; border marks the pixels on the edge of the image.

    planes has the channels first. A tile's group is bounded by (size + 2 * radius)^2
    pixels. height and width bound the images; an image may have less, and its edges are the
    first and last rows and columns that it has. Of rows and columns that it lacks in between,
    the ones beside them become neighbours, if they are in one tile.
    """

    def tiles_of(c: str, n: int) -> F.Column:
        return F.sequence(F.greatest(F.lit(0), F.expr(f"cast(floor(({c} - {radius}) / {size}) as int)")), F.least(F.lit((n - 1) // size), F.expr(f"cast(({c} + {radius}) div {size} as int)")))

    parts = df.withColumn("_ty", F.explode(tiles_of("y", height))).withColumn("_tx", F.explode(tiles_of("x", width)))
    fields = ", ".join(f"{c} int" for c in channels)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(rows["_ty"].iloc[0]), int(rows["_tx"].iloc[0])
        (ys, y), (xs, x) = (np.unique(rows[c].to_numpy(), return_inverse=True) for c in ("y", "x"))
        planes = np.zeros((len(channels), len(ys), len(xs)), np.int64)
        planes[:, y, x] = rows[channels].to_numpy().T
        # The outermost rows and columns are the image's own or else halo, whose results aren't used.
        border, there = np.ones(planes.shape[1:], bool), np.zeros(planes.shape[1:], bool)
        border[1:-1, 1:-1] = False
        out = kernel(planes, border)
        there[y, x] = True
        gy, gx = np.meshgrid(ys, xs, indexing="ij")
        own = there & (gy >= ty * size) & (gy < (ty + 1) * size) & (gx >= tx * size) & (gx < (tx + 1) * size)
        result = pd.DataFrame({"image_id": rows["image_id"].iloc[0], "y": gy[own].astype(np.int32), "x": gx[own].astype(np.int32)})
        for k, c in enumerate(channels):
            result[c] = out[k][own].astype(np.int32)
        return result

    return parts.groupBy("image_id", "_ty", "_tx").applyInPandas(run, f"image_id long, y int, x int, {fields}")


def _nine(planes: np.ndarray) -> np.ndarray:
    p = np.pad(planes, ((0, 0), (1, 1), (1, 1)))
    h, w = planes.shape[1:]
    return sum(p[:, j : j + h, i : i + w] for j in range(3) for i in range(3))


def _cut(a: np.ndarray, b: int) -> np.ndarray:
    return np.sign(a) * (np.abs(a) // b)


def sharpen(strength: int) -> Kernel:
    f = 11 - strength
    return lambda p, border: np.where(border, p, _cut((9 + f) * p - _nine(p), f))


def smooth(strength: int) -> Kernel:
    m = 11 - strength
    return lambda p, border: np.where(border, p, _cut((m - 1) * p + _nine(p), 8 + m))


def nl_means(patch: int, search: int, bandwidth: float) -> Kernel:
    """Means over the search window, weighted by how alike the patches around two pixels are; borders reflect."""

    def run(p: np.ndarray, border: np.ndarray) -> np.ndarray:
        r = patch + search
        wide = np.pad(p.astype(np.float64), ((0, 0), (r, r), (r, r)), mode="reflect")
        h, w = p.shape[1:]
        total, weight = np.zeros(p.shape), np.zeros((h, w))

        def patch_sum(a: np.ndarray) -> np.ndarray:
            return sum(a[j : j + h, i : i + w] for j in range(2 * patch + 1) for i in range(2 * patch + 1))

        here = wide[:, search : search + h + 2 * patch, search : search + w + 2 * patch]
        for dy in range(-search, search + 1):
            for dx in range(-search, search + 1):
                there = wide[:, search + dy : search + dy + h + 2 * patch, search + dx : search + dx + w + 2 * patch]
                near = np.exp(-patch_sum(((here - there) ** 2).sum(axis=0)) / (bandwidth**2 * (2 * patch + 1) ** 2 * len(p)))
                total += near * there[:, patch : patch + h, patch : patch + w]
                weight += near
        return np.trunc(total / weight).astype(np.int64)

    return run


def to_tiles(df: DataFrame, channels: list[str], size: int = SIZE) -> DataFrame:
    """(image_id, ty, tx, y0, x0, h, w, <channel arrays>): row-major arrays of each tile, for storage."""
    ty, tx = F.expr(f"cast(y div {size} as int)"), F.expr(f"cast(x div {size} as int)")
    cells = F.sort_array(F.collect_list(F.struct("y", "x", *channels)))
    t = df.groupBy("image_id", ty.alias("ty"), tx.alias("tx")).agg(cells.alias("c"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"))
    return t.select("image_id", "ty", "tx", "y0", "x0", "h", "w", *[F.col("c")[n].alias(n) for n in channels])


def from_tiles(t: DataFrame, channels: list[str]) -> DataFrame:
    each = t.select("image_id", "y0", "x0", "w", F.posexplode(F.arrays_zip(*channels)).alias("i", "p"))
    return each.select("image_id", F.expr("cast(y0 + i div w as int)").alias("y"), F.expr("cast(x0 + i % w as int)").alias("x"), *[F.col("p")[n].alias(n) for n in channels])
