"""Crop, rotation, previews: where pixels are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotate(df: DataFrame, code: int, height: int, width: int) -> DataFrame:
    """Quarter turns clockwise as a projection of the coordinates (0 to 3)."""
    y, x = F.col("y"), F.col("x")
    to = {0: (y, x), 1: (x, height - 1 - y), 2: (height - 1 - y, width - 1 - x), 3: (width - 1 - x, y)}[code % 4]
    return df.withColumns({"y": to[0].cast("int"), "x": to[1].cast("int")})


def crop(df: DataFrame, top: int, left: int, height: int, width: int, of_height: int, of_width: int) -> DataFrame:
    """A window with its own coordinates; a window that doesn't fit changes nothing."""
    if top < 0 or left < 0 or height <= 0 or width <= 0 or top + height > of_height or left + width > of_width:
        return df
    inside = df.where(F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1))
    return inside.withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def cfa_color(pattern: str, y: Column, x: Column, size: int = 2, top: int = 0, left: int = 0) -> Column:
    """Colour (0 red, 1 green, 2 blue) of a site of a repeating pattern, by uncropped coordinates."""
    codes = [{"R": 0, "G": 1, "B": 2}[c] for c in pattern]
    at = F.pmod(y + top, F.lit(size)) * size + F.pmod(x + left, F.lit(size))
    return F.element_at(F.array(*[F.lit(c) for c in codes]), at.cast("int") + 1)


def shifted_pattern(pattern: str, size: int, down: int, left: int) -> str:
    """The pattern as it starts `down` rows and `left` columns further."""
    return "".join(pattern[(y + down) % size * size + (x + left) % size] for y in range(size) for x in range(size))


def preview(df: DataFrame, factor: int, height: int, width: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Means of factor x factor blocks in whole numbers; incomplete blocks are left out."""
    rows, columns = height // factor, width // factor
    block = df.where((F.col("y") < rows * factor) & (F.col("x") < columns * factor))
    block = block.groupBy("image_id", F.expr(f"y div {factor}").cast("int").alias("y"), F.expr(f"x div {factor}").cast("int").alias("x"))
    return block.agg(*[F.expr(f"sum({c}) div {factor * factor}").cast("int").alias(c) for c in channels])


def preview_factor(height: int, width: int, view_height: int, view_width: int) -> int:
    """How much smaller a preview may be to fill nine tenths of a view."""
    return max(1, int(min(height / view_height, width / view_width) * 0.9))


def contains(outer: dict, inner: dict) -> Column:
    """Whether a rectangle (x, y, w, h columns) lies in another."""
    return (inner["x"] >= outer["x"]) & (inner["y"] >= outer["y"]) & (inner["x"] + inner["w"] <= outer["x"] + outer["w"]) & (inner["y"] + inner["h"] <= outer["y"] + outer["h"])


def intersection(a: dict, b: dict) -> list[Column]:
    """Overlap of two rectangles: x, y, w, h, with w and h at least 0."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    return [x, y, F.greatest(w, F.lit(0)), F.greatest(h, F.lit(0))]


def tile_starts(height: int, width: int, tile_height: int, tile_width: int) -> tuple[Column, Column]:
    """Rows and columns at which the tiles of an image start, as arrays."""
    steps = lambda n, t: F.sequence(F.lit(0), F.lit(max(0, n - 1)), F.lit(t))
    return steps(height, tile_height), steps(width, tile_width)
