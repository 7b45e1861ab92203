"""Corrections that a raw file lists as opcodes: maps, gains, offsets, bad pixels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.functions import tone

from .lookup import small


@dataclass
class Region:
    """Rows top to bottom - 1 and columns left to right - 1, every row_pitch-th and col_pitch-th."""

    top: int
    left: int
    bottom: int
    right: int
    row_pitch: int = 1
    col_pitch: int = 1

    def holds(self) -> Column:
        y, x = F.col("y"), F.col("x")
        inside = (y >= self.top) & (y < self.bottom) & (x >= self.left) & (x < self.right)
        return inside & ((y - self.top) % self.row_pitch == 0) & ((x - self.left) % self.col_pitch == 0)


def _within(v: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), v)).cast("int")


def map_values(df: DataFrame, region: Region, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("v", F.when(region.holds(), f(F.col("v"))).otherwise(F.col("v")))


def map_table(df: DataFrame, region: Region, table: list[int]) -> DataFrame:
    """Values by a table; those beyond its end take the last entry."""
    return map_values(df, region, lambda v: tone.apply_lut(F.least(v, F.lit(len(table) - 1)), table))


def map_polynomial(df: DataFrame, region: Region, coefficients: list[float], most: int) -> DataFrame:
    """Polynomial of the value as a share of `most`, lowest power first (Horner's rule)."""

    def value(v: Column) -> Column:
        n = v / float(most)
        out = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = F.lit(c) + n * out
        return _within((out * float(most)).cast("long"), most)

    return map_values(df, region, value)


def gain_map(df: DataFrame, gains: DataFrame, top: int, left: int, step_y: int, step_x: int, most: int) -> DataFrame:
    """Values times the gain (gy, gx, gain) of the nearest cell of a coarse grid."""
    cell = df.withColumns({"gy": F.expr(f"cast((y - {top}) div {step_y} as int)"), "gx": F.expr(f"cast((x - {left}) div {step_x} as int)")})
    out = cell.join(small(gains), ["gy", "gx"], "left")
    return out.select("image_id", "y", "x", _within((F.col("v") * F.coalesce("gain", F.lit(1.0))).cast("long"), most).alias("v"))


def offset_by(df: DataFrame, deltas: DataFrame, axis: str, most: int) -> DataFrame:
    """Adds a delta (k, d) by row or column."""
    out = df.join(small(deltas), F.col(axis) == F.col("k"), "left")
    return out.select("image_id", "y", "x", _within(F.col("v") + F.coalesce("d", F.lit(0)), most).alias("v"))


def scale_by(df: DataFrame, factors: DataFrame, axis: str, most: int) -> DataFrame:
    """Multiplies by a factor (k, d) in 1024ths by row or column, rounded."""
    out = df.join(small(factors), F.col(axis) == F.col("k"), "left")
    return out.select("image_id", "y", "x", _within(F.shiftright(F.coalesce("d", F.lit(1024)).cast("long") * F.col("v") + 512, 10), most).alias("v"))


def bad_pixels(df: DataFrame, constant: Column, points: DataFrame, rectangles: list[tuple[int, int, int, int]]) -> DataFrame:
    """(image_id, y, x): samples of a marked value, listed points, and rectangles (top, left, bottom, right); each once."""
    out = df.where(constant).select("image_id", "y", "x").unionByName(points.select("image_id", "y", "x"))
    images = df.select("image_id").distinct()
    for top, left, bottom, right in rectangles:
        rows = images.withColumn("y", F.explode(F.sequence(F.lit(top), F.lit(bottom - 1))))
        out = out.unionByName(rows.withColumn("x", F.explode(F.sequence(F.lit(left), F.lit(right - 1)))))
    return out.distinct()


#: Opcodes by number; each takes a frame and its parameters.
REGISTRY: dict[int, Callable[..., DataFrame]] = {4: bad_pixels, 5: bad_pixels, 7: map_table, 8: map_polynomial, 9: gain_map, 10: offset_by, 11: offset_by, 12: scale_by, 13: scale_by}
