"""Slices of sensor data to samples, and back.

A slice is a row (image_id, slice, off_y, off_x, h, w, codec, options, data). It is
the unit of work: slices decode independently, in Arrow batches, and a slice that
can't be decoded gives an error row instead of failing the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.codec.decoders import DECODERS
from prismlake.codec.encoders import ENCODERS

SLICE = "image_id long, slice int, off_y int, off_x int, h int, w int, codec string, options string, data binary"

#: Samples of a piece of a slice that goes to the JVM at once, if a row isn't longer.
PIECE = 1 << 16


def decode(slices: DataFrame) -> DataFrame:
    """(image_id, slice, y, x, v, error): samples, or one row with an error for a slice that fails.

    Python hands over pieces of whole rows as arrays; the JVM makes them rows of one sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(rows: list[tuple], values: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *[len(v) for v in values]]).astype(np.int32)
            bad = pa.array([r[-1] is not None for r in rows])
            flat = pa.array(np.concatenate(values).astype(np.int32, copy=False))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=bad)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.int32()] * 4, pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([*columns[:5], lists, columns[5]], ["image_id", "slice", "y", "x", "w", "v", "error"])

        for batch in batches:
            rows, values, held = [], [], 0
            for s in batch.to_pylist():
                try:
                    v = DECODERS[s["codec"]](s["data"], s["h"], s["w"], json.loads(s["options"] or "{}"))
                    step = max(1, PIECE // max(1, v.shape[1]))
                    found = [((s["image_id"], s["slice"], s["off_y"] + y, s["off_x"], v.shape[1], None), v[y : y + step].ravel()) for y in range(0, v.shape[0], step) if v.shape[1]]
                except Exception as e:  # bad data is a result, not a failure of the job
                    found = [((s["image_id"], s["slice"], None, None, None, f"{type(e).__name__}: {e}"), np.zeros(0, np.int32))]
                for row, v in found:
                    rows.append(row)
                    values.append(v)
                    held += len(v)
                    if held >= PIECE:
                        yield piece(rows, values)
                        rows, values, held = [], [], 0
            if rows:
                yield piece(rows, values)

    some = slices.select("image_id", "slice", "off_y", "off_x", "h", "w", "codec", "options", "data")
    pieces = some.mapInArrow(run, "image_id long, slice int, y int, x int, w int, v array<int>, error string")
    each = pieces.select("image_id", "slice", "y", "x", "w", F.posexplode_outer("v").alias("i", "v"), "error")
    return each.select("image_id", "slice", F.expr("y + cast(i div w as int)").alias("y"), F.expr("x + i % w").alias("x"), "v", "error")


def encode(samples: DataFrame, rows: int, codec: str, options: dict | None = None) -> DataFrame:
    """Samples (image_id, y, x, v) to slices of `rows` rows; each slice is gathered in one task."""
    o = options or {}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = part["y"].min(), part["x"].min()
        h, w = part["y"].max() - y0 + 1, part["x"].max() - x0 + 1
        v = np.zeros((h, w), np.int64)
        v[part["y"] - y0, part["x"] - x0] = part["v"]
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "slice": [part["slice"].iloc[0]], "off_y": [y0], "off_x": [x0], "h": [h], "w": [w], "codec": [codec], "options": [json.dumps(o)], "data": [ENCODERS[codec](v, o)]})

    return samples.withColumn("slice", F.expr(f"cast(y div {rows} as int)")).groupBy("image_id", "slice").applyInPandas(run, SLICE)


def too_many_errors(decoded: DataFrame, share: float = 0.25) -> DataFrame:
    """(image_id, errors, slices, too_many) by image."""
    out = decoded.groupBy("image_id").agg(F.count("error").alias("errors"), F.countDistinct("slice").alias("slices"))
    return out.withColumn("too_many", F.col("errors") > F.col("slices") * share)


def tile_rows(images: DataFrame, tile_height: int, tile_width: int) -> DataFrame:
    """One row for each tile of images (image_id, height, width), by rows: slice, off_y, off_x, h, w."""
    each = images.withColumn("off_y", F.explode(F.expr(f"sequence(0, height - 1, {tile_height})"))).withColumn("off_x", F.explode(F.expr(f"sequence(0, width - 1, {tile_width})")))
    across = F.ceil(F.col("width") / tile_width)
    number = (F.expr(f"off_y div {tile_height}") * across + F.expr(f"off_x div {tile_width}")).cast("int")
    return each.select("image_id", number.alias("slice"), "off_y", "off_x", F.least(F.lit(tile_height), F.col("height") - F.col("off_y")).alias("h"), F.least(F.lit(tile_width), F.col("width") - F.col("off_x")).alias("w"))
