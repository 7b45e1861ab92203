"""Images out: Parquet tables, PPM, BMP, PNG and TIFF files' bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ppm(rgb: np.ndarray) -> bytes:
    """Plain text, three numbers a pixel, one row a line."""
    lines = [" ".join(map(str, row.ravel())) for row in rgb]
    return f"P3\n{rgb.shape[1]} {rgb.shape[0]}\n255\n".encode() + "\n".join(lines).encode() + b"\n"


def bmp(rgb: np.ndarray) -> bytes:
    """24 bits, rows from the bottom, padded to four bytes."""
    h, w, _ = rgb.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = np.hstack([np.zeros((h, 1), np.uint8), rgb.reshape(h, 3 * w)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(rgb: np.ndarray, little: bool = True) -> bytes:
    """One uncompressed strip of 8 or 16 bits a sample."""
    o = "<" if little else ">"
    h, w, n = rgb.shape
    deep = rgb.dtype.itemsize == 2
    body = rgb.astype(f"{o}u2" if deep else np.uint8).tobytes()
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16 if deep else 8), (259, 3, 1, 1), (262, 3, 1, 2 if n == 3 else 1), (273, 4, 1, 0), (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, len(body))]
    start = 8 + 2 + 12 * len(entries) + 4
    out = (b"II" if little else b"MM") + struct.pack(f"{o}HI", 42, 8) + struct.pack(f"{o}H", len(entries))
    for tag, kind, count, value in entries:
        value = start if tag == 273 else value
        out += struct.pack(f"{o}HHI", tag, kind, count) + (struct.pack(f"{o}HH", value, 0) if kind == 3 else struct.pack(f"{o}I", value))
    return out + struct.pack(f"{o}I", 0) + body


FORMATS: dict[str, Callable[[np.ndarray], bytes]] = {"ppm": ppm, "bmp": bmp, "png": png, "tif": tiff, "tiff": tiff}


def files(pixels: DataFrame, extension: str, depth: int) -> DataFrame:
    """(image_id, content): 8-bit pixels of each image in a format, by its extension.

    An image is gathered in one task, as its file is one run of bytes.
    """
    if extension not in FORMATS:
        raise ValueError(f"no writer for .{extension}")
    write = FORMATS[extension]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = rows["y"].max() + 1, rows["x"].max() + 1
        rgb = np.zeros((h, w, 3), np.uint8)
        rgb[rows["y"], rows["x"]] = np.clip(rows[["r", "g", "b"]].to_numpy() >> (depth - 8), 0, 255)
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "content": [write(rgb)]})

    return pixels.select("image_id", "y", "x", "r", "g", "b").groupBy("image_id").applyInPandas(run, "image_id long, content binary")


def save(df: DataFrame, path: str) -> None:
    """Pixels as Parquet, a folder for each image, so that a reader of one image skips the others."""
    df.withColumn("image", F.col("image_id")).repartition("image").sortWithinPartitions("y", "x").write.partitionBy("image").parquet(path)
