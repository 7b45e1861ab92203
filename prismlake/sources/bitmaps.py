"""PNG and BMP files to pixels of eight bits.

A file is the unit of work. One that can't be read gives an error row instead of
failing the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bytes that a PNG begins with, and the channels of its kinds of colour.
PNG, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG without interlacing; transparency is left out, 16 bits give their high byte."""
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size or zlib.crc32(kind + chunk) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    width, height, bits, colour, _, _, interlaced = head
    if interlaced or colour not in CHANNELS:
        raise ValueError("interlaced files aren't read" if interlaced else "no such kind of colour")
    n = CHANNELS[colour]
    line, step = (width * n * bits + 7) // 8, max(1, n * bits // 8)
    raw = zlib.decompress(b"".join(body))
    if len(raw) < height * (line + 1):
        raise ValueError("too few pixels")
    rows = np.frombuffer(raw[: height * (line + 1)], np.uint8).reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        above = out[y] = unfiltered(int(rows[y, 0]), rows[y, 1:], above, step)
    if bits == 16:
        out = out[:, ::2]
    elif bits < 8:
        flat = np.unpackbits(out, axis=1).reshape(height, -1, bits)[:, : width * n]
        out = flat @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
        out = out if colour == 3 else out * (255 // ((1 << bits) - 1))
    out = out.reshape(height, width, n)
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("a colour that the palette lacks")
        return palette[out[:, :, 0]]
    return out[:, :, :3] if n >= 3 else np.repeat(out[:, :, :1], 3, axis=2)


def unfiltered(how: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line without its filter: none, left, up, mean or Paeth."""
    if how == 0:
        return line
    if how == 2:
        return line + above
    if how not in (1, 3, 4):
        raise ValueError("no such filter")
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for k in range(step, len(out)):
        a, b, c = out[k - step], up[k], up[k - step]
        if how == 1:
            guess = a
        elif how == 3:
            guess = a + b >> 1
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = out[k] + guess & 255
    return np.array(out[step:], np.uint8)


def bmp_pixels(data: bytes) -> np.ndarray:
    """(height, width, 3) of a BMP without compression: 24 or 32 bits, or a palette of 8, 4 or 1."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    start, size, width, height, _, bits, how = struct.unpack("<I I ii HH I", data[10:34])
    if how != 0 or bits not in (1, 4, 8, 24, 32):
        raise ValueError("compressed files aren't read" if how else "no such depth")
    line, tall = (width * bits + 31) // 32 * 4, abs(height)
    if start + line * tall > len(data):
        raise ValueError("too few pixels")
    rows = np.frombuffer(data, np.uint8, line * tall, start).reshape(tall, line)
    rows = rows if height < 0 else rows[::-1]
    if bits >= 24:
        return rows[:, : width * bits // 8].reshape(tall, width, bits // 8)[:, :, 2::-1]
    palette = np.frombuffer(data[14 + size : start], np.uint8)
    palette = palette[: len(palette) // 4 * 4].reshape(-1, 4)[:, 2::-1]
    at = np.unpackbits(rows, axis=1).reshape(tall, -1, bits)[:, :width] @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
    if at.max(initial=0) >= len(palette):
        raise ValueError("a colour that the palette lacks")
    return palette[at]


def pixels(files: DataFrame) -> DataFrame:
    """(path, y, x, r, g, b, error) of files (path, content), told apart by their first bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    data = bytes(content or b"")
                    v = png_pixels(data) if data[:8] == PNG else bmp_pixels(data)
                    y, x = np.indices(v.shape[:2]).astype(np.int32)
                    r, g, b = (v[:, :, k].ravel().astype(np.int32) for k in range(3))
                    yield pd.DataFrame({"path": path, "y": y.ravel(), "x": x.ravel(), "r": r, "g": g, "b": b, "error": None})
                except Exception as e:  # bad data is a result, not a failure of the job
                    none = pd.array([None], "Int32")
                    yield pd.DataFrame({"path": [path], **dict.fromkeys(("y", "x", "r", "g", "b"), none), "error": [f"{type(e).__name__}: {e}"]})

    return files.select("path", "content").mapInPandas(run, "path string, y int, x int, r int, g int, b int, error string")
