"""Containers that aren't TIFF: Fuji's header and tags, Canon's heap directories, camera lists in XML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions.metadata import unsigned

#: Where Fuji's header holds offsets and lengths (big-endian, four bytes each).
RAF = {"jpeg_at": 84, "jpeg_size": 88, "tags_at": 92, "tags_size": 96, "data_at": 100, "data_size": 104}


def raf_header(content: Column) -> list[Column]:
    """Offsets and lengths of the preview, the tags and the data."""
    return [unsigned(content, at, 4, False).alias(name) for name, at in RAF.items()]


def raf_tags(files: DataFrame) -> DataFrame:
    """(path, tag, size, a, b, bytes) of Fuji's own tag block; a and b are the first two big-endian words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                at = int.from_bytes(data[RAF["tags_at"] : RAF["tags_at"] + 4], "big")
                count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
                for _ in range(min(count, 255)):
                    if at + 4 > len(data):
                        break
                    tag, size = int.from_bytes(data[at : at + 2], "big"), int.from_bytes(data[at + 2 : at + 4], "big")
                    body = data[at + 4 : at + 4 + size]
                    rows.append((path, tag, size, int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big"), body))
                    at += 4 + size
            yield pd.DataFrame(rows, columns=["path", "tag", "size", "a", "b", "bytes"])

    return files.select("path", "content").mapInPandas(run, "path string, tag int, size int, a int, b int, bytes binary")


def heap_entries(data: bytes, depth: int = 10) -> Iterator[tuple[int, int, int, bytes]]:
    """(directory, parent, tag, bytes) of a heap: its last four bytes say where the directory begins.

    Directories hold entries of ten bytes; two kinds of entry are heaps themselves,
    and one keeps its value in the entry.
    """
    little = data[:2] == b"II"
    number = lambda at, n: int.from_bytes(data[at : at + n], "little" if little else "big")
    made = 0

    def heap(start: int, end: int, parent: int, level: int) -> Iterator[tuple[int, int, int, bytes]]:
        nonlocal made
        if level > depth or end - 4 < start or end > len(data):
            raise ValueError("heap is outside the file or nested too deep")
        me, made = made, made + 1
        at = start + number(end - 4, 4)
        if at + 2 > end:
            raise ValueError("directory is outside the heap")
        for k in range(number(at, 2)):
            e = at + 2 + 10 * k
            tag, size, off = number(e, 2), number(e + 2, 4), number(e + 6, 4)
            if tag & 0xC000 == 0x4000:
                yield me, parent, tag & 0x3FFF, data[e + 2 : e + 10]
            elif tag & 0x3800 in (0x2800, 0x3000):
                yield me, parent, tag & 0x3FFF, b""
                yield from heap(start + off, start + off + size, me, level + 1)
            else:
                yield me, parent, tag & 0x3FFF, data[start + off : start + off + size]

    yield from heap(number(2, 4), len(data), -1, 0)


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """(make, model, mode, ord, black, white, supported) of a camera list in XML, one row for each sensor entry."""
    schema = "_make string, _model string, _mode string, _supported string, Sensor array<struct<_black:int,_white:int,_iso_min:int,_iso_max:int>>"
    raw = spark.read.format("xml").option("rowTag", "Camera").schema(schema).load(path)
    each = raw.select("*", F.posexplode_outer("Sensor").alias("ord", "s"))
    return each.select(
        F.col("_make").alias("make"), F.col("_model").alias("model"), F.coalesce("_mode", F.lit("")).alias("mode"), "ord", F.col("s._black").alias("black"), F.col("s._white").alias("white"),
        F.coalesce("s._iso_min", F.lit(0)).alias("lo"), F.coalesce("s._iso_max", F.lit(0)).alias("hi"), (F.coalesce("_supported", F.lit("yes")) != "no").alias("supported"),
    )
