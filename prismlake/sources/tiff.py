"""Directories and tags of TIFF-like files, and uncompressed TIFF images.

Files are read with Spark's binaryFile source. Parsing is serial within a file and
parallel over files; only the header bytes that a tag needs are looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions.metadata import TYPE_BYTES

#: Marks after the byte order: the usual one, and makers' own.
MAGIC = {42, 0x4F52, 0x5352, 0x55, 0x4F, 0x52}
SUB_IFD, EXIF, GPS, MAKER_NOTE, PRIVATE = 0x14A, 0x8769, 0x8825, 0x927C, 0xC634
DEEPEST, MOST_CHAINED = 20, 100
TAGS = "path string, ifd_id int, parent_id int, preorder int, depth int, kind string, little boolean, tag int, dtype int, cnt long, offset long, nums array<double>, text string, bytes binary, error string"

#: Makers' notes: how they begin, bytes before the directory, whether offsets count from the note, order given in the note.
NOTES = [
    (b"Nikon\0\x02", 18, 10, True), (b"OLYMPUS\0II", 12, 0, False), (b"OLYMP\0", 8, None, False), (b"FUJIFILM", None, 0, False), (b"PENTAX \0", 10, 0, False), (b"AOC\0", 6, None, False),
    (b"Panasonic\0\0\0", 12, None, False), (b"EPSON\0", 8, None, False), (b"II*\0", 8, 0, False), (b"MM\0*", 8, 0, False),
]


class File:
    """One file's bytes in one byte order."""

    def __init__(self, data: bytes, little: bool):
        self.data, self.little = data, little

    def number(self, at: int, size: int) -> int:
        if at < 0 or at + size > len(self.data):
            raise ValueError(f"offset {at} is outside the file")
        return int.from_bytes(self.data[at : at + size], "little" if self.little else "big")

    def values(self, kind: int, count: int, at: int) -> tuple[list[float] | None, str | None, bytes | None]:
        size = TYPE_BYTES[kind] * count
        raw = self.data[at : at + size]
        if len(raw) < size:
            raise ValueError("value is outside the file")
        if kind == 2:
            return None, raw.split(b"\0")[0].decode("latin-1"), None
        if kind == 7:
            return None, None, raw
        order = "<" if self.little else ">"
        if kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            return [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)], None, None
        letter = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}[kind]
        return [float(v) for v in struct.unpack(f"{order}{count}{letter}", raw)], None, None


def walk(data: bytes) -> Iterator[dict]:
    """A row for each tag, in the order in which the tree of directories is walked; the first of a tag in a directory counts."""
    order = data[:2]
    if order not in (b"II", b"MM"):
        raise ValueError("no byte order")
    top = File(data, order == b"II")
    if top.number(2, 2) not in MAGIC:
        raise ValueError("no TIFF mark")
    count = {"ifd": 0, "tag": 0}

    def directory(f: File, at: int, parent: int | None, depth: int, kind: str, shift: int) -> Iterator[dict]:
        if depth > DEEPEST:
            raise ValueError("directories are nested too deep")
        me, count["ifd"] = count["ifd"], count["ifd"] + 1
        seen, children = set(), []
        for k in range(f.number(at, 2)):
            entry = at + 2 + 12 * k
            tag, dtype, cnt = f.number(entry, 2), f.number(entry + 2, 2), f.number(entry + 4, 4)
            if tag in seen:
                continue
            seen.add(tag)
            row = {"ifd_id": me, "parent_id": parent, "preorder": count["tag"], "depth": depth, "kind": kind, "little": f.little, "tag": tag, "dtype": dtype, "cnt": cnt, "offset": None, "nums": None, "text": None, "bytes": None, "error": None}
            count["tag"] += 1
            try:
                size = TYPE_BYTES[dtype] * cnt
                row["offset"] = entry + 8 if size <= 4 else f.number(entry + 8, 4) + shift
                row["nums"], row["text"], row["bytes"] = f.values(dtype, cnt, row["offset"])
            except (KeyError, ValueError) as e:
                row["error"] = str(e)
            yield row
            if row["error"] is None:
                children.append(row)
        for row in children:
            try:
                if row["tag"] in (SUB_IFD, EXIF, GPS) and row["nums"]:
                    for start in row["nums"]:
                        yield from directory(f, int(start) + shift, me, depth + 1, {SUB_IFD: "sub", EXIF: "exif", GPS: "gps"}[row["tag"]], shift)
                elif row["tag"] == MAKER_NOTE and row["bytes"]:
                    yield from note(f, row["bytes"], row["offset"], me, depth + 1)
                elif row["tag"] == PRIVATE and row["bytes"]:
                    yield from private(row["bytes"], me, depth + 1)
            except ValueError as e:
                yield {**row, "ifd_id": count["ifd"], "parent_id": me, "kind": "bad", "nums": None, "text": None, "bytes": None, "error": str(e)}

    def note(f: File, raw: bytes, at: int, parent: int, depth: int) -> Iterator[dict]:
        """A maker's note: a directory with its own start, order and base of offsets."""
        for mark, skip, base, nested in NOTES:
            if not raw.startswith(mark):
                continue
            if mark == b"FUJIFILM":
                own = File(raw, True)
                yield from directory(own, own.number(8, 4), parent, depth, "maker", 0)
            elif nested:
                own = File(raw[base:], raw[base : base + 2] == b"II")
                yield from directory(own, own.number(4, 4), parent, depth, "maker", 0)
            elif base == 0:
                little = {b"II": True, b"MM": False}.get(raw[8:10], {b"II": True, b"MM": False}.get(raw[:2], f.little))
                yield from directory(File(raw, little), skip, parent, depth, "maker", 0)
            else:
                yield from directory(f, at + skip, parent, depth, "maker", 0)
            return
        yield from directory(f, at, parent, depth, "maker", 0)

    def private(raw: bytes, parent: int, depth: int) -> Iterator[dict]:
        """A maker's note that was moved: name, MakN, length, byte order, place it came from, then the note."""
        if not raw.startswith(b"Adobe\0MakN"):
            return
        size, little, old = int.from_bytes(raw[10:14], "big"), raw[14:16] == b"II", int.from_bytes(raw[16:20], "big")
        if size > 300 << 20:
            raise ValueError("private data is too long")
        # Offsets count from the place in the file where the note once was.
        body = raw[20 : 14 + size]
        skip = next((n[1] for n in NOTES if n[1] is not None and body.startswith(n[0])), 0)
        yield from directory(File(body, little), skip, parent, depth, "private", -old)

    at, chained = top.number(4, 4), 0
    while at:
        chained += 1
        if chained > MOST_CHAINED:
            raise ValueError("too many directories")
        yield from directory(top, at, None, 0, "main", 0)
        at = top.number(at + 2 + 12 * top.number(at, 2), 4)


def read_tags(files: DataFrame) -> DataFrame:
    """Tags of files (path, content); a file that isn't readable gives one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TAGS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    for row in walk(bytes(content)):
                        rows.append({"path": path, **row})
                except ValueError as e:
                    rows.append({"path": path, "error": str(e)})
                if rows:
                    out = pd.DataFrame(rows).reindex(columns=names)
                    for c in ("ifd_id", "parent_id", "preorder", "depth", "tag", "dtype"):
                        out[c] = out[c].astype("Int32")
                    out["cnt"], out["offset"] = out["cnt"].astype("Int64"), out["offset"].astype("Int64")
                    for c in ("kind", "little", "nums", "text", "bytes", "error"):
                        out[c] = pd.Series([row.get(c) for row in rows], dtype=object)
                    yield out

    return files.select("path", "content").mapInPandas(run, TAGS)


def read_files(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, length, content) of the files under a path with any of the extensions."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(path)
    if extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions]))
    return files


WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE = 256, 257, 258, 259, 273, 277, 278, 279


def strips(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Slices of the first directory of TIFF images: strips, uncompressed or run-length coded.

    Strips that reach beyond the file are left out.
    """
    first = tags.where("ifd_id = 0 AND error IS NULL").groupBy("path").agg(*[F.max(F.when(F.col("tag") == t, F.col("nums"))).alias(n) for n, t in (("w", WIDTH), ("hh", HEIGHT), ("bits", BITS), ("how", COMPRESSION), ("at", STRIP_AT), ("rows", ROWS), ("size", STRIP_SIZE), ("n", SAMPLES))], F.max("little").alias("little"))
    each = files.select("path", "content", F.length("content").alias("length")).join(first, "path")
    each = each.select("*", F.posexplode(F.arrays_zip("at", "size")).alias("slice", "s")).where("s.at + s.size <= length")
    rows = F.coalesce(F.col("rows")[0], F.col("hh")[0])
    samples = F.coalesce(F.col("n")[0], F.lit(1))
    codec = F.when(F.col("how")[0] == 32773, "packbits").when(F.col("bits")[0] == 16, "words").otherwise("packed")
    options = F.when(codec == "words", F.concat(F.lit('{"big": '), (~F.col("little")).cast("string"), F.lit("}"))).when(codec == "packed", F.concat(F.lit('{"bits": '), F.col("bits")[0].cast("int").cast("string"), F.lit("}")))
    off = (F.col("slice") * rows).cast("int")
    return each.select(
        F.xxhash64("path").alias("image_id"), F.col("slice").cast("int").alias("slice"), off.alias("off_y"), F.lit(0).alias("off_x"), F.least(rows, F.col("hh")[0] - off).cast("int").alias("h"), (F.col("w")[0] * samples).cast("int").alias("w"),
        codec.alias("codec"), F.coalesce(options, F.lit("{}")).alias("options"), F.expr("substring(content, cast(s.at as int) + 1, cast(s.size as int))").alias("data"), "path",
    )
