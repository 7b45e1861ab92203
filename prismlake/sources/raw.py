"""Sensor data of raw files as slices: one row for each strip or tile, with its decoder.

The tags say where the data lies and how it is packed; maker and compression choose
the decoder. Slices that reach beyond their file are left out.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prismlake.codec.trees import TREES, lane_options, tree_of_codes

# Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, MAKE, STRIP_AT, STRIP_SIZE, ROWS, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, SUBFILE, DNG_VERSION = 256, 257, 258, 259, 271, 273, 279, 278, 322, 323, 324, 325, 254, 0xC612
#: Tags of makers: a Nikon linearisation table (the first that is there), a Pentax code, the pieces of Canon rows.
LINEAR, LINEAR_OLD, CODES, PIECES = 0x96, 0x8C, 0x220, 0xC640

#: (maker as a prefix in capitals, compression or None for any, codec, options); the first that fits counts.
FORMS: list[tuple[str, int | None, str, str]] = [
    ("NIKON", 34713, "two_lane", "{}"), ("NIKON", 1, "packed", '{"bits": 12}'), ("PENTAX", 65535, "two_lane", "{}"), ("RICOH", 65535, "two_lane", "{}"), ("CANON", 6, "lossless_jpeg", "{}"),
    ("SONY", 32767, "blocks16", "{}"), ("SONY", 1, "words", '{"big": false}'), ("OLYMPUS", None, "adaptive", "{}"), ("PANASONIC", None, "blocks14", "{}"), ("LEICA", None, "blocks14", "{}"), ("FUJIFILM", None, "words", '{"big": false}'),
    ("", 7, "lossless_jpeg", "{}"), ("", 1, "plain", "{}"), ("", 32773, "packbits", "{}"),
]


def form(make: Column, compression: Column) -> Column:
    """Struct of codec and options; null where none fits."""
    out = None
    for prefix, how, codec, options in FORMS:
        fits = F.upper(F.coalesce(make, F.lit(""))).startswith(prefix)
        fits = fits if how is None else fits & (compression == how)
        value = F.struct(F.lit(codec).alias("codec"), F.lit(options).alias("options"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def raw_directories(tags: DataFrame) -> DataFrame:
    """(path, ifd_id, w, h, bits, compression, make, at, size, rows, tw, th, little): full-size directories with data.

    Smaller versions (an odd subfile type) and compressions that aren't raw are
    left out.
    """
    ok = tags.where("error IS NULL")
    if "bytes" not in ok.columns:  # tags without what makers say
        ok = ok.withColumn("bytes", F.lit(None).cast("binary"))
    nums = lambda t: F.max(F.when(F.col("tag") == t, F.col("nums")))
    each = ok.groupBy("path", "ifd_id").agg(
        *[nums(t).alias(n) for t, n in ((WIDTH, "w"), (HEIGHT, "h"), (BITS, "bits"), (COMPRESSION, "compression"), (STRIP_AT, "strip_at"), (STRIP_SIZE, "strip_size"), (ROWS, "rows"), (TILE_WIDTH, "tw"), (TILE_HEIGHT, "th"), (TILE_AT, "tile_at"), (TILE_SIZE, "tile_size"), (SUBFILE, "sub"))],
        F.max("little").alias("little"),
    )
    make = ok.where(F.col("tag") == MAKE).groupBy("path").agg(F.min_by("text", "preorder").alias("make"))
    # What makers say of the whole file, in the first directory that has it.
    of = lambda t, c: F.min_by(F.when(F.col("tag") == t, c), F.when(F.col("tag") == t, F.col("preorder")))
    raw = F.struct("bytes", "little")
    said = ok.where(F.col("tag").isin(LINEAR, LINEAR_OLD, CODES, PIECES)).groupBy("path")
    said = said.agg(F.coalesce(of(LINEAR, raw), of(LINEAR_OLD, raw)).alias("linear"), of(CODES, raw).alias("codes"), of(PIECES, F.col("nums")).alias("pieces"))
    one = lambda c: F.col(c)[0].cast("int")
    each = each.join(make, "path", "left").join(said, "path", "left").select(
        "path", "ifd_id", one("w").alias("w"), one("h").alias("h"), F.coalesce(one("bits"), F.lit(16)).alias("bits"), F.coalesce(one("compression"), F.lit(1)).alias("compression"), "make",
        F.coalesce("tile_at", "strip_at").alias("at"), F.coalesce("tile_size", "strip_size").alias("size"), F.coalesce(one("rows"), one("h")).alias("rows"), F.coalesce(one("tw"), one("w")).alias("tw"), F.coalesce(one("th"), one("rows"), one("h")).alias("th"),
        F.coalesce(one("sub"), F.lit(0)).alias("sub"), "little", "linear", "codes", "pieces",
    )
    return each.where("at IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AND (sub & 1) = 0")


def largest(directories: DataFrame) -> DataFrame:
    """The directory with the most pixels of each file."""
    best = directories.groupBy("path").agg(F.max_by("ifd_id", F.struct(F.col("w").cast("long") * F.col("h"), -F.col("ifd_id"))).alias("ifd_id"))
    return directories.join(best, ["path", "ifd_id"])


def olympus_strips(d: DataFrame) -> DataFrame:
    """Olympus data in several strips as one strip of the whole image: words, or interlaced rows if it is too short for words.

    Data too short for both get a codec that no decoder has, so an error row.
    """
    total, pixels = F.expr("aggregate(size, 0D, (a, x) -> a + x)"), F.col("w").cast("long") * F.col("h")
    codec = F.when(total >= pixels * 2, "words").when(total * 2 >= pixels * 3, "interlaced").otherwise("olympus of unknown form")
    options = F.when(codec == "words", F.concat(F.lit('{"big": '), (~F.col("little")).cast("string"), F.lit(', "shift": 4}'))).otherwise("{}")
    many = F.upper(F.coalesce("make", F.lit(""))).startswith("OLYMPUS") & (F.size("at") > 1)
    whole = {
        "form": F.struct(codec.alias("codec"), options.alias("options")), "at": F.expr("slice(at, 1, 1)"), "size": F.array(total),
        "tw": F.col("w"), "th": F.col("h"),
    }
    types = dict(d.dtypes)
    return d.withColumns({c: F.when(many, v.cast(types[c])).otherwise(F.col(c)) for c, v in whole.items()})


def sony_strips(d: DataFrame) -> DataFrame:
    """Compressed Sony data: running sums over columns where the size isn't that of the samples, with eight rows more; else blocks or 12-bit samples.

    Other depths get a codec that no decoder has, so an error row.
    """
    sony = F.upper(F.coalesce("make", F.lit(""))).startswith("SONY") & (F.col("compression") == 32767)
    sums = F.col("size")[0].cast("long") * 8 != F.col("w").cast("long") * F.col("h") * F.col("bits")
    codec = F.when(sums, "column_sum").when(F.col("bits") == 8, "blocks16").when(F.col("bits") == 12, "packed").otherwise("sony of unknown form")
    options = F.when(codec == "packed", '{"bits": 12, "order": "lsb"}').otherwise("{}")
    types, taller = dict(d.dtypes), F.col("h") + F.when(sums, 8).otherwise(0)
    whole = {"form": F.struct(codec.alias("codec"), options.alias("options")), "h": taller, "th": taller}
    return d.withColumns({c: F.when(sony, v.cast(types[c])).otherwise(F.col(c)) for c, v in whole.items()})


@F.pandas_udf(StringType())
def maker_options(make: pd.Series, compression: pd.Series, bits: pd.Series, linear: pd.DataFrame, codes: pd.DataFrame, pieces: pd.Series, otherwise: pd.Series) -> pd.Series:
    """The decoder's options where a maker's own tables decide: Nikon's and Pentax's codes and curves, Canon's pieces."""

    def one(make: str | None, how: int, depth: int, table: bytes | None, little: bool, code: bytes | None, order: bool, cut, plain: str) -> str:
        make = (make or "").upper()
        if make.startswith("NIKON") and how == 34713 and table is not None:
            return json.dumps(lane_options(bytes(table), depth, bool(little)))
        if make.startswith(("PENTAX", "RICOH")) and how == 65535:
            return json.dumps({"tree": TREES["pentax"] if code is None else tree_of_codes(bytes(code), bool(order))})
        if make.startswith("CANON") and how == 6 and cut is not None and len(cut) == 3 and cut[0] > 0:
            return json.dumps({"slices": [int(cut[1])] * int(cut[0]) + [int(cut[2])]})
        return plain

    rows = zip(make, compression, bits, linear["bytes"], linear["little"], codes["bytes"], codes["little"], pieces, otherwise, strict=True)
    return pd.Series([one(*r) for r in rows], dtype="object")


def raw_slices(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Slices of the largest raw directory of each file, ready for `slices.decode`, with the path."""
    d = largest(raw_directories(tags)).withColumn("form", form(F.col("make"), F.col("compression"))).where("form IS NOT NULL")
    options = maker_options("make", "compression", "bits", "linear", "codes", "pieces", F.col("form.options"))
    d = d.withColumn("_options", options).withColumn("form", F.struct("form.codec", F.col("_options").alias("options"))).drop("_options")
    d = sony_strips(olympus_strips(d))
    each = d.select("*", F.posexplode(F.arrays_zip("at", "size")).alias("slice", "s")).join(files.select("path", "content", F.length("content").alias("_n")), "path")
    each = each.where("s.at + s.size <= _n")
    across = F.ceil(F.col("w") / F.col("tw"))
    off_y, off_x = (F.floor(F.col("slice") / across) * F.col("th")).cast("int"), (F.col("slice") % across * F.col("tw")).cast("int")
    plain = F.col("form.codec") == "plain"
    codec = F.when(plain & (F.col("bits") == 16), "words").when(plain, "packed").otherwise(F.col("form.codec"))
    options = F.when(plain & (F.col("bits") == 16), F.concat(F.lit('{"big": '), (~F.col("little")).cast("string"), F.lit("}"))).when(plain, F.concat(F.lit('{"bits": '), F.col("bits").cast("string"), F.lit("}"))).otherwise(F.col("form.options"))
    return each.select(
        F.xxhash64("path").alias("image_id"), F.col("slice").cast("int").alias("slice"), off_y.alias("off_y"), off_x.alias("off_x"), F.least(F.col("th"), F.col("h") - off_y).cast("int").alias("h"), F.least(F.col("tw"), F.col("w") - off_x).cast("int").alias("w"),
        codec.alias("codec"), options.alias("options"), F.expr("substring(content, cast(s.at as int) + 1, cast(s.size as int))").alias("data"), "path",
    )
