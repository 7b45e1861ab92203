"""Look-ups that are joins: by value, range, substring, nearness, hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a dimension table that may be broadcast.
BROADCAST_ROWS = 100_000


def small(dim: DataFrame) -> DataFrame:
    """A broadcast side if its checked size allows, else the side as it is."""
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def by_value(df: DataFrame, value: str, lut: DataFrame) -> DataFrame:
    """Adds out from a table (v, out); values without an entry stay null."""
    return df.join(small(lut.select(F.col("v").alias("_v"), "out")), F.col(value) == F.col("_v"), "left").drop("_v")


def first_containing(df: DataFrame, text: str, dim: DataFrame, name: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The first dimension row in `order` whose name contains the text.

    Distinct texts are matched, not rows: a nested loop over names and texts, both
    of dimension size, and an equi-join back.
    """
    texts = df.select(F.col(text).alias("_t")).where("_t IS NOT NULL").distinct()
    hit = texts.join(small(dim), F.col(name).contains(F.col("_t")), "left")
    hit = hit.groupBy("_t").agg(F.min_by(F.struct(*columns), F.col(order)).alias("_m"))
    return df.join(hit, F.col(text) == F.col("_t"), "left").select(*df.columns, *[F.col("_m")[c].alias(c) for c in columns])


def by_range(df: DataFrame, key: str, value: str, dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The row of `dim` (key, ord, lo, hi, ...) for a value: the only one, or else the first not default in range.

    lo and hi are whole numbers, hi = 0 is open; lo = hi = 0 is the default row. Each range
    is filed under the halved blocks of numbers that make it up (two a size at most), with the
    first row of each block kept, and each distinct value looks its blocks up. So values and
    ranges meet on a key, and no key's values meet all of its ranges.
    """
    if set(dict(dim.select("lo", "hi").dtypes).values()) - {"tinyint", "smallint", "int", "bigint"}:
        raise ValueError("ranges must have whole bounds")
    default = (F.col("lo") == 0) & (F.col("hi") == 0)
    d = dim.select(F.col(key).alias("_k"), "lo", "hi", F.struct(default.alias("d"), F.col("ord").isNull().alias("n"), F.col("ord").alias("o")).alias("_o"), F.struct(*columns).alias("_c"))
    first = (F.min_by("_c", "_o").alias("_c"), F.min("_o").alias("_o"))
    only = d.groupBy("_k").agg(F.count("*").alias("_rows"), F.min_by("_c", "_o").alias("_only")).where("_rows = 1").drop("_rows")

    # Whole numbers are even places and what lies between them is odd, so fractions are in range as they are.
    ends = d.where("lo IS NOT NULL AND hi IS NOT NULL").groupBy("_k", "lo", "hi").agg(*first)
    ends = ends.select("_k", "_c", "_o", (F.col("lo").cast("long") * 2).alias("_a"), F.when(F.col("hi") == 0, F.lit(1 << 62)).otherwise(F.col("hi").cast("long") * 2 + 1).alias("_e"))
    each = ends.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(62))))
    each = each.selectExpr("_k", "_c", "_o", "_l", "shiftright(_a + shiftleft(1L, _l) - 1, _l) AS _a", "shiftright(_e, _l) AS _e").where("_a < _e")
    each = each.selectExpr("_k", "_c", "_o", "_l", "explode(array(if(_a & 1 = 1, _a, NULL), if(_e & 1 = 1, _e - 1, NULL))) AS _n").where("_n IS NOT NULL")
    blocks = each.groupBy("_k", "_l", "_n").agg(*first)

    place = F.floor(value).cast("long") + F.ceil(value).cast("long")
    asked = df.select(F.col(key).alias("_k"), F.col(value).alias("_v"), place.alias("_p")).where("_k IS NOT NULL AND _p IS NOT NULL").distinct()
    asked = asked.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(62)))).withColumn("_n", F.expr("shiftright(_p, _l)"))
    hit = asked.join(blocks, ["_k", "_l", "_n"]).groupBy("_k", "_v").agg(F.min_by("_c", "_o").alias("_hit"))
    out = df.join(hit, (F.col(key) == F.col("_k")) & (F.col(value) == F.col("_v")), "left").drop("_k", "_v")
    out = out.join(small(only), F.col(key) == F.col("_k"), "left")
    return out.select(*df.columns, *[F.when(F.col("_only").isNotNull(), F.col("_only")[c]).otherwise(F.col("_hit")[c]).alias(c) for c in columns])


def by_mode(df: DataFrame, dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Camera by make, model and mode, or else the first of make and model."""
    key, exact = ["make", "model"], ["make", "model", "mode"]
    any_mode = dim.groupBy(*key).agg(F.min_by(F.struct(*columns), "ord").alias("_any"))
    one = dim.groupBy(*exact).agg(F.min_by(F.struct(*columns), "ord").alias("_one"))
    out = df.join(small(one), exact, "left").join(small(any_mode), key, "left")
    return out.select(*df.columns, *[F.coalesce(F.col("_one")[c], F.col("_any")[c]).alias(c) for c in columns])


def nearest_valid(df: DataFrame, valid: Column) -> DataFrame:
    """Adds before and after: the nearest valid sample of the same parity in the row, either way."""
    w = Window.partitionBy("image_id", "y", F.col("x") % 2).orderBy("x")
    v = F.when(valid, F.col("v"))
    return df.select(
        "*", F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first(v, True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after")
    )


def in_bands(df: DataFrame, bands: DataFrame) -> DataFrame:
    """Pixels in any band (start, size, vertical); each pixel once."""
    b = small(bands)
    within = F.when(F.col("vertical"), F.col("x")).otherwise(F.col("y"))
    return df.join(b, (within >= F.col("start")) & (within < F.col("start") + F.col("size")), "left_semi")


def without_overlap(ranges: DataFrame, cell: int = 4096) -> DataFrame:
    """Byte ranges (owner, id, lo, hi) that overlap no range of their owner with a smaller id.

    Ranges are filed under the cells they cover, so overlapping ones meet on a key.
    """
    each = ranges.withColumn("_c", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.greatest(F.col("hi") - 1, F.col("lo")) / cell))))
    other = each.select(F.col("owner").alias("_o"), F.col("id").alias("_i"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("_c").alias("_d"))
    hit = each.join(other, (F.col("owner") == F.col("_o")) & (F.col("_c") == F.col("_d")) & (F.col("_i") < F.col("id")) & (F.col("lo") < F.col("_hi")) & (F.col("_lo") < F.col("hi")), "left_semi")
    return ranges.join(hit.select("owner", "id").distinct(), ["owner", "id"], "left_anti")


def directories_with_tag(ifds: DataFrame, tags: DataFrame, tag: int) -> DataFrame:
    """Directories that have a tag (semi join)."""
    return ifds.join(tags.where(F.col("tag") == tag), ["image_id", "ifd_id"], "left_semi")


def first_tag(tags: DataFrame, tag: int) -> DataFrame:
    """(image_id, num, text): a tag's first entry in the order in which the tree is walked."""
    return tags.where(F.col("tag") == tag).groupBy("image_id").agg(F.min_by("num", "preorder").alias("num"), F.min_by("text", "preorder").alias("text"))


def first_of_each(tags: DataFrame) -> DataFrame:
    """One entry for each directory and tag: the first."""
    w = Window.partitionBy("image_id", "ifd_id", "tag").orderBy("preorder")
    return tags.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tree_paths(nodes: DataFrame, depth: int = 20) -> DataFrame:
    """(id, root, level, path) of a forest (id, parent), by joining down one level at a time."""
    level = nodes.where("parent IS NULL").select("id", F.col("id").alias("root"), F.lit(0).alias("level"), F.lpad(F.col("id").cast("string"), 10, "0").alias("path"))
    out = level
    for _ in range(depth):
        level = nodes.join(level.select(F.col("id").alias("parent"), "root", "level", "path"), "parent").select(
            "id", "root", (F.col("level") + 1).alias("level"), F.concat("path", F.lit("/"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("path")
        )
        out = out.unionByName(level)
    return out


def closest_ratio(width: Column, height: Column) -> Column:
    """Label of the closest of four aspect ratios; ties keep the earlier."""
    ratio = width / height.cast("double")
    known = [("16:9", 16 / 9), ("3:2", 3 / 2), ("4:3", 4 / 3), ("1:1", 1.0)]
    best = F.array_min(F.array(*[F.struct(F.abs(ratio - r).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, r) in enumerate(known)]))
    return best["n"]
