"""Neighbourhood operators: sharpening, smoothing, demosaicing, repair.

A neighbourhood is read by two window passes, along rows and along columns, so an
operator costs two shuffles whatever its radius.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .geometry import cfa_color


def along_row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def _shift(c: Column, k: int, w) -> Column:
    return c if k == 0 else (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w)


def neighbourhood(df: DataFrame, columns: list[str], radius: int) -> DataFrame:
    """Adds _c: for each column an array of rows of neighbours, null outside the image."""
    steps = range(-radius, radius + 1)
    df = df.select("*", *[F.array(*[_shift(F.col(c), k, along_row()) for k in steps]).alias(f"_{c}") for c in columns])
    rows = {f"_{c}": F.array(*[_shift(F.col(f"_{c}"), k, along_column()) for k in steps]) for c in columns}
    return df.select(*[c for c in df.columns if c not in rows], *[e.alias(n) for n, e in rows.items()])


def reader(column: str, radius: int, mirror: bool = False) -> Callable[[int, int], Column]:
    """at(dy, dx) of a neighbourhood; mirrored reads reflect at the image's edges."""

    def one(dy: int, dx: int) -> Column:
        return F.col(f"_{column}")[dy + radius][dx + radius]

    def at(dy: int, dx: int) -> Column:
        return F.coalesce(one(dy, dx), one(-dy, dx), one(dy, -dx), one(-dy, -dx), F.lit(0)) if mirror else one(dy, dx)

    return at


def _div(a: Column, b) -> Column:
    """Division that cuts towards zero."""
    return (a.cast("double") / b).cast("long")


def _nine(df: DataFrame, channels: list[str]) -> DataFrame:
    """Adds <c>9, the 3 x 3 sum, and edge, whether the pixel is on the border."""
    near = [-1, 1]
    df = df.select("*", *[F.sum(c).over(along_row().rowsBetween(*near)).alias(f"_{c}3") for c in channels], F.count("*").over(along_row().rowsBetween(*near)).alias("_n"))
    w = along_column().rowsBetween(*near)
    return df.select("*", *[F.sum(f"_{c}3").over(w).alias(f"{c}9") for c in channels], ((F.col("_n") < 3) | (F.count("*").over(w) < 3)).alias("edge"))


def sharpen(df: DataFrame, strength: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Centre weighted up against its eight neighbours, 1 to 10; borders stay. 0 adds no step."""
    if strength == 0:
        return df
    if not 1 <= strength <= 10:
        raise ValueError("strength is 1 to 10")
    f = 11 - strength
    m = 8 + f
    out = {c: F.when(F.col("edge"), F.col(c)).otherwise(_div((F.lit(m + 1) * F.col(c)) - F.col(f"{c}9"), f)).cast("int") for c in channels}
    return _nine(df, list(channels)).select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def smooth(df: DataFrame, strength: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Weighted mean of a pixel and its eight neighbours, 1 to 10; borders stay. 0 adds no step."""
    if strength == 0:
        return df
    if not 1 <= strength <= 10:
        raise ValueError("strength is 1 to 10")
    m = 11 - strength
    out = {c: F.when(F.col("edge"), F.col(c)).otherwise(_div((F.lit(m - 1) * F.col(c)) + F.col(f"{c}9"), 8 + m)).cast("int") for c in channels}
    return _nine(df, list(channels)).select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def _sites(pattern: str) -> tuple[int, int]:
    """Row and column parity of the red site of a 2 x 2 pattern."""
    at = pattern.index("R")
    return at // 2, at % 2


def _by_site(pattern: str, red: Column, blue: Column, green_red_row: Column, green_blue_row: Column) -> Column:
    ry, rx = _sites(pattern)
    y, x = F.col("y") % 2, F.col("x") % 2
    return F.when((y == ry) & (x == rx), red).when((y != ry) & (x != rx), blue).when(y == ry, green_red_row).otherwise(green_blue_row)


def demosaic_fast(df: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """Missing colours as means of the nearest samples, mirrored at the borders."""
    df = neighbourhood(df, ["v"], 1)
    at = reader("v", 1, True)
    v = F.col("v")
    cross = _div(at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1), 4)
    corners = _div(at(-1, 1) + at(-1, -1) + at(1, 1) + at(1, -1), 4)
    across, along = _div(at(0, 1) + at(0, -1), 2), _div(at(-1, 0) + at(1, 0), 2)
    return df.select(
        "image_id", "y", "x", _by_site(pattern, v, corners, across, along).cast("int").alias("r"),
        _by_site(pattern, cross, cross, v, v).cast("int").alias("g"), _by_site(pattern, corners, v, along, across).cast("int").alias("b"),
    )


def demosaic_bilinear(df: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """Missing colours as means of the samples that are there."""
    return demosaic_pattern(df, pattern, 2)


def demosaic_pattern(df: DataFrame, pattern: str, size: int) -> DataFrame:
    """For any repeating pattern: means of the 3 x 3 neighbours of a colour, with the site's own sample kept."""
    color = cfa_color(pattern, F.col("y"), F.col("x"), size)
    df = neighbourhood(df.withColumn("color", color).withColumn("c", F.struct("v", "color")).drop("v"), ["c"], 1)
    cells = [F.col("_c")[j][i] for j in range(3) for i in range(3)]

    def mean(k: int) -> Column:
        total = sum((F.when(c["color"] == k, c["v"]).otherwise(0) for c in cells[1:]), F.when(cells[0]["color"] == k, cells[0]["v"]).otherwise(0))
        count = sum((F.when(c["color"] == k, 1).otherwise(0) for c in cells[1:]), F.when(cells[0]["color"] == k, 1).otherwise(0))
        return F.when(F.col("color") == k, F.col("c")["v"]).otherwise(F.when(count > 0, _div(total, F.greatest(count, F.lit(1)))).otherwise(0)).cast("int")

    return df.select("image_id", "y", "x", mean(0).alias("r"), mean(1).alias("g"), mean(2).alias("b"))


def demosaic_spread(df: DataFrame, pattern: str, size: int) -> DataFrame:
    """Every sample goes to its eight neighbours of other colours; of several of a colour the last in reading order stays.

    A site keeps its own sample; a colour that no neighbour has is 0 there.
    """
    color = cfa_color(pattern, F.col("y"), F.col("x"), size)
    df = neighbourhood(df.withColumn("c", F.struct("v", color.alias("color"))).drop("v"), ["c"], 1)
    around = [F.col("_c")[j][i] for j in (2, 1, 0) for i in (2, 1, 0) if (j, i) != (1, 1)]
    last = lambda k: F.coalesce(*[F.when(c["color"] == k, c["v"]) for c in [F.col("c"), *around]], F.lit(0)).cast("int")
    return df.select("image_id", "y", "x", last(0).alias("r"), last(1).alias("g"), last(2).alias("b"))


def demosaic_directional(df: DataFrame, pattern: str, height: int, width: int, threshold: float = 2.0, differences: bool = True) -> DataFrame:
    """Green along the direction of the smaller gradient, red and blue by colour differences, or else by plain means of their samples.

    Green in the outer ring of three is the mean of its four neighbours, mirrored.
    """
    df = neighbourhood(df, ["v"], 2)
    at, raw = reader("v", 2, True), reader("v", 2)
    v, y, x = F.col("v"), F.col("y"), F.col("x")
    bend_x, bend_y = (v * 2.0 - raw(0, 2) - raw(0, -2)), (v * 2.0 - raw(2, 0) - raw(-2, 0))
    across, along = F.abs(raw(0, -1) - raw(0, 1)) + F.abs(bend_x), F.abs(raw(1, 0) - raw(-1, 0)) + F.abs(bend_y)
    even = (raw(-1, 0) + raw(1, 0) + raw(0, -1) + raw(0, 1)) / 4.0 + (bend_x + bend_y) / 8.0
    value = F.when(F.abs(along - across) < threshold, even).when(across < along, (raw(0, -1) + raw(0, 1)) / 2.0 + bend_x / 4.0).otherwise((raw(1, 0) + raw(-1, 0)) / 2.0 + bend_y / 4.0)
    inside = y.between(3, height - 4) & x.between(3, width - 4)
    ring = _div(at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1), 4)
    missing = F.when(inside, F.greatest(value, F.lit(0.0)).cast("int").bitwiseAND(65535)).otherwise(ring).cast("int")
    green = _by_site(pattern, missing, missing, v, v).cast("int").alias("g")
    if not differences:
        sides, ends, corners = _div(at(0, 1) + at(0, -1), 2), _div(at(-1, 0) + at(1, 0), 2), _div(at(-1, 1) + at(-1, -1) + at(1, 1) + at(1, -1), 4)
        red, blue = _by_site(pattern, v, corners, sides, ends), _by_site(pattern, corners, v, ends, sides)
        return df.select("image_id", "y", "x", red.cast("int").alias("r"), green, blue.cast("int").alias("b"))
    df = df.select("image_id", "y", "x", "v", green)
    df = neighbourhood(df.withColumn("d", v - F.col("g")), ["d"], 1)
    d = reader("d", 1, True)
    cut = lambda e, n: (e.cast("double") / n).cast("int")
    sides, ends, corners = cut(d(0, 1) + d(0, -1), 2), cut(d(-1, 0) + d(1, 0), 2), cut(d(-1, 1) + d(-1, -1) + d(1, 1) + d(1, -1), 4)
    whole = lambda e: F.greatest(e + F.col("g"), F.lit(0)).cast("int")
    return df.select("image_id", "y", "x", _by_site(pattern, v, whole(corners), whole(sides), whole(ends)).alias("r"), "g", _by_site(pattern, whole(corners), v, whole(ends), whole(sides)).alias("b"))


def demosaic_linear5(df: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """Linear 5 x 5 interpolation with gradient correction; absent neighbours have no weight."""
    df = neighbourhood(df, ["v"], 2)
    read, v = reader("v", 2), F.col("v")
    value = lambda *p: sum((F.coalesce(read(*q), F.lit(0)) for q in p[1:]), F.coalesce(read(*p[0]), F.lit(0)))
    there = lambda *p: sum((F.when(read(*q).isNull(), 0).otherwise(1) for q in p[1:]), F.when(read(*p[0]).isNull(), 0).otherwise(1))
    north, west, far_y, far_x = [(-1, 0), (1, 0)], [(0, -1), (0, 1)], [(-2, 0), (2, 0)], [(0, -2), (0, 2)]
    corners = [(-1, -1), (-1, 1), (1, -1), (1, 1)]
    keep = lambda e, n: F.when(n > 0, _div(e, F.greatest(n, F.lit(1)))).otherwise(0).bitwiseAND(65535).cast("int")
    bend = there(*far_x, *far_y) * v - value(*far_x, *far_y)
    cross = keep(value(*north, *west) * 2 + bend, there(*north, *west) * 2)
    other = keep(value(*corners) * 4 + bend * 3, there(*corners) * 4)

    def line(pair: list, far: list, off: list) -> Column:
        """A colour whose samples lie in `pair`, corrected along `far` and against `off`."""
        e = value(*pair) * 8 + (there(*corners, *far) * 2 - there(*off)) * v - value(*corners, *far) * 2 + value(*off)
        return keep(e, there(*pair) * 8)

    across, along = line(west, far_x, far_y), line(north, far_y, far_x)
    return df.select("image_id", "y", "x", _by_site(pattern, v, other, across, along).alias("r"), _by_site(pattern, cross, cross, v, v).alias("g"), _by_site(pattern, other, v, along, across).alias("b"))


def repair(df: DataFrame, bad: Column, step: int = 2) -> DataFrame:
    """Bad samples from the nearest good ones of their phase left, right, above and below.

    Weights fall with the distance in 256ths; a side without a good sample has none.
    The nearest good one is the last before and the first after, not null.
    """
    df = df.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    good = F.when(~F.col("_bad"), F.struct("v", "y", "x"))
    row = Window.partitionBy("image_id", "y", F.col("x") % step).orderBy("x")
    col = Window.partitionBy("image_id", "x", F.col("y") % step).orderBy("y")
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    df = df.withColumn("_good", good)
    df = df.withColumns({"_w": F.last("_good", True).over(row.rowsBetween(*before)), "_e": F.first("_good", True).over(row.rowsBetween(*after))})
    df = df.withColumns({"_n": F.last("_good", True).over(col.rowsBetween(*before)), "_s": F.first("_good", True).over(col.rowsBetween(*after))})

    def pair(a: str, b: str, axis: str) -> tuple[Column, Column]:
        """Weighted sum of two sides, and whether there is any."""
        da = F.coalesce(F.col(axis) - F.col(a)[axis], F.lit(0))
        db = F.coalesce(F.col(b)[axis] - F.col(axis), F.lit(0))
        total = da + db
        wa = F.when(da > 0, F.floor((total - da) * 256 / F.greatest(total, F.lit(1)))).otherwise(0)
        s = F.coalesce(F.col(a)["v"] * wa, F.lit(0)) + F.coalesce(F.col(b)["v"] * (F.lit(256) - wa), F.lit(0))
        return F.when(total > 0, s).otherwise(0), F.when(total > 0, 1).otherwise(0)

    (sx, nx), (sy, ny) = pair("_w", "_e", "x"), pair("_n", "_s", "y")
    fixed = F.least(F.floor((sx + sy) / F.pow(F.lit(2.0), F.lit(7) + nx + ny)), F.lit(65535))
    return df.select("image_id", "y", "x", F.when(F.col("_bad"), fixed).otherwise(F.col("v")).cast("int").alias("v"))


def expand_border(df: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """Samples outside a window take the value of the nearest one inside."""
    inside = F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1)
    edge = df.where(inside).select(F.col("image_id").alias("_i"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("_v"))
    y, x = F.greatest(F.lit(top), F.least(F.lit(top + height - 1), F.col("y"))), F.greatest(F.lit(left), F.least(F.lit(left + width - 1), F.col("x")))
    to = df.withColumns({"_ty": y, "_tx": x})
    return to.join(edge, (F.col("image_id") == F.col("_i")) & (F.col("_ty") == F.col("_y")) & (F.col("_tx") == F.col("_x"))).select("image_id", "y", "x", F.col("_v").alias("v"))


def demosaic(df: DataFrame, pattern: str, algorithm: str, height: int, width: int) -> DataFrame:
    """Dispatch: patterns other than 2 x 2 by masked means, the others by name."""
    size = int(len(pattern) ** 0.5)
    if size != 2 or algorithm == "bilinear":
        return demosaic_pattern(df, pattern, size)
    if algorithm == "directional":
        return demosaic_directional(df, pattern, height, width)
    return {"fast": demosaic_fast, "linear5": demosaic_linear5}[algorithm](df, pattern)


def chroma_420(df: DataFrame, matrix: tuple, gains: tuple) -> DataFrame:
    """Luma v at every pixel and chroma cb, cr at even columns of even rows, to red, green and blue.

    Chroma between two sites is their mean. Between four it is the mean of the one above
    to the left, the two means beside it and the one below to the right. The last column takes
    that of its left, the last row that of the row above.
    """
    from prismlake.functions.binary import chroma_to_rgb

    w, down, odd_x, odd_y = along_row(), along_column(), F.col("x") % 2 == 1, F.col("y") % 2 == 1
    for c in ("cb", "cr"):
        left = F.coalesce(F.col(c), F.lag(c).over(w))
        right = F.when(odd_x, F.lead(c).over(w))
        df = df.withColumns({"_l": left, "_r": right}).withColumn("_a", F.when(F.col("_r").isNull(), F.col("_l")).otherwise(F.shiftright(F.col("_l") + F.col("_r"), 1)))
        below, above = F.lead("_l").over(down), F.lag("_l").over(down)
        beside, across, corner = F.shiftright(above + below, 1), F.lag("_a").over(down), F.lead("_r").over(down)
        four = F.shiftright(above + across + beside + corner, 2)
        df = df.withColumn(f"_{c}", F.when(~odd_y, F.col("_a")).when(below.isNull(), across).when(corner.isNull(), beside).otherwise(four)).drop("_l", "_r", "_a")
    rgb = chroma_to_rgb(F.col("v").cast("long"), F.col("_cb").cast("long"), F.col("_cr").cast("long"), matrix, gains)
    return df.select("image_id", "y", "x", *[c.alias(n) for n, c in zip("rgb", rgb, strict=True)])


def chroma_422(df: DataFrame, matrix: tuple, gains: tuple) -> DataFrame:
    """Luma v at every pixel and chroma cb, cr at even columns, to red, green and blue.

    Odd columns take the mean of the chroma on both sides, the last one that of its
    left.
    """
    from prismlake.functions.binary import chroma_to_rgb

    w = along_row()

    def full(c: str) -> Column:
        left = F.lag(c).over(w)
        return F.coalesce(F.col(c), F.shiftright(left + F.coalesce(F.lead(c).over(w), left), 1))

    df = df.withColumns({"_cb": full("cb"), "_cr": full("cr")})
    rgb = chroma_to_rgb(F.col("v").cast("long"), F.col("_cb").cast("long"), F.col("_cr").cast("long"), matrix, gains)
    return df.select("image_id", "y", "x", *[c.alias(n) for n, c in zip("rgb", rgb, strict=True)])
