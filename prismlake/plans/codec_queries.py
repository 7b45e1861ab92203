"""Queries over encoded data: packed numbers, entropy codes, directories, files out and in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismlake.functions import binary
from prismlake.operators import stencil, tiles
from prismlake.sources import bitmaps, rasters, sinks, slices, tiff
from prismlake.sources.rasters import DEPTH, HEIGHT, MAX, WIDTH, table

from .edit import Edit, render
from .oracle import MOSAIC, PIXELS, hex_parts

Q: dict = {}
SQL: dict[str, str] = {}
C = F.col
KEY = ["image_id", "y", "x"]


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _packed(bits: int, little: bool) -> str:
    """`bits` bytes hold eight numbers."""
    order = (7, 5, 3, 1) if little else (1, 3, 5, 7)
    word = " || ".join(f"substr(f, {k}, 2)" for k in order)
    shift = f"(k * {bits}) % 8" if little else f"32 - {bits} - (k * {bits}) % 8"
    return f"WITH {hex_parts(bits)}, f AS (SELECT doc_id, n, p * 8 + k AS i, k, rpad(substr(h, 2 * (k * {bits} // 8) + 1, 8), 8, '0') AS f FROM d, generate_series(0, 7) g(k)) SELECT doc_id, i::INT AS i, ((('0x' || {word})::BIGINT >> ({shift})::INT) & {(1 << bits) - 1})::INT AS v FROM f WHERE i < n * 8 // {bits}"


for _bits, _name, _little in ((7, "dec01_unpack7", False), (8, "dec02_unpack8", False), (10, "dec03_unpack10", False), (12, "dec04_unpack12", False), (12, "dec04_unpack12_le", True), (14, "dec05_unpack14", False), (16, "dec05_unpack16", False)):

    @query(_name, _packed(_bits, _little))
    def _(spark, d, bits=_bits, little=_little):
        return binary.unpack_rows(rasters.byte_rows(spark, d, spread=True), "bytes", bits, None, little)


@query("dec19_key_xor", f"WITH {hex_parts(1)} SELECT doc_id, p::INT AS i, xor(('0x' || h)::INT, ((17 + 91 * (96 * (p + 1) + p * (p + 1) // 2)) & 255)::INT) AS v FROM d")
def _(spark, d):
    v = binary.unpack_rows(rasters.byte_rows(spark, d, spread=True), "bytes", 8)
    return v.withColumn("v", C("v").bitwiseXOR(binary.running_key(C("i"), 17, 91)))


_CB, _CR = "((x // 2 * 2 * 37 + y * 11) % 2000 - 1000)", "((x // 2 * 2 * 53 + y * 7) % 2000 - 1000)"


@query(
    "dec20_sraw_422",
    f"""WITH {MOSAIC}, c AS (SELECT *, CASE WHEN x % 2 = 0 THEN {_CB} END AS cb, CASE WHEN x % 2 = 0 THEN {_CR} END AS cr FROM mosaic),
    u AS (SELECT *, coalesce(cb, (lag(cb) OVER w + coalesce(lead(cb) OVER w, lag(cb) OVER w)) >> 1) AS b1, coalesce(cr, (lag(cr) OVER w + coalesce(lead(cr) OVER w, lag(cr) OVER w)) >> 1) AS r1 FROM c WINDOW w AS (PARTITION BY image_id, y ORDER BY x))
    SELECT image_id, y, x, {", ".join(f"(greatest(0, least({65535 << 8}, (v + ((b1 * {a} + r1 * {b}) >> 12))::BIGINT * {g})) >> 8)::INT AS {n}" for n, (a, b), g in zip("rgb", binary.CHROMA, (300, 256, 280), strict=True))} FROM u""",
)
def _(spark, d):
    m = rasters.mosaic(spark, d)
    pair = F.expr("x div 2 * 2")
    m = m.withColumns({"cb": F.when(C("x") % 2 == 0, (pair * 37 + C("y") * 11) % 2000 - 1000), "cr": F.when(C("x") % 2 == 0, (pair * 53 + C("y") * 7) % 2000 - 1000)})
    return stencil.chroma_422(m, binary.CHROMA, (300, 256, 280))


def _full(c: str) -> str:
    """The rows' chroma l, r, a of `c`, then the four cases."""
    beside = f"((lag(l_{c}) OVER k + lead(l_{c}) OVER k) >> 1)"
    corner = f"lead(r_{c}) OVER k"
    return f"CASE WHEN y % 2 = 0 THEN a_{c} WHEN lead(l_{c}) OVER k IS NULL THEN lag(a_{c}) OVER k WHEN {corner} IS NULL THEN {beside} ELSE (lag(l_{c}) OVER k + lag(a_{c}) OVER k + {beside} + {corner}) >> 2 END"


@query(
    "dec20_sraw_420",
    f"""WITH {MOSAIC}, c AS (SELECT *, CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN {_CB} END AS cb, CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN {_CR} END AS cr FROM mosaic),
    s AS (SELECT *, {", ".join(f"coalesce({c}, lag({c}) OVER w) AS l_{c}, CASE WHEN x % 2 = 1 THEN lead({c}) OVER w END AS r_{c}" for c in ("cb", "cr"))} FROM c WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
    t AS (SELECT *, {", ".join(f"CASE WHEN r_{c} IS NULL THEN l_{c} ELSE (l_{c} + r_{c}) >> 1 END AS a_{c}" for c in ("cb", "cr"))} FROM s),
    u AS (SELECT *, {_full("cb")} AS b1, {_full("cr")} AS r1 FROM t WINDOW k AS (PARTITION BY image_id, x ORDER BY y))
    SELECT image_id, y, x, {", ".join(f"(greatest(0, least({65535 << 8}, (v + ((b1 * {a} + r1 * {b}) >> 12))::BIGINT * {g})) >> 8)::INT AS {n}" for n, (a, b), g in zip("rgb", binary.CHROMA, (300, 256, 280), strict=True))} FROM u""",
)
def _(spark, d):
    m, site = rasters.mosaic(spark, d), (C("x") % 2 == 0) & (C("y") % 2 == 0)
    pair = F.expr("x div 2 * 2")
    m = m.withColumns({"cb": F.when(site, (pair * 37 + C("y") * 11) % 2000 - 1000), "cr": F.when(site, (pair * 53 + C("y") * 7) % 2000 - 1000)})
    return stencil.chroma_420(m, binary.CHROMA, (300, 256, 280))


@query("dec22_split_rows", f"WITH v AS ({_packed(12, False)}), n AS (SELECT doc_id, i, v, count(*) OVER (PARTITION BY doc_id) // 128 AS half FROM v) SELECT doc_id, CASE WHEN i // 64 < half THEN 2 * (i // 64) ELSE 2 * (i // 64 - half) + 1 END::INT AS y, (i % 64)::INT AS x, v FROM n WHERE i < half * 128")
def _(spark, d):
    """Texts as 12-bit samples in rows of 64 whose even rows come before the odd ones; a row without its pair is left out."""
    b = rasters.byte_rows(spark, d, spread=True).withColumn("half", F.floor(F.length("bytes").cast("long") * 8 / 12 / 128).cast("int"))
    v = binary.unpack_rows(b, "bytes", 12, C("half") * 128)
    return v.select("doc_id", binary.split_row(F.expr("i div 64").cast("int"), C("half")).alias("y"), (C("i") % 64).alias("x"), "v")


@query("dec24_tiles", "WITH i AS (SELECT p_partkey AS image_id, p_size * 10 AS height, p_size * 15 AS width FROM part), y AS (SELECT *, unnest(generate_series(0, height - 1, 64)) AS off_y FROM i), x AS (SELECT *, unnest(generate_series(0, width - 1, 100)) AS off_x FROM y) SELECT image_id, (off_y // 64 * ceil(width / 100.0::DOUBLE) + off_x // 100)::INT AS slice, off_y::INT AS off_y, off_x::INT AS off_x, least(64, height - off_y)::INT AS h, least(100, width - off_x)::INT AS w FROM x")
def _(spark, d):
    i = table(spark, d, "part").select(C("p_partkey").alias("image_id"), (C("p_size") * 10).alias("height"), (C("p_size") * 15).alias("width"))
    return slices.tile_rows(i, 64, 100)


def _round_trip(codec: str, shift: int, options: dict | None = None):
    def f(spark, d):
        m = rasters.mosaic(spark, d).withColumn("v", F.shiftright("v", shift))
        return slices.decode(slices.encode(m, 25, codec, options)).where("error IS NULL").select(*KEY, "v")

    return f


for _codec, _shift, _options, _names in (
    ("packed", 4, {"bits": 12, "order": "msb32"}, ["dec06_msb32"]), ("packed", 4, {"bits": 12, "order": "msb16"}, ["dec06_msb16"]), ("packed", 4, {"bits": 12, "order": "lsb"}, ["dec06_lsb"]),
    ("lossless_jpeg", 0, {"components": 2}, ["dec10_lossless_jpeg"]), ("two_lane", 0, None, ["dec12_two_lane"]), ("two_lane", 2, {"order": "msb32"}, ["dec13_two_lane_msb32"]),
    ("adaptive", 4, None, ["dec15_adaptive"]), ("column_sum", 4, None, ["dec16_column_sum"]), ("packbits", 13, None, ["dec23_packbits"]),
):
    for _n in _names:
        query(_n, f"WITH {MOSAIC} SELECT image_id, y, x, v >> {_shift} AS v FROM mosaic")(_round_trip(_codec, _shift, _options))


@query("dec25_slice_errors", f"WITH {MOSAIC} SELECT image_id, 1::BIGINT AS errors, 4::BIGINT AS slices, false AS too_many FROM mosaic GROUP BY 1")
def _(spark, d):
    s = slices.encode(rasters.mosaic(spark, d), 25, "lossless_jpeg")
    broken = s.withColumn("data", F.when(C("slice") == 2, F.substring("data", 3, 1 << 30)).otherwise(C("data")))
    return slices.too_many_errors(slices.decode(broken))


@query("dec17_blocks16")
def _(spark, d):
    b = rasters.byte_rows(spark, d, spread=True)
    s = b.select(C("doc_id").alias("image_id"), F.lit(0).alias("slice"), F.lit(0).alias("off_y"), F.lit(0).alias("off_x"), F.ceil(F.length("bytes") / 64).cast("int").alias("h"), F.lit(64).alias("w"), F.lit("blocks16").alias("codec"), F.lit("{}").alias("options"), C("bytes").alias("data"))
    return slices.decode(s).select(*KEY, "v")


@query("dec14_blocks14")
def _(spark, d):
    """14 samples take 16 bytes, so each block of 16 KB that is begun holds 512 rows of 28."""
    b = rasters.byte_rows(spark, d, spread=True)
    s = b.select(C("doc_id").alias("image_id"), F.lit(0).alias("slice"), F.lit(0).alias("off_y"), F.lit(0).alias("off_x"), (F.ceil(F.length("bytes") / 0x4000) * 512).cast("int").alias("h"), F.lit(28).alias("w"), F.lit("blocks14").alias("codec"), F.lit("{}").alias("options"), C("bytes").alias("data"))
    return slices.decode(s).select(*KEY, "v")


def _files(spark, d):
    """A 16-bit TIFF of each image, as (path, content)."""
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1, 3), np.uint16)
        v[rows["y"], rows["x"]] = rows[["r", "g", "b"]]
        k = int(rows["image_id"].iloc[0])
        return pd.DataFrame({"path": [f"image-{k}.tif"], "image_id": [k], "content": [sinks.tiff(v, k % 2 == 0)]})

    return rasters.pixels(spark, d).groupBy("image_id").applyInPandas(run, "path string, image_id long, content binary")


@query("src06_tiff_tags", f"WITH {MOSAIC}, i AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM mosaic GROUP BY 1) SELECT 'image-' || image_id || '.tif' AS path, t.tag, t.value FROM i, LATERAL (VALUES (256, w), (257, h), (258, 16), (259, 1), (262, 2), (273, 122), (277, 3), (278, h), (279, w * h * 6)) t(tag, value)")
def _(spark, d):
    return tiff.read_tags(_files(spark, d)).select("path", "tag", C("nums")[0].cast("int").alias("value"))


@query("src12_tiff_pixels", f"WITH {PIXELS} SELECT 'image-' || image_id || '.tif' AS path, y, x, r, g, b FROM pixels")
def _(spark, d):
    files = _files(spark, d)
    s = tiff.strips(files, tiff.read_tags(files))
    v = slices.decode(s).where("error IS NULL").join(s.select("image_id", "path").distinct(), "image_id")
    v = v.select("path", "y", F.expr("cast(x div 3 as int)").alias("x"), (C("x") % 3).alias("c"), "v")
    return v.groupBy("path", "y", "x").agg(*[F.max(F.when(C("c") == k, C("v"))).alias(n) for k, n in enumerate("rgb")])


@query("snk01_png_sizes")
def _(spark, d):
    out = sinks.files(rasters.pixels(spark, d), "png", DEPTH)
    return out.select("image_id", F.length("content").alias("length"), F.hex(F.substring("content", 1, 8)).alias("head"))


@query("snk01_bmp_bytes", f"WITH {MOSAIC} SELECT image_id, '424D' AS head, (54 + (max(x) * 3 + 6) // 4 * 4 * (max(y) + 1))::INT AS length FROM mosaic GROUP BY 1")
def _(spark, d):
    out = sinks.files(rasters.pixels(spark, d), "bmp", DEPTH)
    return out.select("image_id", F.hex(F.substring("content", 1, 2)).alias("head"), F.length("content").alias("length"))


@query("plan_edit_render")
def _(spark, d):
    edit = Edit(exposure=0.3, contrast=10, shadow=5, saturation=1.2, gains=(1.1, 1.0, 0.9), rotation=1, denoise=3, sharpen=2, shadow_tint=(5, 0, 10))
    return render(rasters.pixels(spark, d), edit, DEPTH, HEIGHT, WIDTH)


@query("plan_neutral_edit", f"WITH {PIXELS} SELECT image_id, y, x, least(255, r >> 8) AS r, least(255, g >> 8) AS g, least(255, b >> 8) AS b FROM pixels")
def _(spark, d):
    return render(rasters.pixels(spark, d), Edit(), DEPTH, HEIGHT, WIDTH)


def _tile_sql(name: str) -> str:
    from .raster_queries import SQL as raster

    return raster[name]


@query("tile_win01_sharpen", _tile_sql("win01_sharpen"))
def _(spark, d):
    return tiles.apply(rasters.pixels(spark, d), tiles.sharpen(5), ["r", "g", "b"], HEIGHT, WIDTH, 1)


@query("tile_win02_denoise", _tile_sql("win02_denoise"))
def _(spark, d):
    return tiles.apply(rasters.pixels(spark, d), tiles.smooth(5), ["r", "g", "b"], HEIGHT, WIDTH, 1)


@query("win09_nl_means")
def _(spark, d):
    return tiles.apply(rasters.pixels(spark, d), tiles.nl_means(1, 2, 3000.0), ["r", "g", "b"], HEIGHT, WIDTH, 3)


@query("win03_dispatch", f"WITH {MOSAIC} SELECT a.algorithm, image_id, y, x, v FROM mosaic, (VALUES ('fast'), ('directional'), ('bilinear'), ('linear5')) a(algorithm)")
def _(spark, d):
    """Every algorithm's value of the colour that a site has itself: the site's own sample."""
    site, out = (C("y") % 2) * 2 + C("x") % 2, None
    for name in ("fast", "directional", "bilinear", "linear5"):
        p = stencil.demosaic(rasters.mosaic(spark, d), "RGGB", name, HEIGHT, WIDTH)
        own = F.when(site == 0, C("r")).when(site == 3, C("b")).otherwise(C("g"))
        one = p.select(F.lit(name).alias("algorithm"), *KEY, own.cast("int").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src13_bitmap_pixels", f"WITH {PIXELS} SELECT f.form, image_id, y, x, least(255, r >> {DEPTH - 8}) AS r, least(255, g >> {DEPTH - 8}) AS g, least(255, b >> {DEPTH - 8}) AS b FROM pixels, (VALUES ('png'), ('bmp')) f(form)")
def _(spark, d):
    """Images as PNG and BMP files, read again."""
    out = None
    for form in ("png", "bmp"):
        files = sinks.files(rasters.pixels(spark, d), form, DEPTH).withColumn("path", C("image_id").cast("string"))
        one = bitmaps.pixels(files).where("error IS NULL").select(F.lit(form).alias("form"), C("path").cast("long").alias("image_id"), "y", "x", "r", "g", "b")
        out = one if out is None else out.unionByName(one)
    return out


@query("win14_rows_from_differences", f"WITH {MOSAIC} SELECT image_id, y, x, v FROM mosaic")
def _(spark, d):
    """Differences to the sample two to the left, summed back by a window."""
    w = Window.partitionBy("image_id", "y", C("x") % 2).orderBy("x")
    diff = rasters.mosaic(spark, d).select(*KEY, (C("v") - F.coalesce(F.lag("v").over(w), F.lit(0))).alias("d"))
    return diff.select(*KEY, F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("v"))
