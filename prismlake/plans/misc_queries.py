"""Further queries: scalar mathematics, arrays, small filters, raw files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismlake.codec.trees import TREES
from prismlake.functions import binary, color, metadata, tone
from prismlake.operators import dither, geometry, stats, stencil
from prismlake.sources import rasters, raw, slices, tiff, vendors
from prismlake.sources.rasters import HEIGHT, MAX, WIDTH, table

from .codec_queries import _files
from .oracle import MOSAIC, PIXELS, TAGS, at, grid, hex_parts

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


def _curve_rows(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")


@query("mth01_spline", "WITH k AS (SELECT 3 * ((200.0::DOUBLE - 140.0::DOUBLE) / 128 - (140.0::DOUBLE - 10.0::DOUBLE) / 127) / 255 AS kk) SELECT i::INT AS i, round(CASE WHEN i <= 127 THEN kk * pow(i, 3) / (6 * 127) + 10.0::DOUBLE * (127 - i) / 127 + (140.0::DOUBLE / 127 - kk * 127 / 6) * i ELSE kk * pow(255 - i, 3) / (6 * 128) + 200.0::DOUBLE * (i - 127) / 128 + (140.0::DOUBLE / 128 - kk * 128 / 6) * (255 - i) END, 6) AS v FROM k, generate_series(0, 255) g(i)")
def _(spark, d):
    import numpy as np

    at_ = np.arange(256, dtype=float)
    return _curve_rows(spark, tone.spline3((0, 127, 255), (10.0, 140.0, 200.0), at_)).select("i", F.round("v", 6).alias("v"))


@query("mth02_cubic_fit", "SELECT i::INT AS i, round([3.0, -2.0, 0.5, 0.25][(i + 1)::INT]::DOUBLE, 6) AS v FROM generate_series(0, 3) g(i)")
def _(spark, d):
    xs = list(range(12))
    return _curve_rows(spark, tone.cubic_fit(xs, [3 - 2 * x + 0.5 * x * x + 0.25 * x**3 for x in xs])).select("i", (F.round("v", 6) + 0.0).alias("v"))


#: The knee by bisection, as the function finds it; then the curve at all 256 values.
_GAMMA = """
WITH RECURSIVE b(k, low, high, knee) AS (
  SELECT 0, 1e-12::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN gap > 0 THEN mid ELSE low END, CASE WHEN gap > 0 THEN high ELSE mid END, mid FROM (
    SELECT k, low, high, mid, 4.5 * pow(mid, 0.55) / 0.45 * pow(mid, 0.45) - (4.5 * pow(mid, 0.55) / 0.45 - 1) - 4.5 * mid AS gap
    FROM (SELECT *, (low + high) / 2 AS mid FROM b WHERE k < 48))),
knee AS (SELECT knee, 4.5 * pow(knee, 0.55) / 0.45 - 1 AS a FROM b WHERE k = 48)
SELECT i::INT AS i, trunc(greatest(0, least(1, CASE WHEN i / 255.0::DOUBLE < knee THEN 4.5 * i / 255.0::DOUBLE ELSE (1 + a) * pow(i / 255.0::DOUBLE, 0.45) - a END)) * 255)::BIGINT AS v
FROM generate_series(0, 255) g(i), knee
"""


@query("mth03_gamma_table", _GAMMA)
def _(spark, d):
    return _curve_rows(spark, tone.gamma_table(0.45, 4.5, 8)).select("i", C("v").cast("long").alias("v"))


@query("mth04_exposure", "SELECT event_id, pow(2.0::DOUBLE, event_id % 7 - 3) AS gain, (event_id % 7 - 3)::DOUBLE AS ev FROM events")
def _(spark, d):
    gain = F.pow(F.lit(2.0), C("event_id") % 7 - 3)
    return table(spark, d, "events").select("event_id", gain.alias("gain"), F.log2(gain).alias("ev"))


@query("mth05_curve_gamma", "WITH n AS (SELECT i, i / 255.0::DOUBLE AS n FROM generate_series(0, 255) g(i)) SELECT i::INT AS i, round(least(1, CASE WHEN n <= 0.0031308 THEN n * 12.92::DOUBLE ELSE pow(1.055::DOUBLE * n, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END), 6) AS v FROM n")
def _(spark, d):
    return _curve_rows(spark, tone.tone_curve(8, reverse_gamma=True)).select("i", F.round("v", 6).alias("v"))


@query("mth06_abs", "SELECT event_id, abs(floor(value)::INT - 50) AS v, (event_id & (event_id - 1)) = 0 AS power FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.abs(F.floor("value").cast("int") - 50).alias("v"), (C("event_id").bitwiseAND(C("event_id") - 1) == 0).alias("power"))


_HALF = "(event_id * 257 % 65536)"


@query("mth08_half_float", f"WITH h AS (SELECT event_id, {_HALF} AS h FROM events), p AS (SELECT event_id, (h >> 10) & 31 AS e, h & 1023 AS m, CASE WHEN h >= 32768 THEN -1 ELSE 1 END AS s FROM h) SELECT event_id, CASE WHEN e = 31 THEN NULL WHEN e = 0 THEN s * m * pow(2.0::DOUBLE, -24) ELSE s * (1024 + m) * pow(2.0::DOUBLE, e - 25) END AS v FROM p")
def _(spark, d):
    h = (C("event_id") * 257 % 65536).cast("int")
    return table(spark, d, "events").select("event_id", metadata.small_float(h, 5, 10).alias("v"))


@query("prj05_unit_clip", f"WITH {PIXELS} SELECT image_id, y, x, greatest(0, least(1, (r - 30000) / 20000.0::DOUBLE)) AS v FROM pixels")
def _(spark, d):
    return rasters.pixels(spark, d).select(*KEY, color.clip((C("r") - 30000) / 20000.0, 1).alias("v"))


@query("prj18_dithered_lut")
def _(spark, d):
    m = rasters.mosaic(spark, d).withColumn("v", F.shiftright("v", 4))
    return dither.dithered(m, [min(65535, i * i // 256) for i in range(4096)])


@query("prj30_trim_bounds", f"WITH {MOSAIC} SELECT image_id, (y - 2)::INT AS y, (x - 4)::INT AS x, v FROM mosaic WHERE y BETWEEN 2 AND 97 AND x BETWEEN 4 AND 59")
def _(spark, d):
    return geometry.crop(rasters.mosaic(spark, d), 2, 4, 96, 56, HEIGHT, WIDTH)


@query("prj31_picker_inversion", f"WITH {PIXELS}, m AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM pixels) SELECT image_id, y, x, ({MAX} - top - low + r) AS r, ({MAX} - top - low + g) AS g, ({MAX} - top - low + b) AS b FROM m")
def _(spark, d):
    """Lightness turned upside down."""
    p = rasters.pixels(spark, d).select(*KEY, F.inline(F.array(color.rgb_to_hsl(C("r"), C("g"), C("b"), MAX))))
    p = p.select(*KEY, F.inline(F.array(color.hsl_to_rgb(C("h"), C("s"), F.lit(1.0) - C("l"), MAX))))
    return p.select(*KEY, *[F.round(c).cast("int").alias(c) for c in "rgb"])


@query("flt04_cfa_shift", "SELECT s_suppkey, ['RGGB', 'GRBG', 'GBRG', 'BGGR'][(s_suppkey % 4 + 1)::INT] AS pattern FROM supplier")
def _(spark, d):
    shifts = F.array(*[F.lit(geometry.shifted_pattern("RGGB", 2, k // 2, k % 2)) for k in range(4)])
    return table(spark, d, "supplier").select("s_suppkey", F.element_at(shifts, (C("s_suppkey") % 4 + 1).cast("int")).alias("pattern"))


@query("flt11_truncated_slices", "SELECT doc_id FROM documents WHERE doc_id * 37 % 3000 + 500 <= strlen(text)")
def _(spark, d):
    return table(spark, d, "documents").where(C("doc_id") * 37 % 3000 + 500 <= F.octet_length("text")).select("doc_id")


@query("flt12_size_equality", "SELECT doc_id, strlen(text) = length(text) AS one_byte FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.octet_length("text") == F.length("text")).alias("one_byte"))


@query("flt14_interior", f"WITH {MOSAIC} SELECT image_id, y, x, (y BETWEEN 1 AND {HEIGHT - 2} AND x BETWEEN 1 AND {WIDTH - 2}) AS inner1, (y BETWEEN 3 AND {HEIGHT - 4} AND x BETWEEN 3 AND {WIDTH - 4}) AS inner3 FROM mosaic")
def _(spark, d):
    inside = lambda n: C("y").between(n, HEIGHT - 1 - n) & C("x").between(n, WIDTH - 1 - n)
    return rasters.mosaic(spark, d).select(*KEY, inside(1).alias("inner1"), inside(3).alias("inner3"))


@query("flt15_bad_constant", f"WITH {MOSAIC} SELECT image_id, y, x FROM mosaic WHERE v = 32768")
def _(spark, d):
    return rasters.mosaic(spark, d).where("v = 32768").select(*KEY)


@query("flt16_exif_nonempty", f"WITH {TAGS} SELECT preorder, text FROM tags WHERE text IS NOT NULL AND text <> '' AND num > 20")
def _(spark, d):
    return rasters.tags(spark, d).where("text IS NOT NULL AND text <> '' AND num > 20").select("preorder", "text")


@query("jon09_neighbours", f"WITH {MOSAIC}, {grid('mosaic', ['v'], 1)} SELECT image_id, y, x, {at('v', -1, 0)} AS north, {at('v', 1, 0)} AS south, {at('v', 0, -1)} AS west, {at('v', 0, 1)} AS east, {at('v', -1, -1)} AS northwest FROM grid")
def _(spark, d):
    read = stencil.reader("v", 1)
    g = stencil.neighbourhood(rasters.mosaic(spark, d), ["v"], 1)
    return g.select(*KEY, read(-1, 0).alias("north"), read(1, 0).alias("south"), read(0, -1).alias("west"), read(0, 1).alias("east"), read(-1, -1).alias("northwest"))


@query("agg07_black_histogram", f"WITH {MOSAIC}, h AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) AS i, count(*) OVER (PARTITION BY image_id) AS n FROM mosaic WHERE x < 8) SELECT image_id, min(v) AS black FROM h WHERE i > n // 2 GROUP BY 1")
def _(spark, d):
    one = rasters.mosaic(spark, d).where("x < 8").withColumns({"y": F.lit(0), "x": F.lit(0)})
    return stats.phase_levels(one).select("image_id", "black")


@query("srt01_exif_order", f"WITH {TAGS} SELECT image_id, string_agg(DISTINCT text, ',' ORDER BY text) AS groups FROM tags GROUP BY 1")
def _(spark, d):
    return rasters.tags(spark, d).groupBy("image_id").agg(F.array_join(F.sort_array(F.collect_set("text")), ",").alias("groups"))


@query("srt05_first_record", f"WITH {TAGS} SELECT image_id, arg_min(num, preorder) AS num FROM tags GROUP BY 1")
def _(spark, d):
    return rasters.tags(spark, d).groupBy("image_id").agg(F.min_by("num", "preorder").alias("num"))


@query("set04_rectangle_overlap", f"WITH {PIXELS} SELECT image_id, y, x, (r % 50 < 60 AND r % 50 + 20 > 40 AND g % 50 < 55 AND g % 50 + 20 > 30) AS meets FROM pixels")
def _(spark, d):
    a = {"x": C("r") % 50, "y": C("g") % 50, "w": F.lit(20), "h": F.lit(20)}
    b = {"x": F.lit(40), "y": F.lit(30), "w": F.lit(20), "h": F.lit(25)}
    _, _, w, h = geometry.intersection(a, b)
    return rasters.pixels(spark, d).select(*KEY, ((w > 0) & (h > 0)).alias("meets"))


@query("str03_model_match", "SELECT p_partkey, contains(p_type, 'STEEL') AS steel, starts_with(p_type, 'PROMO') AS promo FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", C("p_type").contains("STEEL").alias("steel"), C("p_type").startswith("PROMO").alias("promo"))


@query("str04_strip_maker", "SELECT s_suppkey, CASE WHEN starts_with(s_name, 'Supplier#') THEN substr(s_name, 10) ELSE s_name END AS model FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", metadata.without_prefix(C("s_name"), "Supplier#").alias("model"))


@query("arr01_typed_arrays", "SELECT vec_id, floor(embedding[1]::DOUBLE * 1000)::INT AS a, floor(embedding[64]::DOUBLE * 1000)::INT AS b, len(embedding) AS n FROM embeddings")
def _(spark, d):
    whole = F.transform("embedding", lambda e: F.floor(e.cast("double") * 1000).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", whole[0].alias("a"), F.element_at(whole, -1).alias("b"), F.size("embedding").cast("long").alias("n"))


@query("arr02_elements", "SELECT event_id, [event_id, user_id, event_id + user_id][(event_id % 3 + 1)::INT] AS v, [event_id, user_id][(event_id % 3 + 1)::INT] AS maybe FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    k = (C("event_id") % 3 + 1).cast("int")
    return e.select("event_id", F.element_at(F.array("event_id", "user_id", C("event_id") + C("user_id")), k).alias("v"), F.try_element_at(F.array("event_id", "user_id"), k).alias("maybe"))


@query("arr06_byte_swap", f"WITH {hex_parts(4)} SELECT doc_id, p::INT AS i, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS swapped FROM d")
def _(spark, d):
    """Each four bytes of a text the other way round, the last filled up with zeros."""
    words = F.transform(binary.parts(C("bytes"), 4), lambda b: F.lpad(F.hex(metadata.unsigned(b, 0, 4, True)), 8, "0"))
    return rasters.byte_rows(spark, d).select("doc_id", F.posexplode(words).alias("i", "swapped"))


@query("map04_overrides", "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 10 WHEN contains(p_type, 'TIN') THEN 20 ELSE p_size END AS margin FROM part")
def _(spark, d):
    """Overrides as a table of predicates, the first that holds counts."""
    rules = [(C("p_brand").startswith("Brand#1"), 10), (C("p_type").contains("TIN"), 20)]
    out = F.when(*rules[0]).when(*rules[1]).otherwise(C("p_size"))
    return table(spark, d, "part").select("p_partkey", out.alias("margin"))


@query("map06_cfa_default", f"WITH {TAGS}, p AS (SELECT image_id, arg_min(num, preorder) FILTER (WHERE tag = 8) AS num FROM tags GROUP BY 1) SELECT image_id, coalesce(CASE WHEN num IS NOT NULL THEN ['RGGB', 'BGGR'][(floor(num)::INT % 2 + 1)] END, 'RGGB') AS pattern FROM p")
def _(spark, d):
    num = F.min_by("num", F.when((C("tag") == 8) & C("num").isNotNull(), C("preorder")))
    p = rasters.tags(spark, d).groupBy("image_id").agg(num.alias("num"))
    # In ANSI mode element_at takes a null index for 0 if the array has no nulls.
    known = F.when(C("num").isNotNull(), F.element_at(F.array(F.lit("RGGB"), F.lit("BGGR")), F.floor("num").cast("int") % 2 + 1))
    return p.select("image_id", F.coalesce(known, F.lit("RGGB")).alias("pattern"))


@query("src03_readable", "SELECT doc_id, doc_id % 4 < 3 AS readable FROM documents")
def _(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in ("DNG", "jpeg", "CR2", "mov")]), (C("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", metadata.decoder(F.concat(F.lit("x."), ext)).isNotNull().alias("readable"))


@query("src04_tiff_header", f"WITH {MOSAIC} SELECT DISTINCT 'image-' || image_id || '.tif' AS path, image_id % 2 = 0 AS little, 42::BIGINT AS mark, 8::BIGINT AS first FROM mosaic")
def _(spark, d):
    """Byte order, mark and first directory, from the first eight bytes and without Python."""
    head = _files(spark, d).select("path", F.substring("content", 1, 8).alias("b"))
    little = F.hex(F.substring("b", 1, 2)) == "4949"
    u = lambda at_, n: F.when(little, metadata.unsigned(C("b"), at_, n, True)).otherwise(metadata.unsigned(C("b"), at_, n, False))
    return head.select("path", little.alias("little"), u(2, 2).alias("mark"), u(4, 4).alias("first"))


def _raw_file(spark, d, codec: str, how: int, make: str, shift: int, options: dict):
    """Raw files made of encoded slices, as (path, content)."""
    import struct

    import pandas as pd

    m = rasters.mosaic(spark, d).withColumn("v", F.shiftright("v", shift))
    s = slices.encode(m, 25, codec, options)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        k, n = int(rows["image_id"].iloc[0]), len(rows)
        name = make.encode() + b"\0"
        start = 8
        lists = start + 2 + 12 * 9 + 4
        data = lists + 8 * n + len(name)
        at_, sizes = [], [len(x) for x in rows["data"]]
        for size in sizes:
            at_.append(data)
            data += size
        many = lambda values, place: values[0] if n == 1 else place
        entries = [(256, 4, 1, WIDTH), (257, 4, 1, int((rows["off_y"] + rows["h"]).max())), (258, 4, 1, 16), (259, 4, 1, how), (271, 2, len(name), lists + 8 * n), (273, 4, n, many(at_, lists)), (277, 4, 1, 1), (278, 4, 1, 25), (279, 4, n, many(sizes, lists + 4 * n))]
        out = b"II" + struct.pack("<HI", 42, start) + struct.pack("<H", len(entries))
        for e in entries:
            if e[1] == 2 and e[2] <= 4:
                out += struct.pack("<HHI", *e[:3]) + name.ljust(4, b"\0")
            else:
                out += struct.pack("<HHII", *e)
        out += struct.pack("<I", 0) + struct.pack(f"<{n}I", *at_) + struct.pack(f"<{n}I", *sizes) + name + b"".join(bytes(x) for x in rows["data"])
        return pd.DataFrame({"path": [f"raw-{k}"], "content": [out]})

    return s.groupBy("image_id").applyInPandas(build, "path string, content binary")


for _name, _codec, _how, _make, _shift, _options in (
    ("src14_dng_lossless", "lossless_jpeg", 7, "Any Maker", 0, {}), ("src15_nef_two_lane", "two_lane", 34713, "NIKON CORPORATION", 0, {}), ("src16_cr2_lossless", "lossless_jpeg", 6, "Canon", 0, {}),
    ("src18_pef_two_lane", "two_lane", 65535, "PENTAX", 4, {"tree": TREES["pentax"]}),
):

    def _read(spark, d, codec=_codec, how=_how, make=_make, shift=_shift, options=_options):
        files = _raw_file(spark, d, codec, how, make, shift, options)
        s = raw.raw_slices(files, tiff.read_tags(files))
        v = slices.decode(s).where("error IS NULL").join(s.select("image_id", "path").distinct(), "image_id")
        return v.select("path", "y", "x", "v")

    query(_name, f"WITH {MOSAIC} SELECT 'raw-' || image_id AS path, y, x, v >> {_shift} AS v FROM mosaic")(_read)


_RAF = "WITH h AS (SELECT doc_id, rpad(substr(hex(encode(text)), 1, 216), 216, '0') AS h FROM documents) SELECT doc_id, " + ", ".join(f"('0x' || substr(h, {2 * a + 1}, 8))::BIGINT AS {n}" for n, a in vendors.RAF.items()) + " FROM h"


@query("src21_raf_header", _RAF)
def _(spark, d):
    head = F.unhex(F.rpad(F.substring(F.hex("bytes"), 1, 216), 216, "0"))
    return rasters.byte_rows(spark, d).select("doc_id", head.alias("b")).select("doc_id", *vendors.raf_header(C("b")))


@query("src24_detection", "SELECT p_partkey, ['two_lane', 'lossless_jpeg', 'adaptive', 'blocks14', 'lossless_jpeg'][(p_partkey % 5 + 1)::INT] AS codec FROM part")
def _(spark, d):
    make = F.element_at(F.array(*[F.lit(m) for m in ("NIKON", "Canon", "OLYMPUS IMAGING", "Panasonic", "Other")]), (C("p_partkey") % 5 + 1).cast("int"))
    how = F.element_at(F.array(*[F.lit(h) for h in (34713, 6, 1, 1, 7)]), (C("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", raw.form(make, how)["codec"].alias("codec"))


@query("src22_by_file_size", "SELECT doc_id, CASE WHEN strlen(text) % 11 = 3 THEN 'three' WHEN strlen(text) % 11 = 5 THEN 'five' END AS camera FROM documents")
def _(spark, d):
    cameras = spark.createDataFrame([(3, "three"), (5, "five")], "size int, camera string")
    docs = table(spark, d, "documents").select("doc_id", (F.octet_length("text") % 11).alias("size"))
    return docs.join(F.broadcast(cameras), "size", "left").select("doc_id", "camera")


@query("udf04_pixel_function", f"WITH {MOSAIC} SELECT image_id, y, x, (v * 3 + 1) & {MAX} AS v FROM mosaic")
def _(spark, d):
    from prismlake.operators import opcodes

    everywhere = opcodes.Region(0, 0, HEIGHT, WIDTH)
    return opcodes.map_values(rasters.mosaic(spark, d), everywhere, lambda v: (v * 3 + 1).bitwiseAND(MAX))


@query("jsn01_props", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def _(spark, d):
    """An extension: the look-up of a JSON member."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))

