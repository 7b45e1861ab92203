"""Queries over pixels and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.functions import color, tone
from prismlake.operators import geometry, lookup, stats, stencil
from prismlake.sources import rasters
from prismlake.sources.rasters import DEPTH, HEIGHT, MAX, WIDTH

from .oracle import MOSAIC, PIXELS, SCATTER, at, grid

KEY = ["image_id", "y", "x"]
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def channels(df, columns):
    return df.select(*KEY, *[c.alias(n) for n, c in zip("rgb", columns, strict=True)])


C = F.col


@query("jon01_cfa_lookup", f"WITH {MOSAIC} SELECT image_id, y, x, v, [0, 1, 1, 2][((y % 2) * 2 + x % 2 + 1)::INT] AS color FROM mosaic")
def _(spark, d):
    return rasters.mosaic(spark, d).withColumn("color", geometry.cfa_color("RGGB", F.col("y"), F.col("x")))


@query("prj01_white_balance", f"WITH {PIXELS} SELECT image_id, y, x, r * 1.5::DOUBLE AS r, g * 1.0::DOUBLE AS g, b * 0.75::DOUBLE AS b FROM pixels")
def _(spark, d):
    return channels(rasters.pixels(spark, d), color.white_balance(C("r"), C("g"), C("b"), (1.5, 1.0, 0.75)))


@query("prj02_clip", f"WITH {PIXELS} SELECT image_id, y, x, greatest(0, least({MAX}, r * 1.5::DOUBLE)) AS r, greatest(0, least({MAX}, g - 20000.0::DOUBLE)) AS g, greatest(0, least({MAX}, b * 1.25::DOUBLE)) AS b FROM pixels")
def _(spark, d):
    return channels(rasters.pixels(spark, d), [color.clip(c, MAX) for c in (C("r") * 1.5, C("g") - 20000.0, C("b") * 1.25)])


@query("prj03_clip_plane", f"WITH {PIXELS} SELECT image_id, y, x, greatest(0, least(4095, r - 30000)) AS r, greatest(0, least(4095, g)) AS g, greatest(0, least(4095, b - 65000)) AS b FROM pixels")
def _(spark, d):
    return channels(rasters.pixels(spark, d), [color.clip_int(c, 4095) for c in (C("r") - 30000, C("g"), C("b") - 65000)])


@query("prj04_depth_reduce", f"WITH {PIXELS} SELECT image_id, y, x, greatest(0, least(255, (r - 100) >> 8)) AS r, greatest(0, least(255, g >> 8)) AS g, greatest(0, least(255, (b + 300) >> 8)) AS b FROM pixels")
def _(spark, d):
    return channels(rasters.pixels(spark, d), [color.reduce_depth(c, DEPTH, 8) for c in (C("r") - 100, C("g"), C("b") + 300)])


@query("prj26_clamp_bits", f"WITH {PIXELS} SELECT image_id, y, x, greatest(0, least(4095, r - 1000)) AS v FROM pixels")
def _(spark, d):
    return rasters.pixels(spark, d).select(*KEY, color.clamp_bits(C("r") - 1000, 12).alias("v"))


NORMAL = f"n AS (SELECT *, r::DOUBLE / {MAX}.0::DOUBLE AS r1, g::DOUBLE / {MAX}.0::DOUBLE AS g1, b::DOUBLE / {MAX}.0::DOUBLE AS b1 FROM pixels), m AS (SELECT *, greatest(r1, g1, b1) AS top, least(r1, g1, b1) AS low FROM n)"
HUE = "CASE WHEN top = low THEN 0.0::DOUBLE WHEN r1 = top THEN (g1 - b1) / (top - low) + CASE WHEN g1 < b1 THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END WHEN g1 = top THEN (b1 - r1) / (top - low) + 2.0::DOUBLE ELSE (r1 - g1) / (top - low) + 4.0::DOUBLE END / 6.0::DOUBLE"
HSL = f"{NORMAL}, hsl AS (SELECT image_id, y, x, {HUE} AS h, CASE WHEN top = low THEN 0.0::DOUBLE WHEN (top + low) / 2.0::DOUBLE >= 0.5 THEN (top - low) / (2.0::DOUBLE - top - low) ELSE (top - low) / (top + low) END AS s, (top + low) / 2.0::DOUBLE AS l FROM m)"
HSV = f"{NORMAL}, hsv AS (SELECT image_id, y, x, {HUE} AS h, CASE WHEN top = low THEN 0.0::DOUBLE ELSE (top - low) / top END AS s, top AS v FROM m)"


@query("prj06_rgb_to_hsl", f"WITH {PIXELS}, {HSL} SELECT image_id, y, x, h, s, l FROM hsl")
def _(spark, d):
    p = rasters.pixels(spark, d).select(*KEY, color.rgb_to_hsl(C("r"), C("g"), C("b"), MAX).alias("c"))
    return p.select(*KEY, *[F.col("c")[n].alias(n) for n in "hsl"])


@query("prj08_rgb_to_hsv", f"WITH {PIXELS}, {HSV} SELECT image_id, y, x, h, s, v FROM hsv")
def _(spark, d):
    p = rasters.pixels(spark, d).select(*KEY, color.rgb_to_hsv(C("r"), C("g"), C("b"), MAX).alias("c"))
    return p.select(*KEY, *[F.col("c")[n].alias(n) for n in "hsv"])


@query("prj07_hsl_roundtrip", f"WITH {PIXELS} SELECT image_id, y, x, r, g, b FROM pixels")
def _(spark, d):
    p = rasters.pixels(spark, d).select(*KEY, F.inline(F.array(color.rgb_to_hsl(C("r"), C("g"), C("b"), MAX))))
    p = p.select(*KEY, F.inline(F.array(color.hsl_to_rgb(F.col("h"), F.col("s"), F.col("l"), MAX))))
    return p.select(*KEY, *[F.round(c).cast("int").alias(n) for n, c in zip("rgb", (C("r"), C("g"), C("b")), strict=True)])


@query("prj09_hsv_roundtrip", f"WITH {PIXELS} SELECT image_id, y, x, r, g, b FROM pixels")
def _(spark, d):
    p = rasters.pixels(spark, d).select(*KEY, F.inline(F.array(color.rgb_to_hsv(C("r"), C("g"), C("b"), MAX))))
    p = p.select(*KEY, F.inline(F.array(color.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"), MAX))))
    return p.select(*KEY, *[F.round(c).cast("int").alias(n) for n, c in zip("rgb", (C("r"), C("g"), C("b")), strict=True)])


_RAMP = "CASE WHEN t < 1/6.0::DOUBLE THEN p + (q - p) * 6.0::DOUBLE * t WHEN t < 0.5 THEN q WHEN t < 2/3.0::DOUBLE THEN p + (q - p) * (2/3.0::DOUBLE - t) * 6.0::DOUBLE ELSE p END"


def _hue_sql(t: str) -> str:
    return _RAMP.replace(" t ", f" ({t}) ").replace("* t ", f"* ({t}) ").replace("- t)", f"- ({t}))")


def _wrap(t: str) -> str:
    return f"CASE WHEN {t} < 0 THEN {t} + 1 WHEN {t} > 1 THEN {t} - 1 ELSE {t} END"


@query(
    "prj10_saturation",
    f"""WITH {PIXELS}, {HSL}, pq AS (SELECT image_id, y, x, h, s * 0.5::DOUBLE AS s, l, CASE WHEN l < 0.5 THEN l * (s * 0.5::DOUBLE + 1.0::DOUBLE) ELSE l + s * 0.5::DOUBLE - l * (s * 0.5::DOUBLE) END AS q FROM hsl),
    ts AS (SELECT *, l * 2.0::DOUBLE - q AS p, {_wrap('(h + 1/3.0::DOUBLE)')} AS t0, {_wrap('h')} AS t1, {_wrap('(h - 1/3.0::DOUBLE)')} AS t2 FROM pq)
    SELECT image_id, y, x, {", ".join(f"CASE WHEN s = 0 THEN l ELSE {_hue_sql(f't{k}')} END * {MAX}.0::DOUBLE AS {n}" for k, n in enumerate("rgb"))} FROM ts""",
)
def _(spark, d):
    p = rasters.pixels(spark, d).select(*KEY, F.inline(F.array(color.rgb_to_hsl(C("r"), C("g"), C("b"), MAX))))
    p = p.select(*KEY, F.inline(F.array(color.hsl_to_rgb(F.col("h"), F.col("s") * 0.5, F.col("l"), MAX))))
    return p


_CURVE = dict(ev=0.5, shadow=10, contrast=20, highlight=-5)


def curve_lut(bits: int = 8) -> list[int]:
    return tone.lut(tone.tone_curve(bits, **_CURVE), (1 << bits) - 1)


_C = f"(SELECT 255 AS most, 127 AS mid, 1 AS q, pow(2.0::DOUBLE, 0.5::DOUBLE) AS e)"


@query(
    "prj11_tone_curve",
    f"""WITH {PIXELS}, k AS (SELECT (10 - 20) * q * e AS y0, mid * e AS y1, (most + (20 - 5) * q) * e AS y2, mid AS h0, most - mid AS h1, most, mid FROM {_C}),
    c AS (SELECT *, 3 * ((y2 - y1) / h1 - (y1 - y0) / h0) / (h0 + h1) AS kk FROM k),
    v AS (SELECT i, most, CASE WHEN i <= mid THEN kk * pow(i, 3) / (6 * h0) + y0 * (mid - i) / h0 + (y1 / h0 - kk * h0 / 6) * i
        ELSE kk * pow(most - i, 3) / (6 * h1) + y2 * (i - mid) / h1 + (y1 / h1 - kk * h1 / 6) * (most - i) END AS o FROM c, generate_series(0, 255) g(i)),
    lut AS (SELECT i, greatest(0, least(255, trunc(CASE WHEN o > most THEN 1 ELSE o / most END * 255)))::INT AS o FROM v)
    SELECT image_id, y, x, o AS out FROM pixels JOIN lut ON i = r >> 8""",
)
def _(spark, d):
    return rasters.pixels(spark, d).select(*KEY, tone.apply_lut(F.shiftright("r", 8), curve_lut()).alias("out"))


@query(
    "prj13_split_tone",
    f"""WITH {PIXELS}, w AS (SELECT *, (1.0::DOUBLE - (r + g + b) / 3.0::DOUBLE / {MAX}.0::DOUBLE) * 0.4::DOUBLE AS dark, (r + g + b) / 3.0::DOUBLE / {MAX}.0::DOUBLE * 0.6::DOUBLE AS bright FROM pixels)
    SELECT image_id, y, x, {", ".join(f"({n} + trunc(dark * {s * MAX / 255.0!r}::DOUBLE)::INT + trunc(bright * {h * MAX / 255.0!r}::DOUBLE)::INT)::INT AS {n}" for n, s, h in (("r", 10, 0), ("g", 20, 30), ("b", 0, 5)))} FROM w""",
)
def _(spark, d):
    return channels(rasters.pixels(spark, d), color.split_tone(C("r"), C("g"), C("b"), (10, 20, 0), (0, 30, 5), 0.6, MAX))


for code, name, to in ((1, "90", ("x", f"{HEIGHT - 1} - y")), (2, "180", (f"{HEIGHT - 1} - y", f"{WIDTH - 1} - x")), (3, "270", (f"{WIDTH - 1} - x", "y"))):
    query(f"prj14_rotate_{name}", f"WITH {MOSAIC} SELECT image_id, ({to[0]})::INT AS y, ({to[1]})::INT AS x, v FROM mosaic")(lambda spark, d, code=code: geometry.rotate(rasters.mosaic(spark, d), code, HEIGHT, WIDTH))


@query("prj15_level_scale", f"WITH {MOSAIC}, s AS (SELECT *, trunc((v - 512) * {MAX / (60000 - 512)!r}::DOUBLE)::BIGINT AS t FROM mosaic) SELECT image_id, y, x, CASE WHEN t > 60000 THEN {MAX} WHEN t < 0 THEN 0 ELSE t END::INT AS v FROM s")
def _(spark, d):
    return rasters.mosaic(spark, d).withColumn("v", stats.scale_levels(F.col("v"), 512, 60000, DEPTH))


@query("prj16_phase_scale", f"WITH {MOSAIC} SELECT image_id, y, x, greatest(0, least({MAX}, ((v - [500, 510, 520, 530][((y & 1) * 2 + (x & 1) + 1)::INT]) * [1040, 1030, 1020, 1010][((y & 1) * 2 + (x & 1) + 1)::INT]::BIGINT + 512) >> 10))::INT AS v FROM mosaic")
def _(spark, d):
    phase = (F.col("y").bitwiseAND(1) * 2 + F.col("x").bitwiseAND(1) + 1).cast("int")
    black, gain = F.element_at(F.array(*map(F.lit, (500, 510, 520, 530))), phase), F.element_at(F.array(*map(F.lit, (1040, 1030, 1020, 1010))), phase)
    v = F.shiftright((F.col("v") - black) * gain.cast("long") + 512, 10)
    return rasters.mosaic(spark, d).withColumn("v", color.clip_int(v, MAX).cast("int"))


@query("prj17_lut_apply", f"WITH {MOSAIC} SELECT image_id, y, x, ((v >> 8) * 7) & 255 AS out FROM mosaic")
def _(spark, d):
    lut = spark.range(256).select(F.col("id").cast("int").alias("v"), (F.col("id") * 7).bitwiseAND(255).cast("int").alias("out"))
    return lookup.by_value(rasters.mosaic(spark, d).withColumn("v", F.shiftright("v", 8)), "v", lut).drop("v")


@query("prj19_cfa_planes", f"WITH {MOSAIC}, c AS (SELECT *, (y % 2) * 2 + x % 2 AS p FROM mosaic) SELECT image_id, y, x, CASE WHEN p = 0 THEN v ELSE 0 END AS r, CASE WHEN p IN (1, 2) THEN v ELSE 0 END AS g, CASE WHEN p = 3 THEN v ELSE 0 END AS b FROM c")
def _(spark, d):
    c = geometry.cfa_color("RGGB", F.col("y"), F.col("x"))
    return rasters.mosaic(spark, d).select(*KEY, *[F.when(c == k, F.col("v")).otherwise(0).alias(n) for k, n in enumerate("rgb")])


M3 = [[0.6, 0.3, 0.1], [0.25, 0.5, 0.25], [0.0, 0.25, 0.75]]


@query("prj20_color_matrix", f"WITH {PIXELS} SELECT image_id, y, x, " + ", ".join(f"r * {a / sum(m)!r}::DOUBLE + g * {b_ / sum(m)!r}::DOUBLE + b * {c / sum(m)!r}::DOUBLE AS {n}" for n, m in zip("rgb", M3, strict=True) for a, b_, c in [m]) + " FROM pixels")
def _(spark, d):
    return channels(rasters.pixels(spark, d), [c for c in color.matrix(C("r"), C("g"), C("b"), M3)])


@query("prj21_srgb_linear", f"WITH {PIXELS}, n AS (SELECT *, r::DOUBLE / {MAX}.0::DOUBLE AS n FROM pixels) SELECT image_id, y, x, round(CASE WHEN n < 0.04045 THEN n / 12.92::DOUBLE ELSE pow((n + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END * {MAX}.0::DOUBLE, 3) AS v FROM n")
def _(spark, d):
    return rasters.pixels(spark, d).select(*KEY, F.round(color.srgb_to_linear(C("r").cast("double"), MAX), 3).alias("v"))


@query(
    "prj22_temperature",
    f"""WITH {PIXELS}, t AS (SELECT DISTINCT (10 + r % 300) AS t FROM pixels), f AS (SELECT t,
    CASE WHEN t >= 66 THEN floor(greatest(0, least(255, 351.97690566805693::DOUBLE + (t - 55) * 0.114206453784165::DOUBLE + ln(greatest(t - 55, 1)::DOUBLE) * -40.25366309332127::DOUBLE))) ELSE 255 END AS r,
    CASE WHEN t >= 66 THEN floor(greatest(0, least(255, 325.4494125711974::DOUBLE + (t - 50) * 0.07943456536662342::DOUBLE + ln(greatest(t - 50, 1)::DOUBLE) * -28.0852963507957::DOUBLE)))
         ELSE floor(greatest(0, least(255, -155.25485562709179::DOUBLE + (t - 2) * -0.44596950469579133::DOUBLE + ln(greatest(t - 2, 1)::DOUBLE) * 104.49216199393888::DOUBLE))) END AS g,
    CASE WHEN t >= 66 THEN 255 WHEN t <= 19 THEN 0 ELSE floor(greatest(0, least(255, -254.76935184120902::DOUBLE + (t - 10) * 0.8274096064007395::DOUBLE + ln(greatest(t - 10, 1)::DOUBLE) * 115.67994401066147::DOUBLE))) END AS b FROM t)
    SELECT t, 255 / nullif(r, 0)::DOUBLE AS r, 255 / nullif(g, 0)::DOUBLE AS g, 255 / nullif(b, 0)::DOUBLE AS b FROM f""",
)
def _(spark, d):
    t = rasters.pixels(spark, d).select((C("r") % 300 + 10).alias("t")).distinct()
    gains = color.temperature_gains(F.col("t") * 100)
    return t.select("t", *[c.alias(n) for n, c in zip("rgb", gains, strict=True)])


@query("prj23_power_gamma", f"WITH {PIXELS} SELECT image_id, y, x, round(pow(r / {MAX}.0::DOUBLE, {1 / 2.2!r}::DOUBLE) * {MAX}.0::DOUBLE, 3) AS v FROM pixels")
def _(spark, d):
    return rasters.pixels(spark, d).select(*KEY, F.round(color.power_gamma(C("r").cast("double"), MAX, 2.2), 3).alias("v"))


@query("prj24_luma", f"WITH {SCATTER} SELECT id, (r + g + b) / 3.0::DOUBLE AS mean, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS l601, (greatest(r, g, b) + least(r, g, b)) / 2.0::DOUBLE AS hsl FROM scatter")
def _(spark, d):
    return rasters.scatter(spark, d).select("id", color.luma_mean(C("r"), C("g"), C("b")).alias("mean"), color.luma_601(C("r"), C("g"), C("b")).alias("l601"), color.luma_hsl(C("r"), C("g"), C("b")).alias("hsl"))


@query("prj25_neutral_wb", f"WITH {PIXELS}, p AS (SELECT (g + 1)::DOUBLE / (r + 1) AS kr, (g + 1)::DOUBLE / (b + 1) AS kb, image_id FROM pixels WHERE y = 7 AND x = 9) SELECT q.image_id, y, x, r * kr AS r, g::DOUBLE AS g, b * kb AS b FROM pixels q JOIN p ON q.image_id = p.image_id")
def _(spark, d):
    p = rasters.pixels(spark, d)
    gains = [c.alias(f"k{n}") for n, c in zip("rgb", color.neutral_gains(C("r"), C("g"), C("b")), strict=True)]
    picked = p.where("y = 7 AND x = 9").select("image_id", *gains)  # one row an image
    return channels(p.join(picked, "image_id"), [C("r") * F.col("kr"), C("g") * F.col("kg"), C("b") * F.col("kb")])


@query("prj27_dng_maps", f"WITH {MOSAIC} SELECT image_id, y, x, CASE WHEN y BETWEEN 10 AND 59 AND x BETWEEN 8 AND 39 AND (y - 10) % 2 = 0 AND (x - 8) % 3 = 0 THEN greatest(0, least({MAX}, trunc((0.05::DOUBLE + (v / {MAX}.0::DOUBLE) * (0.5::DOUBLE + (v / {MAX}.0::DOUBLE) * 0.4::DOUBLE)) * {MAX}.0::DOUBLE)))::INT ELSE v END AS v FROM mosaic")
def _(spark, d):
    from prismlake.operators import opcodes

    roi = opcodes.Region(10, 8, 60, 40, row_pitch=2, col_pitch=3)
    return opcodes.map_polynomial(rasters.mosaic(spark, d), roi, [0.05, 0.5, 0.4], MAX)


@query("prj28_gain_map", f"WITH {MOSAIC} SELECT image_id, y, x, greatest(0, least({MAX}, trunc(v * (1.0::DOUBLE + 0.1::DOUBLE * ((y // 25)::INT * 4 + (x // 16)::INT)))))::INT AS v FROM mosaic")
def _(spark, d):
    from prismlake.operators import opcodes

    gains = spark.range(16).select((F.expr("id div 4")).cast("int").alias("gy"), (F.col("id") % 4).cast("int").alias("gx"), (F.lit(1.0) + F.lit(0.1) * F.col("id").cast("int")).alias("gain"))
    return opcodes.gain_map(rasters.mosaic(spark, d), gains, 0, 0, 25, 16, MAX)


@query("prj29_row_offsets", f"WITH {MOSAIC} SELECT image_id, y, x, greatest(0, least({MAX}, v + (y * 13) % 100 - 50)) AS plus, greatest(0, least({MAX}, ((900 + x)::BIGINT * v + 512) >> 10))::INT AS times FROM mosaic")
def _(spark, d):
    from prismlake.operators import opcodes

    m = rasters.mosaic(spark, d)
    rows = spark.range(HEIGHT).select(F.col("id").cast("int").alias("k"), ((F.col("id") * 13) % 100 - 50).cast("int").alias("d"))
    columns = spark.range(WIDTH).select(F.col("id").cast("int").alias("k"), (F.col("id") + 900).cast("int").alias("d"))
    return opcodes.offset_by(m, rows, "y", MAX).withColumnRenamed("v", "plus").join(opcodes.scale_by(m, columns, "x", MAX).withColumnRenamed("v", "times"), KEY)


@query("flt01_crop", f"WITH {PIXELS} SELECT image_id, (y - 10)::INT AS y, (x - 5)::INT AS x, r, g, b FROM pixels WHERE y BETWEEN 10 AND 59 AND x BETWEEN 5 AND 44")
def _(spark, d):
    return geometry.crop(rasters.pixels(spark, d), 10, 5, 50, 40, HEIGHT, WIDTH)


@query("flt02_reset_crop", f"WITH {PIXELS} SELECT image_id, y, x, r, g, b FROM pixels")
def _(spark, d):
    return geometry.crop(rasters.pixels(spark, d), 10, 5, HEIGHT, 40, HEIGHT, WIDTH)


@query("flt03_crop_phase", f"WITH {MOSAIC} SELECT image_id, (y - 3)::INT AS y, (x - 5)::INT AS x, v, [0, 1, 1, 2][((y % 2) * 2 + x % 2 + 1)::INT] AS color FROM mosaic WHERE y BETWEEN 3 AND 52 AND x BETWEEN 5 AND 44")
def _(spark, d):
    m = geometry.crop(rasters.mosaic(spark, d), 3, 5, 50, 40, HEIGHT, WIDTH)
    return m.withColumn("color", geometry.cfa_color(geometry.shifted_pattern("RGGB", 2, 3, 5), F.col("y"), F.col("x")))


@query("flt06_point_bounds", f"WITH {PIXELS} SELECT image_id, y, x, (g % 128 < {WIDTH} AND b % 128 < {HEIGHT}) AS inside FROM pixels")
def _(spark, d):
    return rasters.pixels(spark, d).select(*KEY, ((C("g") % 128).between(0, WIDTH - 1) & (C("b") % 128).between(0, HEIGHT - 1)).alias("inside"))


@query("flt05_rectangles", f"WITH {PIXELS} SELECT image_id, y, x, (r % 40 >= 10 AND g % 40 >= 10 AND r % 40 + b % 20 <= 50 AND g % 40 + 5 <= 45) AS inside, greatest(0, least(50, r % 40 + b % 20) - greatest(10, r % 40)) AS w, greatest(0, least(45, g % 40 + 5) - greatest(10, g % 40)) AS h FROM pixels")
def _(spark, d):
    a = {"x": F.lit(10), "y": F.lit(10), "w": F.lit(40), "h": F.lit(35)}
    b = {"x": C("r") % 40, "y": C("g") % 40, "w": C("b") % 20, "h": F.lit(5)}
    _, _, w, h = geometry.intersection(a, b)
    return rasters.pixels(spark, d).select(*KEY, geometry.contains(a, b).alias("inside"), w.alias("w"), h.alias("h"))


@query("flt17_zero_pixels", f"WITH {MOSAIC} SELECT image_id, y, x FROM mosaic WHERE v % 256 = 0")
def _(spark, d):
    return rasters.mosaic(spark, d).where("v % 256 = 0").select(*KEY)


@query("snk02_pack_bgra", f"WITH {PIXELS} SELECT image_id, y, x, least(255, b >> 8) AS b8, least(255, g >> 8) AS g8, least(255, r >> 8) AS r8, 255 AS a8 FROM pixels")
def _(spark, d):
    return rasters.pixels(spark, d).select(*KEY, *color.pack_bgra8(C("r"), C("g"), C("b"), DEPTH))


@query("snk03_pack_rgba16", f"WITH {PIXELS} SELECT image_id, y, x, " + ", ".join(f"{n} >> 8 AS {n}_hi, {n} & 255 AS {n}_lo" for n in "rgb") + " FROM pixels")
def _(spark, d):
    return rasters.pixels(spark, d).select(*KEY, *color.pack_rgba16(C("r"), C("g"), C("b")))


@query("agg01_histogram", f"WITH {PIXELS}, h AS (SELECT unnest([{{'channel': 'r', 'bin': r >> 8}}, {{'channel': 'g', 'bin': g >> 8}}, {{'channel': 'b', 'bin': b >> 8}}, {{'channel': 'luma', 'bin': trunc((r >> 8) * 0.299::DOUBLE + (g >> 8) * 0.587::DOUBLE + (b >> 8) * 0.114::DOUBLE)::INT}}]) AS u FROM pixels) SELECT u.channel AS channel, u.bin AS bin, count(*) AS n FROM h GROUP BY 1, 2")
def _(spark, d):
    r, g, b = (color.reduce_depth(c, DEPTH, 8) for c in (C("r"), C("g"), C("b")))
    return stats.histogram(rasters.pixels(spark, d), {"r": r, "g": g, "b": b, "luma": color.luma_601(r, g, b)})


@query("agg02_luma_histogram", f"WITH {SCATTER} SELECT 'luma' AS channel, floor((greatest(r, g, b) + least(r, g, b)) / 2.0::DOUBLE / 256)::INT AS bin, count(*) AS n FROM scatter GROUP BY 2")
def _(spark, d):
    return stats.histogram(rasters.scatter(spark, d), {"luma": F.floor(color.luma_hsl(C("r"), C("g"), C("b")) / 256)})


@query(
    "agg03_equalise",
    f"""WITH {PIXELS}, p AS (SELECT image_id, y, x, r >> 8 AS r, g >> 8 AS g, b >> 8 AS b FROM pixels), l AS (SELECT image_id, trunc(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)::INT AS bin, count(*) AS n FROM p GROUP BY 1, 2),
    d AS (SELECT i.image_id, g.bin, coalesce(l.n, 0) AS n FROM (SELECT DISTINCT image_id FROM p) i CROSS JOIN (SELECT unnest(generate_series(0, 255)) AS bin) g LEFT JOIN l ON l.image_id = i.image_id AND l.bin = g.bin),
    lut AS (SELECT image_id, bin, trunc(sum(n) OVER (PARTITION BY image_id ORDER BY bin) * 255 / (sum(n) OVER (PARTITION BY image_id))::DOUBLE)::INT AS o FROM d)
    SELECT p.image_id, p.y, p.x, a.o AS r, b.o AS g, c.o AS b FROM p JOIN lut a ON a.image_id = p.image_id AND a.bin = r JOIN lut b ON b.image_id = p.image_id AND b.bin = g JOIN lut c ON c.image_id = p.image_id AND c.bin = p.b""",
)
def _(spark, d):
    p = channels(rasters.pixels(spark, d), [color.reduce_depth(c, DEPTH, 8) for c in (C("r"), C("g"), C("b"))])
    return stats.equalise(p, color.luma_601(C("r"), C("g"), C("b")), ["r", "g", "b"], 8)


@query("agg04_preview", f"WITH {PIXELS} SELECT image_id, (y // 4)::INT AS y, (x // 4)::INT AS x, (sum(r) // 16)::INT AS r, (sum(g) // 16)::INT AS g, (sum(b) // 16)::INT AS b FROM pixels GROUP BY 1, 2, 3")
def _(spark, d):
    return geometry.preview(rasters.pixels(spark, d), 4, HEIGHT, WIDTH)


@query("agg05_preview_auto", f"WITH {PIXELS} SELECT image_id, (y // 3)::INT AS y, (x // 3)::INT AS x, (sum(r) // 9)::INT AS r, (sum(g) // 9)::INT AS g, (sum(b) // 9)::INT AS b FROM pixels WHERE y < 99 AND x < 63 GROUP BY 1, 2, 3")
def _(spark, d):
    return geometry.preview(rasters.pixels(spark, d), geometry.preview_factor(HEIGHT, WIDTH, 20, 18), HEIGHT, WIDTH)


@query("agg06_black_mean", f"WITH {MOSAIC} SELECT image_id, (sum(v) // count(*))::BIGINT AS black FROM mosaic WHERE x < 8 GROUP BY 1")
def _(spark, d):
    return stats.mean_level(rasters.mosaic(spark, d).where("x < 8"))


@query("agg08_black_by_phase", f"WITH {MOSAIC}, h AS (SELECT image_id, ((y % 2) * 2 + x % 2)::INT AS phase, v, row_number() OVER (PARTITION BY image_id, y % 2, x % 2 ORDER BY v) AS i, count(*) OVER (PARTITION BY image_id, y % 2, x % 2) AS n FROM mosaic WHERE x < 16) SELECT image_id, phase, min(v) AS black FROM h WHERE i > n // 2 GROUP BY 1, 2")
def _(spark, d):
    return stats.phase_levels(rasters.mosaic(spark, d).where("x < 16"))


@query("agg09_level_estimate", f"WITH {MOSAIC} SELECT image_id, min(v) AS black, max(v) AS white FROM mosaic WHERE y BETWEEN 10 AND 89 AND x BETWEEN 10 AND 53 GROUP BY 1")
def _(spark, d):
    return stats.estimated_levels(rasters.mosaic(spark, d), HEIGHT, WIDTH, 10)


@query("agg10_black_delta", f"WITH {MOSAIC} SELECT image_id, (x % 2)::INT AS phase, sum(v)::BIGINT AS total FROM mosaic WHERE y = 0 GROUP BY 1, 2")
def _(spark, d):
    return stats.alternating_sums(rasters.mosaic(spark, d).where("y = 0"))


@query("agg11_auto_exposure", f"WITH {MOSAIC}, m AS (SELECT image_id, sum(v >> 8)::DOUBLE / count(*) AS mean FROM mosaic GROUP BY 1) SELECT image_id, round(mean, 6) AS mean, round(CASE WHEN mean = 78 THEN 0 ELSE log2(abs(78.0::DOUBLE - mean) / 8.0::DOUBLE) * sign(78.0::DOUBLE - mean) END, 6) AS ev FROM m")
def _(spark, d):
    hist = rasters.mosaic(spark, d).groupBy("image_id", F.shiftright("v", 8).alias("bin")).agg(F.count("*").alias("n"))
    return stats.auto_exposure(hist).select("image_id", F.round("mean", 6).alias("mean"), F.round("ev", 6).alias("ev"))


@query("agg15_histogram_max", f"WITH {SCATTER}, h AS (SELECT r >> 8 AS bin, count(*) AS n FROM scatter GROUP BY 1) SELECT max(n) AS top FROM h")
def _(spark, d):
    return stats.histogram(rasters.scatter(spark, d), {"r": F.shiftright("r", 8)}).agg(F.max("n").alias("top"))


def _interior(c: str) -> str:
    total = " + ".join(at(c, j, i) for j in (-1, 0, 1) for i in (-1, 0, 1))
    return f"({total})"


def _stencil_sql(first: str) -> str:
    cells = ", ".join(f"CASE WHEN {_interior(c)} IS NULL THEN {c} ELSE {first.format(c=c, s=_interior(c))} END::INT AS {c}" for c in "rgb")
    return f"WITH {PIXELS}, {grid('pixels', ['r', 'g', 'b'], 1)} SELECT image_id, y, x, {cells} FROM grid"


@query("win01_sharpen", _stencil_sql("trunc((15 * {c} - {s}) / 6.0::DOUBLE)"))
def _(spark, d):
    return stencil.sharpen(rasters.pixels(spark, d), 5)


@query("win02_denoise", _stencil_sql("trunc((5 * {c} + {s}) / 14.0::DOUBLE)"))
def _(spark, d):
    return stencil.smooth(rasters.pixels(spark, d), 5)


def V(dy: int, dx: int) -> str:
    return at("v", dy, dx, True)


def _sites(red: str, blue: str, green_red_row: str, green_blue_row: str) -> str:
    return f"CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN {red} WHEN y % 2 = 1 AND x % 2 = 1 THEN {blue} WHEN y % 2 = 0 THEN {green_red_row} ELSE {green_blue_row} END::INT"


CROSS, CORNERS = f"({V(-1, 0)} + {V(1, 0)} + {V(0, -1)} + {V(0, 1)}) // 4", f"({V(-1, -1)} + {V(-1, 1)} + {V(1, -1)} + {V(1, 1)}) // 4"
ACROSS, ALONG = f"({V(0, -1)} + {V(0, 1)}) // 2", f"({V(-1, 0)} + {V(1, 0)}) // 2"


@query("win04_demosaic_fast", f"WITH {MOSAIC}, {grid('mosaic', ['v'], 1)} SELECT image_id, y, x, {_sites('v', CORNERS, ACROSS, ALONG)} AS r, {_sites(CROSS, CROSS, 'v', 'v')} AS g, {_sites(CORNERS, 'v', ALONG, ACROSS)} AS b FROM grid")
def _(spark, d):
    return stencil.demosaic_fast(rasters.mosaic(spark, d))


_BX, _BY = f"(2.0::DOUBLE * v - {at('v', 0, 2)} - {at('v', 0, -2)})", f"(2.0::DOUBLE * v - {at('v', 2, 0)} - {at('v', -2, 0)})"
_AX, _AY = f"(abs({at('v', 0, -1)} - {at('v', 0, 1)}) + abs({_BX}))", f"(abs({at('v', 1, 0)} - {at('v', -1, 0)}) + abs({_BY}))"
_N4 = f"({at('v', -1, 0)} + {at('v', 1, 0)} + {at('v', 0, -1)} + {at('v', 0, 1)})"
_GREEN = f"CASE WHEN abs({_AY} - {_AX}) < 2 THEN {_N4} / 4.0::DOUBLE + ({_BX} + {_BY}) / 8.0::DOUBLE WHEN {_AX} < {_AY} THEN ({at('v', 0, -1)} + {at('v', 0, 1)}) / 2.0::DOUBLE + {_BX} / 4.0::DOUBLE ELSE ({at('v', 1, 0)} + {at('v', -1, 0)}) / 2.0::DOUBLE + {_BY} / 4.0::DOUBLE END"
_MISSING = f"CASE WHEN y BETWEEN 3 AND {HEIGHT - 4} AND x BETWEEN 3 AND {WIDTH - 4} THEN trunc(greatest({_GREEN}, 0))::INT & 65535 ELSE {CROSS} END"


def D(dy: int, dx: int) -> str:
    return at("d", dy, dx, True)


_SIDES, _ENDS, _DCORN = f"trunc(({D(0, 1)} + {D(0, -1)}) / 2.0::DOUBLE)", f"trunc(({D(-1, 0)} + {D(1, 0)}) / 2.0::DOUBLE)", f"trunc(({D(-1, -1)} + {D(-1, 1)} + {D(1, -1)} + {D(1, 1)}) / 4.0::DOUBLE)"
_W = lambda e: f"greatest({e} + g, 0)"


@query(
    "win05_demosaic_adams",
    f"""WITH {MOSAIC}, {grid('mosaic', ['v'], 2)}, green AS (SELECT image_id, y, x, v, {_sites(_MISSING, _MISSING, 'v', 'v')} AS g FROM grid), diff AS (SELECT *, v - g AS d FROM green), {grid('diff', ['d'], 1, 'dg')}
    SELECT image_id, y, x, {_sites('v', _W(_DCORN), _W(_SIDES), _W(_ENDS))} AS r, g, {_sites(_W(_DCORN), 'v', _W(_ENDS), _W(_SIDES))} AS b FROM dg""",
)
def _(spark, d):
    return stencil.demosaic_directional(rasters.mosaic(spark, d), "RGGB", HEIGHT, WIDTH)


def _masked(k: int, color_of: str) -> str:
    cells = [at("c", j, i) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    total = " + ".join(f"CASE WHEN {c} % 4 = {k} THEN {c} // 4 ELSE 0 END" for c in cells)
    count = " + ".join(f"CASE WHEN {c} % 4 = {k} THEN 1 ELSE 0 END" for c in cells)
    return f"CASE WHEN c % 4 = {k} THEN c // 4 WHEN ({count}) > 0 THEN ({total}) // ({count}) ELSE 0 END::INT"


XTRANS = "GBGGRGRGRBGBGBGGRGGRGGBGBGBRGRGRGGBG"


@query(
    "win12_demosaic_plain_means",
    f"""WITH {MOSAIC}, {grid('mosaic', ['v'], 2)}
    SELECT image_id, y, x, {_sites('v', CORNERS, ACROSS, ALONG)} AS r, {_sites(_MISSING, _MISSING, 'v', 'v')} AS g, {_sites(CORNERS, 'v', ALONG, ACROSS)} AS b FROM grid""",
)
def _(spark, d):
    return stencil.demosaic_directional(rasters.mosaic(spark, d), "RGGB", HEIGHT, WIDTH, differences=False)


def _pattern_sql(pattern: str, size: int) -> str:
    codes = "[" + ", ".join(str("RGB".index(c)) for c in pattern) + "]"
    return f"WITH {MOSAIC}, coded AS (SELECT image_id, y, x, v * 4 + {codes}[((y % {size}) * {size} + x % {size} + 1)::INT] AS c FROM mosaic), {grid('coded', ['c'], 1)} SELECT image_id, y, x, {_masked(0, '')} AS r, {_masked(1, '')} AS g, {_masked(2, '')} AS b FROM grid"


@query("win07_demosaic_bilinear", _pattern_sql("RGGB", 2))
def _(spark, d):
    return stencil.demosaic_bilinear(rasters.mosaic(spark, d))


@query("win11_demosaic_xtrans", _pattern_sql(XTRANS, 6))
def _(spark, d):
    return stencil.demosaic_pattern(rasters.mosaic(spark, d), XTRANS, 6)


def _spread_sql(k: int) -> str:
    cells = ["c", *[at("c", *p) for p in ((1, 1), (1, 0), (1, -1), (0, 1), (0, -1), (-1, 1), (-1, 0), (-1, -1))]]
    return "coalesce(" + ", ".join(f"CASE WHEN {c} % 4 = {k} THEN {c} // 4 END" for c in cells) + ", 0)::INT"


@query("win10_demosaic_spread", f"WITH {MOSAIC}, coded AS (SELECT image_id, y, x, v * 4 + {['RGB'.index(c) for c in XTRANS]}[((y % 6) * 6 + x % 6 + 1)::INT] AS c FROM mosaic), {grid('coded', ['c'], 1)} SELECT image_id, y, x, {_spread_sql(0)} AS r, {_spread_sql(1)} AS g, {_spread_sql(2)} AS b FROM grid")
def _(spark, d):
    return stencil.demosaic_spread(rasters.mosaic(spark, d), XTRANS, 6)


def _sum(*cells: tuple) -> str:
    return "(" + " + ".join(f"coalesce({at('v', *c)}, 0)" for c in cells) + ")"


def _there(*cells: tuple) -> str:
    return "(" + " + ".join(f"({at('v', *c)} IS NOT NULL)::INT" for c in cells) + ")"


_NS, _WE, _FY, _FX, _CO = ((-1, 0), (1, 0)), ((0, -1), (0, 1)), ((-2, 0), (2, 0)), ((0, -2), (0, 2)), ((-1, -1), (-1, 1), (1, -1), (1, 1))
_BEND = f"({_there(*_FX, *_FY)} * v - {_sum(*_FX, *_FY)})"
_KEEP = lambda e, n: f"(trunc(({e}) / ({n})::DOUBLE)::INT & 65535)"
_LINE = lambda pair, far, off: _KEEP(f"{_sum(*pair)} * 8 + ({_there(*_CO, *far)} * 2 - {_there(*off)}) * v - {_sum(*_CO, *far)} * 2 + {_sum(*off)}", f"{_there(*pair)} * 8")
_L5C, _L5O = _KEEP(f"{_sum(*_NS, *_WE)} * 2 + {_BEND}", f"{_there(*_NS, *_WE)} * 2"), _KEEP(f"{_sum(*_CO)} * 4 + {_BEND} * 3", f"{_there(*_CO)} * 4")
_L5A, _L5N = _LINE(_WE, _FX, _FY), _LINE(_NS, _FY, _FX)


@query("win08_demosaic_malvar", f"WITH {MOSAIC}, {grid('mosaic', ['v'], 2)} SELECT image_id, y, x, {_sites('v', _L5O, _L5A, _L5N)} AS r, {_sites(_L5C, _L5C, 'v', 'v')} AS g, {_sites(_L5O, 'v', _L5N, _L5A)} AS b FROM grid")
def _(spark, d):
    return stencil.demosaic_linear5(rasters.mosaic(spark, d))


@query("win13_hist_smooth", f"WITH {SCATTER}, h AS (SELECT 'g' AS channel, g >> 8 AS bin, count(*) AS n FROM scatter GROUP BY 2) SELECT channel, bin, coalesce(trunc(lag(n) OVER w * 0.25 + n * 0.5 + lead(n) OVER w * 0.25)::BIGINT, 0) AS n FROM h WINDOW w AS (PARTITION BY channel ORDER BY bin)")
def _(spark, d):
    return stats.smooth_histogram(stats.histogram(rasters.scatter(spark, d), {"g": F.shiftright("g", 8)}))


_BAD = "(v % 17 = 0)"
_PART = "(PARTITION BY image_id, y, x % 2 ORDER BY x"
_PARTC = "(PARTITION BY image_id, x, y % 2 ORDER BY y"


@query(
    "win16_bad_pixel",
    f"""WITH {MOSAIC}, m AS (SELECT *, {_BAD} AS bad, CASE WHEN NOT {_BAD} THEN v END AS gv, CASE WHEN NOT {_BAD} THEN x END AS gx, CASE WHEN NOT {_BAD} THEN y END AS gy FROM mosaic),
    n AS (SELECT *, {", ".join(f"last_value({c} IGNORE NULLS) OVER {p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {a}0, first_value({c} IGNORE NULLS) OVER {p} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS {a}1" for c, p, a in (("gv", _PART, "hv"), ("gx", _PART, "hx"), ("gv", _PARTC, "vv"), ("gy", _PARTC, "vy")))} FROM m),
    d AS (SELECT *, coalesce(x - hx0, 0) AS d0, coalesce(hx1 - x, 0) AS d1, coalesce(y - vy0, 0) AS d2, coalesce(vy1 - y, 0) AS d3 FROM n),
    w AS (SELECT *, CASE WHEN d0 > 0 THEN (d1 * 256) // (d0 + d1) ELSE 0 END AS wx, CASE WHEN d2 > 0 THEN (d3 * 256) // (d2 + d3) ELSE 0 END AS wy FROM d),
    s AS (SELECT *, CASE WHEN d0 + d1 > 0 THEN coalesce(hv0 * wx, 0) + coalesce(hv1 * (256 - wx), 0) ELSE 0 END + CASE WHEN d2 + d3 > 0 THEN coalesce(vv0 * wy, 0) + coalesce(vv1 * (256 - wy), 0) ELSE 0 END AS total, 7 + (d0 + d1 > 0)::INT + (d2 + d3 > 0)::INT AS k FROM w)
    SELECT image_id, y, x, CASE WHEN bad THEN least(total >> k, {MAX}) ELSE v END::INT AS v FROM s""",
)
def _(spark, d):
    return stencil.repair(rasters.mosaic(spark, d), F.col("v") % 17 == 0)


@query("win17_expand_border", f"WITH {MOSAIC} SELECT m.image_id, m.y, m.x, e.v FROM mosaic m JOIN mosaic e ON e.image_id = m.image_id AND e.y = greatest(10, least(89, m.y)) AND e.x = greatest(4, least(59, m.x))")
def _(spark, d):
    return stencil.expand_border(rasters.mosaic(spark, d), 10, 4, 80, 56)


@query("jon08_nearest_valid", f"WITH {MOSAIC}, m AS (SELECT *, CASE WHEN v % 5 <> 0 THEN v END AS g FROM mosaic) SELECT image_id, y, x, v, last_value(g IGNORE NULLS) OVER {_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(g IGNORE NULLS) OVER {_PART} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM m")
def _(spark, d):
    return lookup.nearest_valid(rasters.mosaic(spark, d), F.col("v") % 5 != 0)


@query("jon10_black_areas", f"WITH {MOSAIC} SELECT image_id, y, x, v FROM mosaic WHERE y < 4 OR x BETWEEN 60 AND 63")
def _(spark, d):
    bands = spark.createDataFrame([(0, 4, False), (60, 4, True)], "start int, size int, vertical boolean")
    return lookup.in_bands(rasters.mosaic(spark, d), bands)


@query("srt02_aspect_argmin", f"WITH {PIXELS}, s AS (SELECT image_id, y, x, r + 1 AS w, g + 1 AS h FROM pixels), c AS (SELECT *, k.i, k.n, abs(w / h::DOUBLE - k.r) AS d FROM s CROSS JOIN (VALUES (0, '16:9', {16 / 9!r}::DOUBLE), (1, '3:2', 1.5::DOUBLE), (2, '4:3', {4 / 3!r}::DOUBLE), (3, '1:1', 1.0::DOUBLE)) k(i, n, r)) SELECT image_id, y, x, arg_min(n, [d, i]) AS ratio FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    return rasters.pixels(spark, d).select(*KEY, lookup.closest_ratio(C("r") + 1, C("g") + 1).alias("ratio"))


@query("set03_bad_pixel_union", f"WITH {MOSAIC}, n AS (SELECT DISTINCT image_id FROM mosaic), r AS (SELECT image_id, y::INT AS y, x::INT AS x FROM n, generate_series(5, 9) a(y), generate_series(10, 29) b(x)) SELECT image_id, y, x FROM mosaic WHERE v % 31 = 0 UNION SELECT image_id, 1 AS y, 2 AS x FROM n UNION SELECT * FROM r")
def _(spark, d):
    from prismlake.operators import opcodes

    m = rasters.mosaic(spark, d)
    points = m.select("image_id").distinct().select("image_id", F.lit(1).alias("y"), F.lit(2).alias("x"))
    return opcodes.bad_pixels(m, F.col("v") % 31 == 0, points, [(5, 10, 10, 30)])
