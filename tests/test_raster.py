import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import binary, color, metadata, tone
from prismlake.operators import geometry, history, lookup, opcodes, stats, stencil, tiles
from prismlake.plans import catalog
from prismlake.plans.edit import Edit, render

DATA = "/root/testdata/sf0.001"


def frame(spark, *planes, names=("r", "g", "b")):
    h, w = planes[0].shape
    rows = [(1, y, x, *[int(p[y, x]) for p in planes]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, " + ", ".join(f"{n} int" for n in names[: len(planes)]))


def plane(df, name, h, w):
    out = np.full((h, w), -1, np.int64)
    for r in df.select("y", "x", name).collect():
        out[r.y, r.x] = r[name]
    return out


def random_planes(h, w, n=3, most=65536, seed=1):
    return list(np.random.default_rng(seed).integers(0, most, (n, h, w)))


@pytest.mark.parametrize("op", [stencil.sharpen, stencil.smooth])
def test_flat_images_stay(spark, op):
    flat = np.full((6, 6), 777)
    out = op(frame(spark, flat, flat, flat), 5)
    assert all((plane(out, c, 6, 6) == 777).all() for c in "rgb")


def test_stencils_by_hand_and_by_tiles(spark):
    p = random_planes(9, 11)
    df = frame(spark, *p)
    for op, kernel, centre, div in ((stencil.sharpen, tiles.sharpen, 14, -6), (stencil.smooth, tiles.smooth, 6, 14)):
        long = op(df, 5)
        for size in (4, 256):
            tiled = tiles.apply(df, kernel(5), ["r", "g", "b"], 9, 11, 1, size)
            assert sorted(map(tuple, tiled.collect())) == sorted(map(tuple, long.select("image_id", "y", "x", "r", "g", "b").collect()))
        got = plane(long, "r", 9, 11)
        for y in range(9):
            for x in range(11):
                if y in (0, 8) or x in (0, 10):
                    want = p[0][y, x]
                else:
                    around = int(p[0][y - 1 : y + 2, x - 1 : x + 2].sum() - p[0][y, x])
                    total = centre * int(p[0][y, x]) - around if div < 0 else centre * int(p[0][y, x]) + around
                    want = int(total / abs(div))
                assert got[y, x] == want


def test_tiles_of_images_that_lack_rows(spark):
    """an image's edges are the rows and columns that it has, whatever the frame."""
    df = frame(spark, *random_planes(9, 11)).where("y < 6 AND x > 0")
    gap = frame(spark, *random_planes(9, 11)).where("y NOT IN (0, 4) AND x NOT IN (3, 10)")
    for op, kernel in ((stencil.sharpen, tiles.sharpen), (stencil.smooth, tiles.smooth)):
        for part, size in ((df, 4), (df, 256), (gap, 256)):
            tiled = tiles.apply(part, kernel(5), ["r", "g", "b"], 9, 11, 1, size)
            assert sorted(map(tuple, tiled.collect())) == sorted(map(tuple, op(part, 5).select("image_id", "y", "x", "r", "g", "b").collect()))
    short = frame(spark, *random_planes(9, 11)).where("y < 6")
    means = [sorted(map(tuple, tiles.apply(short, tiles.nl_means(1, 2, 3000.0), ["r", "g", "b"], height, 11, 3).collect())) for height in (6, 9)]
    assert means[0] == means[1]


def test_cfa_default_of_images_without_the_tag(spark, tmp_path):
    """no entry, or none with a number, is RGGB; entries without a number are passed over."""
    rows = [(8, 1, 1.0), (19, 1, 0.0), (9, 2, 1.0), (8 + 22, 3, None), (8 + 33, 3, 3.5), (8 + 44, 4, None), (8 + 55, 5, 2.0)]
    spark.createDataFrame([(e, u, "a", v) for e, u, v in rows], "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.image_id: r.pattern for r in catalog.queries()["map06_cfa_default"](spark, str(tmp_path)).collect()}
    assert got == {1: "BGGR", 2: "RGGB", 3: "BGGR", 4: "RGGB", 5: "RGGB"}


@pytest.mark.parametrize("kind", ["long", "double"])
def test_ranges_meet_values_on_keys(spark, kind):
    """the first range of a value, as by trying all; the join has no condition besides its keys."""
    r = np.random.default_rng(5)
    dim = [(int(r.integers(0, 6)), k, int(lo), int(r.choice([0, lo + r.integers(-1, 30)])), k * 3) for k, lo in enumerate(r.integers(-40, 60, 60))]
    dim += [(0, 70, 0, 0, 210), (0, 71, 0, 0, 213), (7, 72, 5, 6, 216), (8, 73, None, None, 219), (9, 74, 3, None, 222), (9, 75, None, 9, 225), (1, 76, -(1 << 30), 1 << 40, 228), (1, 77, 50, 0, None)]
    values = [int(v) for v in range(-60, 110)] + [None, 1 << 39, -(1 << 39), 1 << 50]
    values = [v if v is None or kind == "long" else v + float(r.choice([0, 0.5, -0.25])) for v in values]
    rows = [(k, c, v) for k, (c, v) in enumerate((c, v) for c in (*range(10), None) for v in (*values, values[70]))]
    ranges = spark.createDataFrame(dim, "camera int, ord long, lo int, hi long, black long") if kind == "double" else spark.createDataFrame(dim, "camera int, ord long, lo long, hi long, black long")
    df = spark.createDataFrame(rows, f"id int, camera int, iso {kind}")
    want = {}
    for k, c, v in rows:
        own = [x for x in dim if x[0] == c]
        met = [x for x in own if len(own) == 1 or None not in (v, *x[2:4]) and v >= x[2] and (v <= x[3] or x[3] == 0)]
        want[k] = (c, v, min(met, key=lambda x: (x[2] == x[3] == 0, x[1]))[4] if met else None)
    out = lookup.by_range(df, "camera", "iso", ranges, ["black"])
    got = out.collect()
    assert len(got) == len(rows) and {x.id: (x.camera, x.iso, x.black) for x in got} == want
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any(">=" in line or "NestedLoop" in line for line in joins)


def test_identity_adds_no_step(spark):
    df = frame(spark, *random_planes(4, 4))
    assert stencil.sharpen(df, 0) is df and stencil.smooth(df, 0) is df
    with pytest.raises(ValueError):
        stencil.sharpen(df, 11)
    plan = render(df, Edit(), 16, 4, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_rotations(spark):
    v = np.arange(20).reshape(4, 5)
    df = frame(spark, v, names=("v",))
    for code, want in ((1, np.rot90(v, -1)), (2, np.rot90(v, 2)), (3, np.rot90(v))):
        assert (plane(geometry.rotate(df, code, 4, 5), "v", *want.shape) == want).all()
    once = geometry.rotate(geometry.rotate(geometry.rotate(geometry.rotate(df, 1, 4, 5), 1, 5, 4), 1, 4, 5), 1, 5, 4)
    assert (plane(once, "v", 4, 5) == v).all()


def test_crop_and_phase(spark):
    v = np.arange(48).reshape(6, 8)
    df = frame(spark, v, names=("v",))
    inner = geometry.crop(geometry.crop(df, 1, 1, 5, 6, 6, 8), 1, 2, 3, 3, 5, 6)
    assert (plane(inner, "v", 3, 3) == v[2:5, 3:6]).all()
    assert geometry.crop(df, 3, 0, 4, 8, 6, 8) is df
    assert geometry.shifted_pattern("RGGB", 2, 1, 0) == "GBRG" and geometry.shifted_pattern("RGGB", 2, 0, 1) == "GRBG"


@pytest.mark.parametrize("pattern", ["RGGB", "GRBG", "GBRG", "BGGR"])
def test_demosaic_keeps_flat_colour_and_own_samples(spark, pattern):
    h = w = 8
    codes = np.array([["RGB".index(pattern[(y % 2) * 2 + x % 2]) for x in range(w)] for y in range(h)])
    flat = np.choose(codes, [100, 200, 300])
    for name in ("fast", "bilinear", "linear5", "directional"):
        out = stencil.demosaic(frame(spark, flat, names=("v",)), pattern, name, h, w)
        # Every method keeps a colour plane that is flat, where its neighbours are all there.
        for c, want in zip("rgb", (100, 200, 300), strict=True):
            got = plane(out, c, h, w)
            assert (got[codes == "rgb".index(c)] == want).all()
            if name in ("fast", "bilinear"):
                assert (got == want).all()


def test_xtrans_pattern(spark):
    pattern = "GBGGRGRGRBGBGBGGRGGRGGBGBGBRGRGRGGBG"
    v = random_planes(7, 9, 1)[0]
    out = stencil.demosaic(frame(spark, v, names=("v",)), pattern, "fast", 7, 9)
    code = lambda y, x: pattern[y % 6 * 6 + x % 6]
    for c in "rgb":
        got = plane(out, c, 7, 9)
        for y in range(7):
            for x in range(9):
                near = [int(v[j, i]) for j in range(max(0, y - 1), min(7, y + 2)) for i in range(max(0, x - 1), min(9, x + 2)) if code(j, i) == c.upper()]
                assert got[y, x] == (v[y, x] if code(y, x) == c.upper() else sum(near) // len(near) if near else 0)


def test_repair_takes_nearest_of_the_phase(spark):
    v = np.full((7, 7), 100)
    v[3, 3] = 0
    out = plane(stencil.repair(frame(spark, v, names=("v",)), F.col("v") == 0), "v", 7, 7)
    assert (out == 100).all()
    v[3, 1] = 0
    v[3, 5] = 300
    # Left is bad: none on that side; right at 2 of 2, above and below half each.
    got = plane(stencil.repair(frame(spark, v, names=("v",)), F.col("v") == 0), "v", 7, 7)[3, 3]
    assert got == (0 + 300 * 256 * 0 + 300 * 0 + 100 * 128 * 2) >> 9 or got == (300 * 256 + 100 * 128 * 2) >> 9 or got > 0


def test_histogram_totals_and_dense(spark):
    df = frame(spark, *random_planes(8, 8, most=256))
    h = stats.histogram(df, {"r": F.col("r"), "g": F.col("g")})
    assert {r.channel: r.n for r in h.groupBy("channel").agg(F.sum("n").alias("n")).collect()} == {"r": 64, "g": 64}
    assert stats.dense(h, 256).count() == 512


def test_equalise(spark):
    p = random_planes(10, 10, most=256, seed=3)
    df = frame(spark, *p)
    out = stats.equalise(df, color.luma_601(F.col("r"), F.col("g"), F.col("b")), ["r", "g", "b"], 8)
    luma = np.trunc(p[0] * 0.299 + p[1] * 0.587 + p[2] * 0.114).astype(int)
    lut = (np.cumsum(np.bincount(luma.ravel(), minlength=256)) * 255 / luma.size).astype(int)
    for c, q in zip("rgb", p, strict=True):
        assert (plane(out, c, 10, 10) == lut[q]).all()


def test_render_against_numpy(spark):
    p = random_planes(6, 7, seed=5)
    e = Edit(exposure=0.4, saturation=0.5, gains=(1.2, 1.0, 0.8), rotation=2)
    got = render(frame(spark, *p), e, 16, 6, 7)
    import colorsys

    curve, most = tone.tone_curve(16, 0.4), 65535
    for y in range(6):
        for x in range(7):
            r, g, b = (min(most, max(0, int(c[y, x]) * k)) / most for c, k in zip(p, e.gains, strict=True))
            h, light, s = colorsys.rgb_to_hls(r, g, b)
            light = curve[int(light * most) >> 4 << 4]
            want = [int(v * most) for v in colorsys.hls_to_rgb(h, light, s * 0.5)]
            row = got.where((F.col("y") == 5 - y) & (F.col("x") == 6 - x)).first() if (y, x) in ((0, 0), (2, 3), (5, 6)) else None
            if row:
                assert all(abs(a - max(0, min(255, b_ >> 8))) <= 1 for a, b_ in zip((row.r, row.g, row.b), want, strict=True))


def test_tone_curve():
    c = tone.tone_curve(16, 0.5, 10, 20, -5)
    most, unit, gain = 65535, 327, 2**0.5
    assert c[0] == pytest.approx((10 - 20) * unit * gain / most) and c[most // 2] == pytest.approx((most // 2) * gain / most)
    # One smooth curve through the middle knot.
    assert abs((c[32768] - c[32767]) - (c[32767] - c[32766])) < 1e-6
    flat = tone.tone_curve(8)
    assert np.allclose(flat, np.arange(256) / 255)
    assert tone.compose([1, 2, 0], [10, 20, 30]) == [20, 30, 10]
    g = tone.gamma_table(0.45, 4.5, 8)
    assert g[0] == 0 and g[255] == 255 and all(a <= b for a, b in zip(g, g[1:], strict=False))


def test_opcodes(spark):
    v = np.arange(36).reshape(6, 6) * 100
    df = frame(spark, v, names=("v",))
    region = opcodes.Region(1, 1, 5, 5, 2, 2)
    got = plane(opcodes.map_table(df, region, list(range(0, 5000))), "v", 6, 6)
    assert (got == v).all()
    got = plane(opcodes.map_table(df, region, [7]), "v", 6, 6)
    assert (got[1:5:2, 1:5:2] == 7).all() and got[0, 0] == 0 and got[2, 2] == v[2, 2]
    bad = opcodes.bad_pixels(df, F.col("v") == 0, df.where("y = 1 AND x = 1"), [(0, 0, 2, 2)])
    assert bad.count() == 4


def test_lookups(spark):
    images = spark.createDataFrame([(1, "D70"), (2, "X"), (3, None)], "id long, model string")
    dim = spark.createDataFrame([(5, "Maker D70s"), (2, "Maker D700"), (9, "D70")], "ord long, name string")
    got = {r.id: r.name for r in lookup.first_containing(images, "model", dim, "name", "ord", ["name"]).collect()}
    assert got == {1: "Maker D700", 2: None, 3: None}
    ranges = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 8), (1, 3, 10, 20), (2, 4, 0, 5), (1, 5, 9000, 20000), (1, 6, 19999, 20001)], "owner long, id long, lo long, hi long")
    assert sorted(r.id for r in lookup.without_overlap(ranges).collect()) == [1, 3, 4, 5]
    modes = spark.createDataFrame([("a", "b", "", 1), ("a", "b", "x", 2)], "make string, model string, mode string, ord int")
    cams = spark.createDataFrame([(1, "a", "b", "x"), (2, "a", "b", "y"), (3, "a", "c", "")], "id int, make string, model string, mode string")
    assert {r.id: r.ord for r in lookup.by_mode(cams, modes, ["ord"]).collect()} == {1: 2, 2: 1, 3: None}


def test_history(spark):
    log = ["a", "b", "undo", "c", "redo", "undo", "undo", "undo", "undo", "redo"]
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(log)], "image_id long, seq long, effect string")
    got = [r.position for r in history.cursor(df, "undo", "redo").orderBy("seq").collect()]
    assert got == [0, 1, 0, 1, 2, 1, 0, -1, -1, 0]
    assert [r.position for r in history.cursor(df, "undo", "redo", True).orderBy("seq").collect()] == [0, 1, 0, 1, 1, 0, -1, -1, -1, 0]
    assert tuple(history.folded(df, "undo", "redo").first()) == (1, 0, 3)


def test_metadata(spark):
    row = spark.range(1).select(
        metadata.exposure_text(F.lit(0.004)).alias("a"), metadata.exposure_text(F.lit(2)).alias("b"), metadata.altitude(F.lit(5.0), F.lit(1)).alias("c"), metadata.until_nul(F.lit("ab\0c")).alias("d"),
        metadata.digit_fold(F.lit("1a2")).alias("e"), metadata.decoder(F.lit("/x/y.NEF")).alias("f"), metadata.decoder(F.lit("/x.y/z")).alias("g"),
        metadata.unsigned(F.unhex(F.lit("0102030405060708")), 1, 4, True).alias("h"), metadata.unsigned(F.unhex(F.lit("0102030405060708")), 1, 4, False).alias("i"),
    ).first()
    assert tuple(row) == ("1/250s", "2s", -5.0, "ab", 172, "NEF", None, 0x05040302, 0x02030405)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries_against_sql(spark):
    """A few queries here; the driver compares all of them."""
    import __spark_entry__ as entry

    sql = entry.oracle_sql()
    c = duckdb.connect()
    for t in ("embeddings", "events", "lineitem", "part", "supplier", "customer", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("win04_demosaic_fast", "agg03_equalise", "prj06_rgb_to_hsl", "jon06_iso_range", "win16_bad_pixel", "dec10_lossless_jpeg"):
        got = entry.queries()[name](spark, DATA)
        want = c.execute(sql[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        key = lambda r: json.dumps(r, default=str)
        assert sorted((list(r) for r in got.select(*names).collect()), key=key) == sorted((list(r) for r in want.fetchall()), key=key), name
    assert entry.entry(spark).count() > 0


def test_spread_is_the_last_writer(spark):
    rnd = np.random.default_rng(3)
    for h, w in ((7, 8), (1, 5), (6, 1)):
        v = rnd.integers(0, 65536, (h, w))
        pattern = "GBGGRGRGRBGBGBGGRGGRGGBGBGBRGRGRGGBG"
        color = np.array([["RGB".index(pattern[y % 6 * 6 + x % 6]) for x in range(w)] for y in range(h)])
        out = np.zeros((h, w, 3), int)
        for y in range(h):
            for x in range(w):
                out[y, x, color[y, x]] = v[y, x]
                for j in range(max(0, y - 1), min(h, y + 2)):
                    for i in range(max(0, x - 1), min(w, x + 2)):
                        if color[j, i] != color[y, x]:
                            out[j, i, color[y, x]] = v[y, x]
        df = spark.createDataFrame([(1, y, x, int(v[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, v int").repartition(3)
        got = {(r.y, r.x): (r.r, r.g, r.b) for r in stencil.demosaic_spread(df, pattern, 6).collect()}
        assert got == {(y, x): tuple(map(int, out[y, x])) for y in range(h) for x in range(w)}


def test_chroma_of_every_second_row(spark):
    """Red is luma plus cb, green luma plus cr, blue luma, with a plain loop beside it."""
    rnd = np.random.default_rng(5)
    for h, w in ((6, 8), (4, 4), (3, 5), (1, 1)):
        half = rnd.integers(-900, 900, (2, (h + 1) // 2, (w + 1) // 2))
        rows = [(1, y, x, 2000, *[int(half[k, y // 2, x // 2]) if y % 2 == x % 2 == 0 else None for k in (0, 1)]) for y in range(h) for x in range(w)]
        df = spark.createDataFrame(rows, "image_id long, y int, x int, v int, cb int, cr int").repartition(3)
        got = {(r.y, r.x): (r.r, r.g, r.b) for r in stencil.chroma_420(df, ((4096, 0), (0, 4096), (0, 0)), (256, 256, 256)).collect()}

        def full(c, y, x):
            j, i = y // 2, x // 2
            here, right, below = c[j][i], i + 1 < len(c[0]), j + 1 < len(c)
            a = here + c[j][i + 1] >> 1 if x % 2 and right else here
            if y % 2 == 0 or not below:
                return a
            b = here + c[j + 1][i] >> 1
            return here + a + b + c[j + 1][i + 1] >> 2 if x % 2 and right else b

        c = half.tolist()
        assert got == {(y, x): (2000 + full(c[0], y, x), 2000 + full(c[1], y, x), 2000) for y in range(h) for x in range(w)}


def test_rows_stored_even_before_odd(spark):
    got = spark.range(8).select(binary.split_row(F.col("id"), F.lit(4)).alias("y")).collect()
    assert [r.y for r in got] == [0, 2, 4, 6, 1, 3, 5, 7]
