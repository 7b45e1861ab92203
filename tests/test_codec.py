import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismlake.codec import bits, decoders, trees
from prismlake.codec.bits import BitReader, PrefixCode
from prismlake.codec.decoders import DECODERS, PanasonicBits, decrypt, key_stream
from prismlake.codec.encoders import ENCODERS
from prismlake.functions import binary
from prismlake.plans.codec_queries import Q
from prismlake.sources import bitmaps, sinks, slices, tiff

FORMS = [("packed", 4096, {"bits": 12, "order": o}) for o in ("msb", "lsb", "msb16", "msb32")]
FORMS += [("packbits", 256, {}), ("two_lane", 65536, {}), ("column_sum", 4096, {}), ("lossless_jpeg", 65536, {"components": 2})]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(FORMS), st.sampled_from([(2, 4), (5, 8), (8, 20)]))
def test_round_trip(seed, form, shape):
    name, most, o = form
    if name == "packed" and shape[0] * shape[1] * 12 % 32:
        shape = (8, 8)
    v = np.random.default_rng(seed).integers(0, most, shape)
    assert (DECODERS[name](ENCODERS[name](v, o), *shape, o) == v).all()


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 50, 2000]))
def test_adaptive_round_trip(seed, step):
    v = np.clip(np.cumsum(np.random.default_rng(seed).integers(-step, step + 1, (9, 14)), axis=1) + 2000, 0, 4095)
    assert (DECODERS["adaptive"](ENCODERS["adaptive"](v, {}), 9, 14, {}) == v).all()


def test_known_bytes():
    assert DECODERS["packbits"](b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\xf7\xaa", 1, 24, {}).ravel().tolist() == [0xAA] * 3 + [0x80, 0, 0x2A] + [0xAA] * 4 + [0x80, 0, 0x2A, 0x22] + [0xAA] * 10
    assert bits.unpack(bytes([0xAB, 0xCD, 0xEF]), 12, 2)[0].tolist() == [0xABC, 0xDEF]
    assert bits.unpack(bytes([0xAB, 0xCD, 0xEF]), 12, 2, "lsb")[0].tolist() == [0xDAB, 0xEFC]
    values, short = bits.unpack(b"\xff", 4, 5)
    assert values.tolist() == [15, 15, 0, 0, 0] and short == 3
    assert DECODERS["words"](b"\x12\x34\x56\x78", 1, 2, {"big": True, "bits": 14}).tolist() == [[0x1234, 0x1678]]
    code = bits.PrefixCode([0, 1, 5, 1] + [0] * 12, [4, 3, 5, 2, 6, 1, 0])
    w = bits.BitWriter()
    for d in (0, 1, -1, 5, -6, 30):
        code.write_difference(w, d)
    r = bits.BitReader(w.bytes())
    assert [code.difference(r) for _ in range(6)] == [0, 1, -1, 5, -6, 30]
    assert bits.ordered(b"\x01\xff\x00\x02\xff\xd9\x07", "jpeg") == b"\x01\xff\x02"


def test_blocks_of_sixteen():
    top, low, at_top, at_low = 900, 400, 3, 9
    steps = list(range(14))
    v, at = top | low << 11 | at_top << 22 | at_low << 26, 30
    for s in steps:
        v |= s << at
        at += 7
    out = DECODERS["blocks16"](v.to_bytes(16, "little") * 2, 1, 32, {})
    shift, rest = 2, iter(steps)  # 0x80 << 2 is the first above 500
    want = [top if i == at_top else low if i == at_low else (next(rest) << shift) + low for i in range(16)]
    assert out[0, ::2].tolist() == [2 * p for p in want] == out[0, 1::2].tolist()


def test_blocks_of_fourteen():
    """All steps zero: the first value of a lane stays."""
    out = DECODERS["blocks14"](bytes(0x4000), 1, 28, {})
    assert out.shape == (1, 28) and (out == 0).all()
    noisy = DECODERS["blocks14"](np.random.default_rng(1).integers(0, 256, 0x8000, dtype=np.uint8).tobytes(), 40, 28, {})
    assert ((noisy >= 0) & (noisy < 65536)).all() and noisy.std() > 0


def test_cipher_undoes_itself():
    data = bytes(range(256)) * 2 + b"end"
    assert decrypt(decrypt(data, 12345), 12345) == data != decrypt(data, 12345)
    assert len(set(key_stream(1, 300).tolist())) > 290


def test_native_unpack(spark):
    data = bytes(np.random.default_rng(2).integers(0, 256, 40, dtype=np.uint8))
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    for n in (1, 7, 10, 12, 14, 16, 24):
        for little in (False, True):
            got = df.select(binary.unpack(F.col("b"), n, 10, little)).first()[0]
            raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little" if little else "big")[: 10 * n].reshape(10, n)
            want = [int("".join(map(str, r[::-1] if little else r)), 2) for r in raw]
            assert got == want


def test_slices_report_errors(spark):
    df = spark.createDataFrame([(1, y, x, (y * 31 + x * 7) % 4096) for y in range(8) for x in range(6)], "image_id long, y int, x int, v int")
    s = slices.encode(df, 4, "lossless_jpeg")
    out = slices.decode(s).where("error IS NULL").select("image_id", "y", "x", "v")
    assert sorted(out.collect()) == sorted(df.collect())
    bad = slices.decode(s.withColumn("data", F.substring("data", 5, 10)))
    assert bad.where("error IS NOT NULL").count() == 2


@pytest.mark.parametrize("little", [True, False])
def test_tiff_files(spark, tmp_path, little):
    rgb = np.random.default_rng(3).integers(0, 65536, (5, 4, 3)).astype(np.uint16)
    (tmp_path / "a.TIF").write_bytes(sinks.tiff(rgb, little))
    (tmp_path / "b.tif").write_bytes(b"II*\0 broken")
    (tmp_path / "c.txt").write_bytes(b"text")
    files = tiff.read_files(spark, str(tmp_path), ["tif", "tiff"])
    assert files.count() == 2
    tags = tiff.read_tags(files)
    assert tags.where("error IS NOT NULL").count() == 1
    good = tags.where("path LIKE '%a.TIF'")
    assert {r.tag: r.nums[0] for r in good.collect()}[256] == 4
    v = {(r.y, r.x): r.v for r in slices.decode(tiff.strips(files, tags)).collect()}
    assert v == {(y, x): int(rgb.reshape(5, 12)[y, x]) for y in range(5) for x in range(12)}


def directory(entries, nxt, order="<"):
    import struct

    out = struct.pack(f"{order}H", len(entries))
    for tag, kind, count, value in entries:
        out += struct.pack(f"{order}HHI", tag, kind, count) + (value if isinstance(value, bytes) else struct.pack(f"{order}I", value))
    return out + struct.pack(f"{order}I", nxt)


def test_directory_trees():
    import struct

    # Main directory at 8 with a sub-directory, a repeated tag, a bad offset, and a second one in the chain.
    main = directory([(256, 4, 1, 640), (256, 4, 1, 1), (271, 2, 6, 200), (0x8769, 4, 1, 100), (33434, 5, 1, 99999)], 140)
    exif = directory([(33434, 5, 1, 210)], 0)
    second = directory([(254, 4, 1, 1)], 0)
    data = (b"II*\0" + struct.pack("<I", 8) + main).ljust(100, b"\0") + exif
    data = (data.ljust(140, b"\0") + second).ljust(200, b"\0") + b"Maker\0" + b"\0" * 4 + struct.pack("<II", 1, 250)
    rows = list(tiff.walk(data))
    by = {(r["ifd_id"], r["tag"]): r for r in rows}
    assert by[0, 256]["nums"] == [640.0] and len([r for r in rows if (r["ifd_id"], r["tag"]) == (0, 256)]) == 1
    assert by[0, 271]["text"] == "Maker" and by[0, 33434]["error"]
    assert by[1, 33434]["nums"] == [1 / 250] and by[1, 33434]["parent_id"] == 0 and by[1, 33434]["kind"] == "exif"
    assert by[2, 254]["nums"] == [1.0] and by[2, 254]["depth"] == 0
    for bad in (b"", b"XX", b"II\0\0\0\0\0\0", b"II*\0\xff\xff\xff\x7f"):
        with pytest.raises(ValueError):
            list(tiff.walk(bad))


def test_writers(spark):
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert sinks.ppm(rgb).split()[:4] == [b"P3", b"4", b"2", b"255"]
    assert sinks.bmp(rgb)[54:57] == bytes([14, 13, 12]) and len(sinks.bmp(rgb)) == 54 + 24
    import zlib

    png = sinks.png(rgb)
    at = png.index(b"IDAT")
    raw = zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")])
    assert raw == b"".join(b"\0" + rgb[y].tobytes() for y in range(2))
    df = spark.createDataFrame([(1, y, x, 256, 512, 65535) for y in range(2) for x in range(3)], "image_id long, y int, x int, r int, g int, b int")
    assert sinks.files(df, "ppm", 16).first().content.split()[4:7] == [b"1", b"2", b"255"]
    with pytest.raises(ValueError):
        sinks.files(df, "xyz", 16)


def test_queries_decode_whole_texts(spark, tmp_path):
    rnd = np.random.default_rng(4)
    texts = ["", "a", "é", *["".join(map(chr, rnd.integers(32, 300, n))) for n in (39, 40, 41, 700, 12_000, 50_000)]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    raw = {k: t.encode() for k, t in enumerate(texts)}

    def got(name):
        return {r.doc_id: (r.n, r.s) for r in Q[name](spark, str(tmp_path)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((F.col("i") % 997 + 1) * F.col("v")).alias("s")).collect()}

    def digest(v):
        return len(v), int(((np.arange(len(v)) % 997 + 1) * v).sum())

    for name, n, little in (("dec01_unpack7", 7, False), ("dec02_unpack8", 8, False), ("dec03_unpack10", 10, False), ("dec04_unpack12", 12, False), ("dec04_unpack12_le", 12, True), ("dec05_unpack14", 14, False), ("dec05_unpack16", 16, False)):
        want = {}
        for k, b in raw.items():
            row = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little" if little else "big")
            row = row[: len(row) // n * n].reshape(-1, n).astype(np.int64)
            if len(row):
                want[k] = digest(row @ (1 << np.arange(n) if little else 1 << np.arange(n)[::-1]))
        assert got(name) == want, name
    want = {}
    for k, b in raw.items():
        key, step, out = 17, 96, []
        for c in b:
            key, step = (key + 91 * step) & 255, step + 1
            out.append(c ^ key)
        if out:
            want[k] = digest(np.array(out))
    assert got("dec19_key_xor") == want
    for name, codec, width in (("dec17_blocks16", "blocks16", 64), ("dec14_blocks14", "blocks14", 28)):
        have = {r.image_id: r.s for r in Q[name](spark, str(tmp_path)).groupBy("image_id").agg(F.sum((F.col("y") % 997 + 1) * (F.col("x") + 1) * F.col("v")).alias("s")).collect()}
        for k, b in raw.items():
            # A frame that is higher than the text: what lies beyond is zero bytes, which say the same for every height.
            rows = -(-len(b) // 64) if codec == "blocks16" else -(-len(b) // 0x4000) * 512
            v = DECODERS[codec](b, rows, width, {}).astype(np.int64)
            assert have.get(k, 0) == int((v * (np.arange(rows) % 997 + 1)[:, None] * (np.arange(width) + 1)).sum())
            if rows and codec == "blocks16":
                assert not DECODERS[codec](b, rows + 3, width, {})[rows:].any()
            if rows and codec == "blocks14":
                bits = PanasonicBits(b, 0x2008)
                for _ in range(rows * 2 * 16):
                    bits.read(8)
                assert bits.block == -(-len(b) // 0x4000) - 1 and not bits.left


def test_rows_of_unpacked_numbers_are_compiled(spark, tmp_path):
    """F7, F8: what unpack gives, as rows, without functions over arrays (they are interpreted, element by element)."""
    texts = [bytes(np.random.default_rng(k).integers(0, 256, n, dtype=np.uint8)) for k, n in enumerate((0, 1, 6, 7, 8, 50, 211))]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id int, b binary")
    for n in (3, 7, 8, 10, 12, 14, 16, 17, 24):
        for little in (False, True):
            for count in (None, F.col("id") * 9):
                rows = binary.unpack_rows(df, "b", n, count, little).collect()
                want = {(r.id, i): v for r in df.select("id", binary.unpack(F.col("b"), n, count, little).alias("v")).collect() for i, v in enumerate(r.v or [])}
                assert len(rows) == len(want) and {(r.id, r.i): r.v for r in rows} == want
    spark.createDataFrame([(k, "text") for k in range(40)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("dec01_unpack7", "dec02_unpack8", "dec03_unpack10", "dec04_unpack12", "dec04_unpack12_le", "dec05_unpack14", "dec05_unpack16", "dec19_key_xor", "dec22_split_rows"):
        out = Q[name](spark, str(tmp_path))
        assert "lambda" not in out._jdf.queryExecution().executedPlan().toString(), name
        assert name == "dec22_split_rows" or out.groupBy(F.spark_partition_id()).count().count() == 4, name


def plain_blocks14(data, height, width):
    """Block by block and bit by bit."""
    bits, out = PanasonicBits(data, 0x2008), np.zeros((height, width), np.int64)
    for y in range(height):
        for x in range(0, width // 14 * 14, 14):
            value, seen, scale = [0, 0], [0, 0], 0
            for i in range(14):
                lane = i & 1
                if i % 3 == 2:
                    scale = 4 >> (3 - bits.read(2))
                if seen[lane]:
                    step = bits.read(8)
                    if step:
                        value[lane] -= 0x80 << scale
                        if value[lane] < 0 or scale == 4:
                            value[lane] &= (1 << scale) - 1
                        value[lane] += step << scale
                else:
                    seen[lane] = bits.read(8)
                    if seen[lane] or i > 11:
                        value[lane] = seen[lane] << 4 | bits.read(4)
                out[y, x + i] = value[lane] & 0xFFFF
    return out


def test_blocks14_all_at_once_as_one_by_one():
    r = np.random.default_rng(14)
    for n, height, width in ((0, 3, 28), (5000, 40, 28), (0x4000, 512, 28), (40000, 90, 100), (300, 4, 13)):
        for b in (r.integers(0, 256, n), r.integers(0, 256, n) * (r.random(n) < 0.2), r.integers(0, 3, n)):
            data = b.astype(np.uint8).tobytes()
            assert (DECODERS["blocks14"](data, height, width, {}) == plain_blocks14(data, height, width)).all()


def plain_blocks16(data, height, width):
    """Row by row and sample by sample."""
    out = np.zeros((height, width), np.int64)
    for y in range(height):
        row, start = int.from_bytes(data[y * width : (y + 2) * width], "little"), 0
        for k in range(width // 16):
            v = row >> start & (1 << 135) - 1
            top, low, at_top, at_low = v & 0x7FF, v >> 11 & 0x7FF, v >> 22 & 15, v >> 26 & 15
            shift = next((s for s in range(4) if 0x80 << s > top - low), 4)
            rest = iter(range(30, 135, 7))
            for i in range(16):
                p = top if i == at_top else low if i == at_low else min(0x7FF, ((v >> next(rest) & 127) << shift) + low)
                if 32 * (k // 2) + k % 2 + 2 * i < width:
                    out[y, 32 * (k // 2) + k % 2 + 2 * i] = p << 1
            start += 135 if at_top == at_low else 128
    return out


def test_blocks16_of_a_long_text_in_little_time():
    """all rows at once give what row by row gives, in a fraction of the time."""
    r = np.random.default_rng(16)
    for n, height, width in ((0, 3, 64), (700, 40, 64), (4096, 64, 64), (900, 9, 100), (900, 9, 48), (300, 4, 13)):
        for b in (r.integers(0, 256, n), r.integers(32, 127, n), r.integers(0, 2, n)):
            data = b.astype(np.uint8).tobytes()
            assert (DECODERS["blocks16"](data, height, width, {}) == plain_blocks16(data, height, width)).all()
    data, took = r.integers(0, 256, 200_000, dtype=np.uint8).tobytes(), []
    for f in (plain_blocks16, lambda *a: DECODERS["blocks16"](*a, {})):
        began = time.process_time()
        f(data, 3125, 64)
        took.append(time.process_time() - began)
    assert 3 * took[1] < took[0]


def test_texts_of_one_file_are_decoded_by_many_tasks(spark, tmp_path):
    """one row group went to one task, whatever it grew to."""
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("dec14_blocks14", "dec17_blocks16"):
        out = Q[name](spark, str(tmp_path))
        tasks = out.groupBy(F.spark_partition_id()).agg(F.countDistinct("image_id").alias("n")).collect()
        assert len(tasks) == 4 and sum(t.n for t in tasks) == 40, name


def test_slices_in_pieces_and_errors(spark, monkeypatch):
    """Slices of several pieces, of no rows, of an offset and a broken one in one batch."""
    monkeypatch.setattr(slices, "PIECE", 10)
    rows = [(1, 0, 5, 7, 9, 4, "packed", '{"bits": 8}', bytes(range(36))), (1, 1, 0, 0, 0, 4, "packed", "{}", b""), (2, 0, 0, 0, 1, 1, "none", "{}", b""), (3, 0, 2, 1, 2, 30, "packed", None, b"abc")]
    out = slices.decode(spark.createDataFrame(rows, slices.SLICE).coalesce(1)).collect()
    assert {(r.y, r.x): r.v for r in out if r.image_id == 1} == {(5 + k // 4, 7 + k % 4): k for k in range(36)}
    assert [tuple(r) for r in out if r.image_id == 2] == [(2, 0, None, None, None, "KeyError: 'none'")]
    assert sorted((r.y, r.x, r.error) for r in out if r.image_id == 3) == [(y, x, None) for y in (2, 3) for x in range(1, 31)]


def test_blocks16_with_one_place_for_both():
    """A block whose largest and smallest share a place has 15 steps and moves what follows by 7 bits."""
    one = 700 | 600 << 11 | 5 << 22 | 5 << 26 | sum((k + 1) << 30 + 7 * k for k in range(15))
    two = 500 | 480 << 11 | 0 << 22 | 1 << 26 | sum((k + 1) << 30 + 7 * k for k in range(14))
    out = DECODERS["blocks16"]((one | two << 135).to_bytes(33, "little")[:32], 1, 32, {})
    assert out[0, ::2].tolist() == [2 * (700 if i == 5 else 601 + i - (i > 5)) for i in range(16)]
    assert out[0, 1:28:2].tolist() == [1000, 960, *[2 * (481 + k) for k in range(12)]]


def test_named_codes_give_known_numbers():
    """Bytes worked out by hand: symbol 5 is 00, 4 is 010, 0x39 is 00 in the lower part."""
    code = PrefixCode(*trees.TREES["12 lossy"])
    # 5: 00 and five bits 10011 -> 19; 4: 010 and 0011 -> 3 - 15 = -12; 0: 11110 and nothing.
    bits = BitReader(int("00" "10011" "010" "0011" "11110" "00000", 2).to_bytes(3, "big"))
    assert code.code[5] == (0, 2) and code.code[4] == (2, 3) and code.code[0] == (0b11110, 5)
    assert [code.difference(bits) for _ in range(3)] == [19, -12, 0]
    # 0x39: nine bits of which three aren't sent: 110101 -> (2 * 53 + 1) * 8 / 2 = 428; 010101 -> (2 * 21 + 1) * 4 - 512 = -340.
    low = PrefixCode(*trees.TREES["12 lossy, lower part"])
    bits = BitReader(int("00" "110101" "00" "010101", 2).to_bytes(2, "big"))
    assert [low.difference(bits) for _ in range(2)] == [428, -340]
    for counts, symbols in trees.TREES.values():
        assert sum(counts) == len(symbols) and sum(n / 2**k for k, n in enumerate(counts, 1)) <= 1


def test_linearisation_tables():
    import struct

    head = struct.pack(">BB4h", 70, 48, 1, -2, 3, -4)
    o = trees.lane_options(head + struct.pack(">H", 0), 14, False)
    assert o == {"tree": trees.TREES["14 lossless"], "start": [[1, 3], [-2, -4]], "curve": 1 << 14}
    # Five points over 4096 values: 1024 apart, joined by straight lines.
    table = (struct.pack("<BB4h", 68, 32, 0, 0, 0, 0) + struct.pack("<H5H", 5, 0, 100, 400, 900, 1600)).ljust(562, b"\0") + struct.pack("<H", 7)
    o = trees.lane_options(table, 12, True)
    assert o["split"] == 7 and o["then"] == trees.TREES["12 lossy, lower part"] and len(o["curve"]) == 4096
    assert [o["curve"][k] for k in (0, 512, 1024, 1536, 2048, 4095)] == [0, 50, 100, 250, 400, 1599]
    o = trees.lane_options(struct.pack("<BB4h", 68, 16, 0, 0, 0, 0) + struct.pack("<H3H", 3, 5, 6, 9), 12, True)
    assert o["curve"] == [5, 6, 9] and "split" not in o


def test_noise_of_curves():
    """By hand: entry 10 lies 1 below 20's middle step; the chain is 15700 * low half + high half."""
    curve, state, want = [0, 10, 30, 60], 0x123456, []
    samples = [1, 2, 3, 9, 0]
    for v in samples:
        k = min(v, 3)
        low, high = curve[max(0, k - 1)], curve[min(3, k + 1)]
        delta = high - low if v < 4 else 0
        base = curve[k] - (high - low + 2) // 4 if v < 4 else 60
        want.append(max(0, base + ((delta * (state & 2047) + 1024) >> 12)))
        state = (15700 * (state & 65535) + (state >> 16)) & 0xFFFFFFFF
    assert trees.through_curve(np.array(samples), curve, 0x123456).tolist() == want


def test_code_of_a_pentax_file():
    import struct

    # Four codes 0, 10, 110, 111 for symbols 2, 0, 1, 3; the word says 4 after 12 is added, modulo 16.
    table = struct.pack(">H", 8) + bytes(12) + struct.pack(">4H", 0b10 << 10, 0b110 << 9, 0, 0b111 << 9) + bytes([2, 3, 1, 3])
    counts, symbols = trees.tree_of_codes(table, False)
    assert counts[:4] == [1, 1, 2, 0] and symbols == [2, 0, 1, 3]
    v = np.arange(24).reshape(4, 6) * 3 % 7
    o = {"tree": trees.TREES["pentax"]}
    assert (DECODERS["two_lane"](ENCODERS["two_lane"](v, o), 4, 6, o) == v).all()


def test_pieces_of_rows():
    """Two pieces of two samples and one of three, over three rows."""
    image = np.arange(21).reshape(3, 7)
    run = np.concatenate([image[:, :2].ravel(), image[:, 2:4].ravel(), image[:, 4:].ravel()])
    assert (decoders.unsliced(run, [2, 2, 3], 3, 3, 7) == image).all()


def test_makers_tables_reach_the_decoder(spark):
    import struct

    from prismlake.sources import raw

    row = lambda make, how, linear=None, codes=None, pieces=None: (make, how, 12, linear and (linear, True), codes and (codes, False), pieces, "{}")
    table = struct.pack("<BB4h", 70, 48, 0, 0, 0, 0) + struct.pack("<H", 0)
    rows = [row("NIKON", 34713, table), row("PENTAX", 65535), row("Canon", 6, None, None, [2.0, 4.0, 3.0]), row("Canon", 6), row(None, 1)]
    df = spark.createDataFrame(rows, "make string, compression int, bits int, linear struct<bytes:binary,little:boolean>, codes struct<bytes:binary,little:boolean>, pieces array<double>, plain string")
    got = [json.loads(r.o) for r in df.select(raw.maker_options(*df.columns).alias("o")).collect()]
    assert got[0]["tree"] == [list(x) for x in trees.TREES["12 lossless"]] and got[0]["curve"] == 4096
    assert got[1:] == [{"tree": [list(x) for x in trees.TREES["pentax"]]}, {"slices": [4, 4, 3]}, {}, {}]


def test_bitmaps(spark):
    import struct
    import zlib

    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)

    def png(rows, head, *more):
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return bitmaps.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    # One row with each filter, by the definition of the format.
    flat, rows = rgb.reshape(5, 21).astype(int), b""
    for y, how in enumerate((0, 1, 2, 3, 4)):
        line = []
        for k in range(21):
            a = flat[y, k - 3] if k >= 3 else 0
            b = flat[y - 1, k] if y else 0
            c = flat[y - 1, k - 3] if y and k >= 3 else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((flat[y, k] - (0, a, b, (a + b) // 2, paeth)[how]) % 256)
        rows += bytes([how, *line])
    palette = bytes(range(12))
    files = {
        "filters": png(rows, (7, 5, 8, 2, 0, 0, 0)), "own": sinks.png(rgb), "bmp": sinks.bmp(rgb),
        "palette": png(b"\0\x1b\0\xe4", (4, 2, 2, 3, 0, 0, 0), (b"PLTE", palette)), "broken": sinks.png(rgb)[:-20], "other": b"GIF89a", "none": None,
    }
    got = {}
    for r in bitmaps.pixels(spark.createDataFrame(list(files.items()), "path string, content binary")).collect():
        got.setdefault(r.path, {})[r.y, r.x] = r.error or (r.r, r.g, r.b)
    want = {(y, x): tuple(map(int, rgb[y, x])) for y in range(5) for x in range(7)}
    assert got["filters"] == got["own"] == got["bmp"] == want
    colours = [tuple(palette[3 * k : 3 * k + 3]) for k in range(4)]
    assert got["palette"] == {(y, x): colours[x if y == 0 else 3 - x] for y in range(2) for x in range(4)}
    assert all(isinstance(got[n][None, None], str) for n in ("broken", "other", "none"))
