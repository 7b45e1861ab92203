import struct

import pytest

from prismlake.operators import dither
from prismlake.sources import raw, slices, vendors


def test_fuji(spark):
    tags = struct.pack(">I", 2) + struct.pack(">HHHH", 0x100, 4, 3000, 4000) + struct.pack(">HH", 0x131, 3) + b"abc"
    header = b"FUJIFILMCCD-RAW ".ljust(84, b"\0") + struct.pack(">IIIIII", 1, 2, 120, len(tags), 500, 600)
    df = spark.createDataFrame([("a", bytearray(header.ljust(120, b"\0") + tags))], "path string, content binary")
    assert tuple(df.select(*vendors.raf_header(df["content"])).first()) == (1, 2, 120, len(tags), 500, 600)
    assert [(r.tag, r.size, r.a, r.b) for r in vendors.raf_tags(df).collect()] == [(0x100, 4, 3000, 4000), (0x131, 3, 24930, 99)]


def test_heap():
    inner = b"xy" + struct.pack("<H", 1) + struct.pack("<HII", 0x0805, 2, 0) + struct.pack("<I", 2)
    body = inner + b"camera"
    entries = struct.pack("<H", 3) + struct.pack("<HII", 0x300A, len(inner), 0) + struct.pack("<HII", 0x080A, 6, len(inner)) + struct.pack("<H", 0x5029) + b"12345678"
    heap = body + entries + struct.pack("<I", len(body))
    data = b"II" + struct.pack("<I", 14) + b"HEAPCCDR" + heap
    got = list(vendors.heap_entries(data))
    assert got == [(0, -1, 0x300A, b""), (1, 0, 0x0805, b"xy"), (0, -1, 0x080A, b"camera"), (0, -1, 0x1029, b"12345678")]
    with pytest.raises(ValueError):
        list(vendors.heap_entries(data[:20]))


def test_camera_list(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<Cameras><Camera make="A" model="B"><Sensor black="10" white="4000"/><Sensor black="12" white="4095" iso_min="800" iso_max="1600"/></Camera><Camera make="C" model="D" mode="s" supported="no"/></Cameras>')
    rows = sorted(map(tuple, vendors.cameras(spark, str(tmp_path / "c.xml")).collect()), key=str)
    assert rows == [("A", "B", "", 0, 10, 4000, 0, 0, True), ("A", "B", "", 1, 12, 4095, 800, 1600, True), ("C", "D", "s", None, None, None, 0, 0, False)]


def test_dither_stays_near_the_table(spark):
    table = [i * 4 for i in range(1000)]
    df = spark.createDataFrame([(1, y, x, (x * 37 + y) % 1000) for y in range(4) for x in range(200)], "image_id long, y int, x int, v int")
    out = {(r.y, r.x): r.v for r in dither.dithered(df, table).collect()}
    off = [out[y, x] - table[(x * 37 + y) % 1000] for y in range(4) for x in range(200)]
    assert max(map(abs, off)) <= 2 * 4 and len(set(off)) > 1
    again = {(r.y, r.x): r.v for r in dither.dithered(df.repartition(5), table).collect()}
    assert out == again


def test_olympus_strips_are_uncompressed(spark):
    v = [[(y * 211 + x * 97) % 4096 for x in range(4)] for y in range(4)]
    packed = lambda rows: b"".join(int("".join(f"{p:012b}" for p in r), 2).to_bytes(6, "big") for r in rows)
    data = {
        "little": b"".join(struct.pack("<4H", *[p << 4 for p in r]) for r in v), "big": b"".join(struct.pack(">4H", *[p << 4 for p in r]) for r in v),
        "interlaced": packed(v[::2]).ljust(2048, b"\0") + packed(v[1::2]), "short": bytes(20),
    }
    files = spark.createDataFrame([(k, bytearray(b"12345678" + d)) for k, d in data.items()], "path string, content binary")
    rows = []
    for k, d in data.items():
        # Two strips; the interlaced file is given the bytes of its samples only, as far as the form goes.
        total = 24 if k == "interlaced" else len(d)
        for tag, nums, text in ((256, [4], None), (257, [4], None), (259, [1], None), (271, [], "OLYMPUS IMAGING"), (273, [8, 8 + total // 2], None), (278, [2], None), (279, [total // 2] * 2, None)):
            rows.append((k, 0, tag, [float(x) for x in nums], text, len(rows), None, k != "big"))
    tags = spark.createDataFrame(rows, "path string, ifd_id int, tag int, nums array<double>, text string, preorder int, error string, little boolean")
    s = raw.raw_slices(files, tags)
    assert {r.path: (r.codec, r.h, r.w) for r in s.collect()} == {"little": ("words", 4, 4), "big": ("words", 4, 4), "interlaced": ("interlaced", 4, 4), "short": ("olympus of unknown form", 4, 4)}
    got = slices.decode(s).join(s.select("image_id", "path"), "image_id").collect()
    for k in ("little", "big"):
        assert sorted((r.y, r.x, r.v) for r in got if r.path == k) == [(y, x, v[y][x]) for y in range(4) for x in range(4)]
    assert [r.error is not None for r in got if r.path == "short"] == [True]


def test_sony_forms_go_by_the_size(spark):
    v = [[(y * 211 + x * 97) % 4096 for x in range(4)] for y in range(4)]
    pairs = [(r[k], r[k + 1]) for r in v for k in (0, 2)]
    packed = b"".join(bytes([a & 255, a >> 8 | (b & 15) << 4, b >> 4]) for a, b in pairs)
    data = {"packed": (12, packed), "blocks": (8, bytes(16)), "sums": (12, bytes([0x55]) * 64), "other": (10, bytes(20))}
    files = spark.createDataFrame([(k, bytearray(b"12345678" + d)) for k, (_, d) in data.items()], "path string, content binary")
    rows = []
    for k, (bits, d) in data.items():
        for tag, nums, text in ((256, [4], None), (257, [4], None), (258, [bits], None), (259, [32767], None), (271, [], "SONY "), (273, [8], None), (278, [4], None), (279, [len(d)], None)):
            rows.append((k, 0, tag, [float(x) for x in nums], text, len(rows), None, True))
    tags = spark.createDataFrame(rows, "path string, ifd_id int, tag int, nums array<double>, text string, preorder int, error string, little boolean")
    s = raw.raw_slices(files, tags)
    assert {r.path: (r.codec, r.h, r.w) for r in s.collect()} == {"packed": ("packed", 4, 4), "blocks": ("blocks16", 4, 4), "sums": ("column_sum", 12, 4), "other": ("sony of unknown form", 4, 4)}
    got = slices.decode(s).join(s.select("image_id", "path"), "image_id").collect()
    assert sorted((r.y, r.x, r.v) for r in got if r.path == "packed") == [(y, x, v[y][x]) for y in range(4) for x in range(4)]
    # 01 01 01 ...: a length of 3, of which the next bit (0) keeps three bits: 3 of 0b101 = 5, and again from the next bits.
    sums = {(r.y, r.x): r.v for r in got if r.path == "sums"}
    assert len(sums) == 48 and sums[0, 3] == 5
    assert [r.error is not None for r in got if r.path == "other"] == [True]
