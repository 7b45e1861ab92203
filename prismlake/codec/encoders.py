"""Encoders for the lossless forms, the inverse of the decoders."""

from __future__ import annotations

import numpy as np

from .bits import BitWriter, PrefixCode, flat_code, pack
from .decoders import AdaptiveLane, predicted


def packed(rows: np.ndarray, o: dict) -> bytes:
    return pack(rows.ravel(), o.get("bits", 12), o.get("order", "msb"))


def packbits(rows: np.ndarray, o: dict) -> bytes:
    raw, out, at = rows.astype(np.uint8).tobytes(), bytearray(), 0
    while at < len(raw):
        run = 1
        while run < 128 and raw[at + run : at + run + 1] == raw[at : at + 1]:
            run += 1
        if run > 1:
            out += bytes([257 - run, raw[at]])
            at += run
            continue
        end = at + 1
        while end < len(raw) and end - at < 128 and raw[end : end + 1] != raw[end + 1 : end + 2]:
            end += 1
        out += bytes([end - at - 1]) + raw[at:end]
        at = end
    return bytes(out)


def two_lane(rows: np.ndarray, o: dict) -> bytes:
    d = rows.astype(np.int64).copy()
    d[:, 2:] = rows[:, 2:] - rows[:, :-2]
    d[2:, :2] = rows[2:, :2] - rows[:-2, :2]
    w, code = BitWriter(o.get("order", "msb")), PrefixCode(*o["tree"]) if o.get("tree") else flat_code()
    for v in d.ravel():
        code.write_difference(w, int(v))
    return w.bytes()


def column_sum(rows: np.ndarray, o: dict) -> bytes:
    w, last, height = BitWriter(), 0, len(rows)
    order = [*range(0, height, 2), *range(1, height, 2)]
    for x in range(rows.shape[1] - 1, -1, -1):
        for y in order:
            d = int(rows[y, x]) - last
            last = int(rows[y, x])
            n = abs(d).bit_length()
            if n in (0, 3):
                w.write(1, 2)
                w.write(int(n == 0), 1)
            elif n < 3:
                w.write(4 - n, 2)
            else:
                w.write(0, 2)
                w.write(0, n - 4)
                if n < 17:
                    w.write(1, 1)
            if n:
                w.write(d if d >= 0 else d + (1 << n) - 1, n)
    return w.bytes()


def adaptive(rows: np.ndarray, o: dict) -> bytes:
    w = BitWriter()
    for y in range(len(rows)):
        lanes = (AdaptiveLane(), AdaptiveLane())
        for x in range(rows.shape[1]):
            lane = lanes[x & 1]
            n, v = lane.width(), int(rows[y, x]) - predicted(rows, y, x)
            e = (v >> 2) - lane.mean
            size = e if e >= 0 else ~e
            lane.step(size, e < 0)
            w.write(int(e < 0) << 2 | v & 3, 3)
            if size >> n < 12:
                w.write(1, (size >> n) + 1)
            else:
                w.write(0, 12)
                w.write(size >> n << 1, 16 - n)
            w.write(size & ((1 << n) - 1), n)
    return bytes(o.get("skip", 7)) + w.bytes()


def lossless_jpeg(rows: np.ndarray, o: dict) -> bytes:
    """One component, or n side by side."""
    n, depth = o.get("components", 1), o.get("bits", 16)
    height, width = rows.shape[0], rows.shape[1] // n
    v = rows.astype(np.int64).reshape(height, width, n)
    d = v.copy()
    d[:, 1:] -= v[:, :-1]
    d[1:, 0] -= v[:-1, 0]
    d[0, 0] -= 1 << (depth - 1)
    code = PrefixCode([0, 0, 0, 0, 17] + [0] * 11, list(range(17)))
    w = BitWriter("jpeg")
    for x in d.ravel():
        code.write_difference(w, int(x))

    def part(kind: int, body: bytes) -> bytes:
        return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body

    table = part(0xC4, bytes([0]) + bytes([0, 0, 0, 0, 17] + [0] * 11) + bytes(range(17)))
    frame = part(0xC3, bytes([depth]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n)))
    scan = part(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + bytes([1, 0, 0]))
    return b"\xff\xd8" + table + frame + scan + w.bytes() + b"\xff\xd9"


ENCODERS = {"packed": packed, "packbits": packbits, "two_lane": two_lane, "column_sum": column_sum, "adaptive": adaptive, "lossless_jpeg": lossless_jpeg}
