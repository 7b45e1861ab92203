"""Decoders of sensor data: bytes of one slice to rows of samples.

Each takes (data, height, width, options) and returns an array of 16-bit numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .bits import BitReader, PrefixCode, flat_code, unpack
from .trees import first_bits, through_curve

Decoder = Callable[[bytes, int, int, dict], np.ndarray]


def packed(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Numbers of `bits` bits in rows without padding; what the data lacks stays 0."""
    values, _ = unpack(data, o.get("bits", 12), height * width, o.get("order", "msb"))
    return values.reshape(height, width)


def control(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Twelve bits, with an extra byte after every ten samples."""
    row = width * 12 // 8 + (width + 2) // 10
    raw = np.frombuffer(data.ljust(row * height, b"\0")[: row * height], np.uint8).reshape(height, row)
    keep = np.delete(raw, np.arange(15, row, 16), axis=1)
    return np.stack([unpack(r.tobytes(), 12, width, o.get("order", "lsb"))[0] for r in keep])


def interlaced(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Twelve bits; even rows first, odd ones from the next multiple of 2048 bytes."""
    half, row = (height + 1) // 2, width * 3 // 2
    second = (half * row // 2048 + 1) * 2048
    out = np.zeros((height, width), np.int64)
    for start, field in ((0, out[::2]), (second, out[1::2])):
        field[:] = unpack(data[start:], 12, field.size, "msb")[0].reshape(field.shape)
    return out


def words(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Sixteen-bit words, big or little, shifted or masked to `bits`."""
    raw = np.frombuffer(data.ljust(2 * height * width, b"\0")[: 2 * height * width], ">u2" if o.get("big", True) else "<u2").astype(np.int64)
    return ((raw >> o.get("shift", 0)) & ((1 << o.get("bits", 16)) - 1)).reshape(height, width)


def packbits(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Runs: a signed count n, then n + 1 bytes as they are (n >= 0) or one byte 1 - n times (-128 is nothing)."""
    out, at, most = bytearray(), 0, height * width
    while at < len(data) and len(out) < most:
        n = data[at] - 256 if data[at] > 127 else data[at]
        if n >= 0:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > -128:
                out += data[at + 1 : at + 2] * (1 - n)
            at += 1 if n == -128 else 2
    return np.frombuffer(bytes(out[:most]).ljust(most, b"\0"), np.uint8).astype(np.int64).reshape(height, width)


def two_lane(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Differences in prefix code: even and odd columns each follow their left neighbour, first columns the row two above.

    The differences are read in order; the predictors are running sums, down rows of
    one parity for the first two columns, then along the row for each parity. Options:
    tree, the code as counts and symbols (without one: a flat code); then, the code
    from row `split` on; start, the predictors by parity; curve, for the samples.
    """
    named = lambda key: PrefixCode(*o[key]) if o.get(key) else None
    bits, code = BitReader(data, o.get("order", "msb")), named("tree") or flat_code()
    split, then = o.get("split", 0), named("then")
    d = np.empty((height, width), np.int64)
    for y in range(height):
        if split and y == split:
            code = then or code
        d[y] = [code.difference(bits) for _ in range(width)]
    start = np.array(o.get("start", [[0, 0], [0, 0]]), np.int64)
    for p in (0, 1):
        d[p::2, :2] = np.cumsum(d[p::2, :2], axis=0) + start[p]
    for p in (0, 1):
        d[:, p::2] = np.cumsum(d[:, p::2], axis=1)
    d &= 0xFFFF
    return through_curve(d, o["curve"], first_bits(data, o.get("order", "msb"))) if o.get("curve") else d


def column_sum(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """One running sum over columns from the right, in each the even rows before the odd ones."""
    bits = BitReader(data)
    rows = [*range(0, height, 2), *range(1, height, 2)]
    out, total = np.zeros((height, width), np.int64), 0
    for x in range(width - 1, -1, -1):
        for y in rows:
            n = 4 - bits.read(2)
            if n == 3 and bits.read(1):
                n = 0
            elif n == 4:
                while n < 17 and not bits.read(1):
                    n += 1
            v = bits.read(n)
            total += v if not n or v >> (n - 1) else v - (1 << n) + 1
            out[y, x] = total & 0xFFFF
    return out


def blocks16(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Blocks of 16 bytes for 16 samples of one column parity: largest, smallest, their places, and 7-bit steps.

    A block whose two places are one has a step more, so the row's other blocks start 7 bits later.
    All rows are decoded at once, a block of each at a time.
    """
    out, i = np.zeros((height, width), np.int64), np.arange(16)
    # A row's bits are its own bytes and the next row's, then zeros; a block has 142 bits from its first byte on.
    raw = np.frombuffer(data[: (height + 1) * width].ljust((height + 1) * width, b"\0"), np.uint8)
    rows = np.zeros((height, 2 * width + 24), np.uint8)
    rows[:, :width], rows[:, width : 2 * width] = raw[: height * width].reshape(height, width), raw[width:].reshape(height, width)
    start, every = np.zeros(height, np.int64), np.arange(height)[:, None]
    for k in range(width // 16):
        w = rows[every, (start >> 3)[:, None] + np.arange(24)].view("<u8")
        skip = (start & 7).astype(np.uint64)[:, None]
        # Moving by 64 is avoided by moving twice.
        w[:, :2] = w[:, :2] >> skip | w[:, 1:] << np.uint64(1) << (np.uint64(63) - skip)
        w[:, 2:] >>= skip

        def field(at: int, n: int, w: np.ndarray = w) -> np.ndarray:
            word, bit = divmod(at, 64)
            v = w[:, word] >> np.uint64(bit)
            if bit + n > 64:
                v = v | w[:, word + 1] << np.uint64(64 - bit)
            return (v & np.uint64((1 << n) - 1)).astype(np.int64)[:, None]

        top, low, at_top, at_low = field(0, 11), field(11, 11), field(22, 4), field(26, 4)
        shift = sum((0x80 << s <= top - low).astype(np.int64) for s in range(4))
        steps = np.concatenate([field(30 + 7 * j, 7) for j in range(15)], axis=1)
        one = at_top == at_low
        step = np.take_along_axis(steps, np.clip(i - (i > at_top) - ((i > at_low) & ~one), 0, 14), axis=1)
        p = np.where(i == at_top, top, np.where(i == at_low, low, np.minimum(0x7FF, (step << shift) + low)))
        x = 32 * (k // 2) + k % 2
        there = out[:, x : x + 32 : 2]
        there[:] = p[:, : there.shape[1]] << 1
        start += np.where(one[:, 0], 135, 128)
    return out


class PanasonicBits:
    """Bits from the end of 16 KB blocks, each of which is turned at an offset."""

    BLOCK = 0x4000

    def __init__(self, data: bytes, turn: int):
        self.data, self.turn, self.block, self.left = data, turn, -1, 0
        self.value = b""

    def read(self, n: int) -> int:
        if not self.left:
            self.block += 1
            raw = self.data[self.block * self.BLOCK : (self.block + 1) * self.BLOCK].ljust(self.BLOCK, b"\0")
            cut = self.BLOCK - self.turn
            self.value, self.left = raw[cut:] + raw[:cut] + b"\0", 8 * self.BLOCK
        self.left -= n
        at = self.left >> 3 ^ 0x3FF0
        return (self.value[at] | self.value[at + 1] << 8) >> (self.left & 7) & ((1 << n) - 1)


def blocks14(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Blocks of 14 samples in two lanes; steps of 8 bits whose scale changes every three samples.

    A block always takes 16 bytes (each lane's four low bits come once), so all blocks
    are decoded at once, a sample of each at a time. Blocks of zeros are zeros.
    """
    size, turn, across = PanasonicBits.BLOCK, o.get("turn", 0x2008), width // 14
    count = height * across
    whole = -(-count * 16 // size) * size
    raw = np.frombuffer(data[:whole].ljust(whole, b"\0"), np.uint8).reshape(-1, size)
    blocks = np.roll(raw, turn, axis=1).reshape(-1, 16)[:count, ::-1]
    some = np.flatnonzero(blocks.any(axis=1))
    high, low = np.ascontiguousarray(blocks[some]).view(">u8").astype(np.uint64).T

    def peek(n: int) -> np.ndarray:
        return (high >> np.uint64(64 - n)).astype(np.int64)

    def skip(n: int, where: np.ndarray | None = None) -> None:
        nonlocal high, low
        k = np.uint64(n)
        to_high, to_low = high << k | low >> np.uint64(64 - n), low << k
        high, low = (to_high, to_low) if where is None else (np.where(where, to_high, high), np.where(where, to_low, low))

    value, seen = [np.zeros(len(some), np.int64) for _ in "ab"], [np.zeros(len(some), bool) for _ in "ab"]
    scale, found = np.zeros(len(some), np.int64), np.zeros((len(some), 14), np.int64)
    for i in range(14):
        lane = i & 1
        if i % 3 == 2:
            scale = 4 >> (3 - peek(2))
            skip(2)
        step = peek(8)
        skip(8)
        first = ~seen[lane] & ((step != 0) | (i > 11))
        v = value[lane] - (0x80 << scale)
        v = np.where((v < 0) | (scale == 4), v & ((1 << scale) - 1), v) + (step << scale)
        v = np.where(seen[lane] & (step != 0), v, value[lane])
        value[lane] = np.where(first, step << 4 | peek(4), v)
        skip(4, first)
        seen[lane] = seen[lane] | (step != 0)
        found[:, i] = value[lane] & 0xFFFF
    out = np.zeros((count, 14), np.int64)
    out[some] = found
    return np.pad(out.reshape(height, across * 14), ((0, 0), (0, width - across * 14)))


class AdaptiveLane:
    """State of one column parity of the adaptive code: last magnitude, mean, count of small ones."""

    def __init__(self):
        self.size = self.mean = self.small = 0

    def width(self) -> int:
        extra = 2 if self.small < 3 else 0
        n = 2 + extra
        while self.size >> (n + extra):
            n += 1
        return n

    def step(self, size: int, negative: bool) -> int:
        d = (~size if negative else size) + self.mean
        self.size, self.mean, self.small = size, (3 * d + self.mean) >> 5, 0 if size > 16 else self.small + 1
        return d


def median_edge(left: int, up: int, corner: int) -> int:
    """Prediction from three neighbours: across an edge the plane or the mean, else the steeper side."""
    a, b = left - corner, up - corner
    if a * b < 0:
        return left + b if abs(a) > 32 or abs(b) > 32 else (left + up) >> 1
    return left if abs(a) > abs(b) else up


def predicted(out: np.ndarray, y: int, x: int) -> int:
    """Prediction of a sample from the row two above and the column two to the left."""
    if y < 2:
        return 0 if x < 2 else int(out[y, x - 2])
    if x < 2:
        return int(out[y - 2, x])
    return median_edge(int(out[y, x - 2]), int(out[y - 2, x]), int(out[y - 2, x - 2]))


def adaptive(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Adaptive Golomb code over a median-edge predictor, after a header of seven bytes."""
    bits, out = BitReader(data[o.get("skip", 7) :]), np.zeros((height, width), np.int64)
    for y in range(height):
        lanes = (AdaptiveLane(), AdaptiveLane())
        for x in range(width):
            lane = lanes[x & 1]
            n = lane.width()
            head = bits.read(3)
            high = 0
            while high < 12 and not bits.peek(1):
                bits.read(1)
                high += 1
            if high == 12:
                high = bits.read(16 - n) >> 1
            else:
                bits.read(1)
            d = lane.step(high << n | bits.read(n), bool(head >> 2))
            out[y, x] = (predicted(out, y, x) + ((d << 2) | (head & 3))) & 0xFFFF
    return out


def lossless_jpeg(data: bytes, height: int, width: int, o: dict) -> np.ndarray:
    """Lossless JPEG, predictor 1, any number of components side by side in a row.

    Option slices: widths of vertical pieces. The samples then run down one piece after
    the other, each as high as the frame, and wrap at the image's height.
    """
    frame, codes, at = {}, {}, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xC3:
            frame = {"bits": body[0], "rows": int.from_bytes(body[1:3], "big"), "columns": int.from_bytes(body[3:5], "big"), "n": body[5], "ids": [body[6 + 3 * k] for k in range(body[5])]}
        elif kind == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                codes[body[0] & 15] = PrefixCode(counts, list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xDB:
            raise ValueError("quantisation is not lossless")
        elif kind == 0xDA:
            which = {body[1 + 2 * k]: body[2 + 2 * k] >> 4 for k in range(body[0])}
            if body[1 + 2 * body[0]] != 1:
                raise ValueError("only predictor 1")
            break
    n, rows, columns = frame["n"], frame["rows"], frame["columns"]
    tables = [codes[which[i]] for i in frame["ids"]]
    bits, d = BitReader(data[at:], "jpeg"), np.empty((rows, columns, n), np.int64)
    for y in range(rows):
        for x in range(columns):
            for c in range(n):
                d[y, x, c] = tables[c].difference(bits)
    # The first column follows the one above, all others the left.
    d[0, 0] += 1 << (frame["bits"] - 1)
    d[:, 0] = np.cumsum(d[:, 0], axis=0)
    out = np.cumsum(d, axis=1) & 0xFFFF
    if o.get("slices"):
        return unsliced(out.ravel(), o["slices"], rows, height, width)
    return out.reshape(rows, columns * n)[:height, :width]


def unsliced(samples: np.ndarray, widths: list[int], rows: int, height: int, width: int) -> np.ndarray:
    """Samples that run down vertical pieces, in their places; the k-th line of a piece is line k over all pieces."""
    out, at, line = np.zeros((height, width), np.int64), 0, 0
    for piece in widths:
        for _ in range(rows):
            x, y = line // height * widths[0], line % height
            some = samples[at : at + piece][: max(0, width - x)]
            out[y, x : x + len(some)] = some
            at, line = at + piece, line + 1
    return out


DECODERS: dict[str, Decoder] = {
    "packed": packed, "control": control, "interlaced": interlaced, "words": words, "packbits": packbits, "two_lane": two_lane, "column_sum": column_sum,
    "blocks16": blocks16, "blocks14": blocks14, "adaptive": adaptive, "lossless_jpeg": lossless_jpeg,
}


def key_stream(key: int, n: int) -> np.ndarray:
    """Words of the cipher of a 32-bit key: a pad from a linear recurrence, then feedback through it."""
    mask, pad = 0xFFFFFFFF, []
    for _ in range(4):
        key = (key * 48828125 + 1) & mask
        pad.append(key)
    pad[3] = (pad[3] << 1 | (pad[0] ^ pad[2]) >> 31) & mask
    for p in range(4, 127):
        pad.append(((pad[p - 4] ^ pad[p - 2]) << 1 | (pad[p - 3] ^ pad[p - 1]) >> 31) & mask)
    pad = [int.from_bytes(v.to_bytes(4, "little"), "big") for v in pad] + [0]
    out = []
    for p in range(127, 127 + n):
        pad[p & 127] = pad[(p + 1) & 127] ^ pad[(p + 65) & 127]
        out.append(pad[p & 127])
    return np.array(out, np.uint32)


def decrypt(data: bytes, key: int) -> bytes:
    """Whole words under the cipher; it is its own inverse."""
    n = len(data) // 4
    return (np.frombuffer(data[: 4 * n], "<u4") ^ key_stream(key, n)).astype("<u4").tobytes() + data[4 * n :]
