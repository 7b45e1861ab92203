"""Bit streams and prefix codes."""

from __future__ import annotations

import numpy as np


def ordered(data: bytes, order: str) -> bytes:
    """The bytes in the sequence in which their bits are read from the top.

    msb: as they come; msb16 and msb32: by little-endian words; jpeg: up to the first
    marker, without the zero that follows an FF.
    """
    if order == "msb":
        return data
    if order in ("msb16", "msb32"):
        n = int(order[3:]) // 8
        padded = data + bytes(-len(data) % n)
        return np.frombuffer(padded, np.uint8).reshape(-1, n)[:, ::-1].tobytes()
    if order == "jpeg":
        at = 0
        while (at := data.find(b"\xff", at)) >= 0 and data[at + 1 : at + 2] in (b"\x00", b""):
            at += 1
        return (data if at < 0 else data[:at]).replace(b"\xff\x00", b"\xff")
    raise ValueError(f"no such bit order: {order}")


class BitReader:
    """Reads bits from the top of each byte (or word), or from the bottom (lsb). Past the end come zeros."""

    def __init__(self, data: bytes, order: str = "msb"):
        self.low = order == "lsb"
        self.data = data if self.low else ordered(data, order)
        self.at = 0

    def peek(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        chunk = self.data[first:last].ljust(last - first, b"\0")
        if self.low:
            return int.from_bytes(chunk, "little") >> (self.at & 7) & ((1 << n) - 1)
        return int.from_bytes(chunk, "big") >> (8 * (last - first) - (self.at & 7) - n) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v

    def left(self) -> int:
        return 8 * len(self.data) - self.at


class BitWriter:
    """Writes bits from the top, or from the bottom of each byte (lsb)."""

    def __init__(self, order: str = "msb"):
        self.order, self.bits = order, []

    def write(self, value: int, n: int) -> None:
        bits = [value >> k & 1 for k in range(n)]
        self.bits += bits if self.order == "lsb" else bits[::-1]

    def bytes(self) -> bytes:
        out = np.packbits(np.array(self.bits, np.uint8), bitorder="little" if self.order == "lsb" else "big").tobytes()
        if self.order in ("msb16", "msb32"):
            return ordered(out, self.order)
        return out.replace(b"\xff", b"\xff\x00") if self.order == "jpeg" else out


def unpack(data: bytes, bits: int, count: int, order: str = "msb") -> tuple[np.ndarray, int]:
    """`count` numbers of 1 to 16 bits, and how many of them the data was too short for (they are 0)."""
    raw = np.frombuffer(data if order == "lsb" else ordered(data, order), np.uint8)
    flat = np.unpackbits(raw, bitorder="little" if order == "lsb" else "big")
    whole = min(count, len(flat) // bits)
    cells = flat[: whole * bits].reshape(whole, bits).astype(np.int64)
    weights = 1 << (np.arange(bits) if order == "lsb" else np.arange(bits)[::-1])
    out = np.zeros(count, np.int64)
    out[:whole] = cells @ weights
    return out, count - whole


def pack(values: np.ndarray, bits: int, order: str = "msb") -> bytes:
    w = BitWriter(order)
    for v in values:
        w.write(int(v), bits)
    return w.bytes()


class PrefixCode:
    """A canonical prefix code from the number of codes of each length and their symbols."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.table: dict[tuple[int, int], int] = {}
        self.code: dict[int, tuple[int, int]] = {}
        value, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.add(length, value, symbols[k])
                value, k = value + 1, k + 1
            value <<= 1
        self.longest = max((n for n, _ in self.table), default=0)

    def add(self, length: int, value: int, symbol: int) -> None:
        self.table[length, value] = symbol
        self.code.setdefault(symbol, (value, length))

    @classmethod
    def of_lengths(cls, lengths: dict[int, int]) -> PrefixCode:
        """The code with a length for each symbol."""
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
        return cls(counts, order)

    def read(self, bits: BitReader) -> int:
        top = bits.peek(self.longest)
        for n in range(1, self.longest + 1):
            symbol = self.table.get((n, top >> (self.longest - n)))
            if symbol is not None:
                bits.at += n
                return symbol
        raise ValueError("no such code")

    def write(self, bits: BitWriter, symbol: int) -> None:
        bits.write(*self.code[symbol])

    def difference(self, bits: BitReader) -> int:
        """A signed number: the code says how many bits it has, a leading 0 that it is negative.

        Symbols above 16 name the low bits that aren't sent in their high half; such
        a number lies in the middle of those that it may be.
        """
        symbol = self.read(bits)
        if symbol == 16:
            return -32768
        n, lost = symbol & 15, symbol >> 4
        if not n:
            return 0
        v = ((bits.read(n - lost) << 1) + 1) << lost >> 1
        return v if v >> (n - 1) else v - (1 << n) + (0 if lost else 1)

    def write_difference(self, bits: BitWriter, d: int) -> None:
        d = (d + 32768) % 65536 - 32768
        n = 16 if d == -32768 else abs(d).bit_length()
        self.write(bits, n)
        if n < 16:
            bits.write(d if d >= 0 else d + (1 << n) - 1, n)


def flat_code(symbols: int = 17, length: int = 5) -> PrefixCode:
    """A code of equal lengths for difference sizes 0 to symbols - 1."""
    return PrefixCode([0] * (length - 1) + [symbols], list(range(symbols)))
