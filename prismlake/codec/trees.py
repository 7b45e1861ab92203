"""Prefix codes and sample curves that raw files name or bring along."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .bits import BitReader

# Codes by name, as the number of codes of each length from 1 to 16 and the
# symbols in the order of their codes. A symbol's low four bits are the size of a difference,
# the high four the bits of it that aren't sent.
TREES: dict[str, tuple[list[int], list[int]]] = {
    "12 lossy": ([0, 1, 5, 1, 1, 1, 1, 1, 1, 2, 0, 0, 0, 0, 0, 0], [5, 4, 3, 6, 2, 7, 1, 0, 8, 9, 11, 10, 12, 0]),
    "12 lossy, lower part": ([0, 1, 5, 1, 1, 1, 1, 1, 1, 2, 0, 0, 0, 0, 0, 0], [0x39, 0x5A, 0x38, 0x27, 0x16, 5, 4, 3, 2, 1, 0, 11, 12, 12]),
    "12 lossless": ([0, 1, 4, 2, 3, 1, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0], [5, 4, 6, 3, 7, 2, 8, 1, 9, 0, 10, 11, 12]),
    "14 lossy": ([0, 1, 4, 3, 1, 1, 1, 1, 1, 2, 0, 0, 0, 0, 0, 0], [5, 6, 4, 7, 8, 3, 9, 2, 1, 0, 10, 11, 12, 13, 14]),
    "14 lossy, lower part": ([0, 1, 5, 1, 1, 1, 1, 1, 1, 1, 2, 0, 0, 0, 0, 0], [8, 0x5C, 0x4B, 0x3A, 0x29, 7, 6, 5, 4, 3, 2, 1, 0, 13, 14]),
    "14 lossless": ([0, 1, 4, 2, 2, 3, 1, 2, 0, 0, 0, 0, 0, 0, 0, 0], [7, 6, 8, 5, 9, 4, 10, 3, 11, 12, 2, 0, 1, 13, 14]),
    "pentax": ([0, 2, 3, 1, 1, 1, 1, 1, 1, 2, 0, 0, 0, 0, 0, 0], [3, 4, 2, 5, 1, 6, 0, 7, 8, 9, 10, 11, 12]),
}


def lane_options(table: bytes, depth: int, little: bool) -> dict:
    """Options of the two-lane decoder from a linearisation table.

    Its first two bytes say which code and which curve follow. Every form starts with
    the four first predictors. Version 68.32 gives the curve at steps, which are
    joined by straight lines, and at byte 562 the row from which another code holds;
    other versions than 70 give the curve value by value. Without one every sample
    stands for itself, and still gets its noise.
    """
    read = WordReader(table, little)
    major, minor = table[0], table[1]
    read.at = 2 + (2110 if major == 73 or minor == 88 else 0)
    lossless = major == 70
    name = f"{14 if depth == 14 else 12} {'lossless' if lossless else 'lossy'}"
    up = [read.word(signed=True) for _ in range(4)]
    options: dict = {"tree": TREES[name], "start": [[up[0], up[2]], [up[1], up[3]]]}
    top, points = (1 << depth) & 0x7FFF, read.word()
    step = top // (points - 1) if points > 1 else 0
    if (major, minor) == (68, 32) and step:
        at, given = np.arange(top), np.array([read.word() for _ in range(points)], np.int64)
        left, part = at // step, at % step
        right = np.minimum(left + 1, points - 1)
        left = np.minimum(left, points - 1)
        options["curve"] = ((given[left] * (step - part) + given[right] * part) // step).tolist()
        read.at = 562
        if split := read.word():
            options |= {"split": split, "then": TREES[name + ", lower part"]}
    elif not lossless and 0 < points <= 0x4001:
        options["curve"] = [read.word() for _ in range(points)]
    return {"curve": top} | options


class WordReader:
    """16-bit numbers of either byte order; past the end come zeros."""

    def __init__(self, data: bytes, little: bool):
        self.data, self.order, self.at = data, "little" if little else "big", 0

    def word(self, signed: bool = False) -> int:
        raw = self.data[self.at : self.at + 2].ljust(2, b"\0")
        self.at += 2
        return int.from_bytes(raw, self.order, signed=signed)


def tree_of_codes(table: bytes, little: bool) -> tuple[list[int], list[int]]:
    """The code in a Pentax file: a word with the number of codes, 12 bytes, their left-aligned 12 bits, and their lengths."""
    read = WordReader(table, little)
    n = (read.word() + 12) & 15
    read.at += 12
    aligned = [read.word() for _ in range(n)]
    lengths = list(table[read.at : read.at + n].ljust(n, b"\0"))
    codes = [a >> max(0, 12 - k) for a, k in zip(aligned, lengths, strict=True)]
    # Of equal codes the last counts first.
    return [lengths.count(k) for k in range(1, 17)], sorted(range(n), key=lambda s: (codes[s], -s))


def through_curve(samples: np.ndarray, curve: Sequence[int] | int, seed: int) -> np.ndarray:
    """Samples through a curve, each spread at random over the step to its neighbours' middle.

    A number n as the curve means 0 to n - 1.
    The noise is one chain over all samples in the order of decoding: the low eleven
    bits count, and the next state is 15700 times the low half plus the high half.
    """
    t = np.arange(curve) if isinstance(curve, int) else np.asarray(curve, np.int64)
    low, high = np.concatenate([t[:1], t[:-1]]), np.concatenate([t[1:], t[-1:]])
    base, width = t - (high - low + 2) // 4, high - low
    # Beyond the curve its last value holds, without noise.
    base, width = np.append(base, t[-1]), np.append(width, 0)
    flat, noise, state = np.minimum(samples.ravel(), len(t)), np.empty(samples.size, np.int64), seed & 0xFFFFFFFF
    for k in range(samples.size):
        noise[k] = state & 2047
        state = (15700 * (state & 0xFFFF) + (state >> 16)) & 0xFFFFFFFF
    return np.clip(base[flat] + ((width[flat] * noise + 1024) >> 12), 0, 0xFFFF).reshape(samples.shape)


def first_bits(data: bytes, order: str = "msb") -> int:
    """The 24 bits that seed the noise."""
    return BitReader(data, order).peek(24)
