"""Packed numbers in binary columns, without leaving the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _places(count: int | Column) -> Column:
    """0 to count - 1; empty if count is 0."""
    n = F.lit(count) if isinstance(count, int) else count
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))


def _part(bits: int) -> int:
    """Bytes, seven at most, of the largest part that is a whole number of values; 0 if there is none."""
    size = math.lcm(bits, 8) // 8
    return 7 // size * size


def _word(data: Column, i: Column, size: int, little: bool) -> Column:
    """The i-th part of `size` bytes as a long, the last filled up with zeros."""
    part = F.rpad(F.hex(F.substring(data, i * size + 1, F.lit(size))), 2 * size, "0")
    if not little:
        return F.conv(part, 16, 10).cast("long")
    # Turned as text, each byte's two digits change places as well.
    turned, low = F.conv(F.reverse(part), 16, 10).cast("long"), F.lit(0x0F0F0F0F0F0F0F).cast("long")
    return F.shiftleft(turned.bitwiseAND(low), 4).bitwiseOR(F.shiftright(turned, 4).bitwiseAND(low))


def _numbers(word: Column, bits: int, size: int, little: bool) -> Column:
    each, mask = size * 8 // bits, (1 << bits) - 1
    shifts = [bits * k if little else size * 8 - bits * (k + 1) for k in range(each)]
    return F.array(*[F.shiftright(word, k).bitwiseAND(mask).cast("int") for k in shifts])


def unpack_rows(df: DataFrame, data: str, bits: int, count: Column | None = None, little: bool = False) -> DataFrame:
    """What `unpack` gives as rows: the other columns, i, v.

    Parts become rows before they are taken apart, so that all of it is compiled code.
    """
    others, size = [c for c in df.columns if c != data], _part(bits)
    if not size:
        return df.select(*others, F.posexplode(unpack(F.col(data), bits, count, little)).alias("i", "v"))
    n, each = F.floor(F.length(data) * F.lit(8).cast("long") / bits).cast("int") if count is None else count, size * 8 // bits
    parts = df.withColumn("_n", n).withColumn("_p", F.explode(_places(F.ceil(F.col("_n") / each).cast("int"))))
    words = parts.select(*others, "_n", "_p", _word(F.col(data), F.col("_p"), size, little).alias("_w"))
    each_one = words.select(*others, "_n", "_p", F.posexplode(_numbers(F.col("_w"), bits, size, little)).alias("_k", "v"))
    return each_one.select(*others, (F.col("_p") * each + F.col("_k")).alias("i"), "v", "_n").where("i < _n").drop("_n")


def unpack(data: Column, bits: int, count: int | Column | None = None, little: bool = False) -> Column:
    """Array of `count` numbers of up to 24 bits, packed from the top of each byte or from the bottom (little); all whole ones if count is None."""
    if count is None:
        count = F.floor(F.length(data) * F.lit(8).cast("long") / bits).cast("int")

    if part := _part(bits):  # whole numbers of values in parts that fit a long: one conversion a part
        n, each = F.lit(count) if isinstance(count, int) else count, part * 8 // bits
        words = F.transform(_places(F.ceil(n / each).cast("int")), lambda i: _word(data, i, part, little))
        values = F.flatten(F.transform(words, lambda w: _numbers(w, bits, part, little)))
        return F.when(n >= 0, F.slice(values, 1, F.greatest(n, F.lit(0))))

    def value(i: Column) -> Column:
        start = i.cast("long") * bits
        four = F.hex(F.substring(data, F.floor(start / 8).cast("int") + 1, F.lit(4)))
        four = F.rpad(four, 8, "0")
        if little:
            four = F.concat(*[F.substring(four, k, 2) for k in (7, 5, 3, 1)])
        word, skip = F.conv(four, 16, 10).cast("long"), (start % 8).cast("int")
        shift = skip if little else F.lit(32 - bits) - skip
        return F.call_function("shiftright", word, shift).bitwiseAND((1 << bits) - 1).cast("int")

    return F.transform(_places(count), value)


def parts(data: Column, size: int) -> Column:
    """Array of the parts of `size` bytes, the last filled up with zeros."""
    count = F.ceil(F.length(data) / size).cast("int")
    return F.transform(_places(count), lambda i: F.unhex(F.rpad(F.hex(F.substring(data, i * size + 1, F.lit(size))), 2 * size, "0")))


def split_row(row: Column, half: Column) -> Column:
    """Row of an image that is stored with its `half` even rows before its odd ones."""
    return F.when(row < half, row * 2).otherwise((row - half) * 2 + 1)


def running_key(i: Column, first: int, factor: int, start: int = 0x60) -> Column:
    """Key of byte i: the key grows by factor times a counter that grows by one each byte.

    In closed form it is first + factor * (start * (i + 1) + i * (i + 1) / 2).
    """
    k = i.cast("long")
    return (F.lit(first) + F.lit(factor) * (F.lit(start) * (k + 1) + F.shiftright(k * (k + 1), 1))).bitwiseAND(255).cast("int")


#: Integer matrix from chroma to red, green and blue, in 4096ths.
CHROMA = ((50, 22929), (-5640, -11751), (29040, -101))


def chroma_to_rgb(y: Column, cb: Column, cr: Column, matrix: tuple, gains: tuple) -> list[Column]:
    """Luma plus a whole-number mix of the chroma, times gains in 256ths, cut to 16 bits."""
    out = []
    for (a, b), gain in zip(matrix, gains, strict=True):
        v = (y + F.shiftright(cb * a + cr * b, 12)) * gain
        out.append(F.shiftright(F.greatest(F.lit(0), F.least(F.lit(65535 << 8), v)), 8).cast("int"))
    return out
