"""Colour functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, most) -> Column:
    return F.greatest(F.lit(0).cast("double"), F.least(F.lit(most).cast("double"), v))


def clip_int(v: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), v))


def clamp_bits(v: Column, bits: int) -> Column:
    return clip_int(v, (1 << bits) - 1)


def reduce_depth(v: Column, depth: int, to: int) -> Column:
    """Arithmetic shift to fewer bits, then clip."""
    return clip_int(F.shiftright(v, depth - to), (1 << to) - 1)


def _hue(r: Column, g: Column, b: Column, top: Column, d: Column) -> Column:
    h = F.when(r == top, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(g == top, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    return h / 6.0


def rgb_to_hsl(r: Column, g: Column, b: Column, most: int) -> Column:
    """Struct of h, s, l in 0..1; grey has h = s = 0."""
    r, g, b = (c.cast("double") / F.lit(float(most)) for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2.0
    s = F.when(light >= 0.5, d / (2.0 - top - low)).otherwise(d / (top + low))
    grey = top == low
    return F.struct(F.when(grey, 0.0).otherwise(_hue(r, g, b, top, d)).alias("h"), F.when(grey, 0.0).otherwise(s).alias("s"), light.alias("l"))


def rgb_to_hsv(r: Column, g: Column, b: Column, most: int) -> Column:
    r, g, b = (c.cast("double") / F.lit(float(most)) for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, grey = top - low, top == low
    return F.struct(F.when(grey, 0.0).otherwise(_hue(r, g, b, top, d)).alias("h"), F.when(grey, 0.0).otherwise(d / top).alias("s"), top.alias("v"))


def _ramp(p: Column, q: Column, t: Column) -> Column:
    t = F.when(t < 0, t + 1.0).when(t > 1, t - 1.0).otherwise(t)
    return F.when(t < 1 / 6.0, p + (q - p) * 6.0 * t).when(t < 0.5, q).when(t < 2 / 3.0, p + (q - p) * (2 / 3.0 - t) * 6.0).otherwise(p)


def hsl_to_rgb(h: Column, s: Column, light: Column, most: int) -> Column:
    """Struct of r, g, b as doubles in 0..most."""
    q = F.when(light < 0.5, light * (s + 1.0)).otherwise(light + s - light * s)
    p = light * 2.0 - q
    channel = lambda t: F.when(s == 0, light).otherwise(_ramp(p, q, t)) * float(most)
    return F.struct(channel(h + 1 / 3.0).alias("r"), channel(h).alias("g"), channel(h - 1 / 3.0).alias("b"))


def hsv_to_rgb(h: Column, s: Column, v: Column, most: int) -> Column:
    h6 = F.when(h * 6.0 >= 6, 0.0).otherwise(h * 6.0)
    i = F.floor(h6)
    f = h6 - i
    low, down, up = v * (F.lit(1.0) - s), v * (F.lit(1.0) - s * f), v * (F.lit(1.0) - s * (F.lit(1.0) - f))
    table = {"r": (v, down, low, low, up, v), "g": (up, v, v, down, low, low), "b": (low, low, up, v, v, down)}

    def channel(name: str) -> Column:
        sector = reduce(lambda c, k: c.when(i == k, table[name][k]), range(1, 5), F.when(i == 0, table[name][0])).otherwise(table[name][5])
        return (F.when(s == 0, v).otherwise(sector) * float(most)).alias(name)

    return F.struct(*[channel(n) for n in "rgb"])


def luma_mean(r, g, b) -> Column:
    return (r + g + b) / 3.0


def luma_601(r, g, b) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def luma_hsl(r, g, b) -> Column:
    return (F.greatest(r, g, b) + F.least(r, g, b)) / 2.0


def white_balance(r, g, b, mul: tuple[float, float, float]) -> list[Column]:
    return [c * float(m) for c, m in zip((r, g, b), mul, strict=True)]


def neutral_gains(r: Column, g: Column, b: Column) -> list[Column]:
    """Gains that make a picked colour grey, on values moved up by one so that none is 0."""
    top = (g + 1).cast("double")
    return [top / (r + 1), top / (g + 1), top / (b + 1)]


def split_tone(r: Column, g: Column, b: Column, shadow: tuple, highlight: tuple, balance: float, most: int) -> list[Column]:
    """Adds tints weighted by brightness; 8-bit tints scale to `most`. No tint at all changes nothing."""
    if not any(shadow) and not any(highlight):
        return [r, g, b]
    k = most / 255.0
    light = luma_mean(r, g, b) / float(most)
    dark = (F.lit(1.0) - light) * (1 - balance)
    bright = light * float(balance)
    out = []
    for c, s, h in zip((r, g, b), shadow, highlight, strict=True):
        out.append(c + (dark * (s * k)).cast("int") + (bright * (h * k)).cast("int"))
    return out


def srgb_to_linear(v: Column, most: float) -> Column:
    n = v / float(most)
    return F.when(n < 0.04045, n / 12.92).otherwise(F.pow((n + 0.055) / 1.055, F.lit(2.4))) * float(most)


def power_gamma(v: Column, most: float, gamma: float) -> Column:
    return F.pow(v / float(most), F.lit(1.0 / gamma)) * float(most)


# A fit of black-body colours by temperature in hundreds of kelvin, as (constant, slope, log factor, shift).
RED_HOT = (351.97690566805693, 0.114206453784165, -40.25366309332127, 55)
GREEN_HOT = (325.4494125711974, 0.07943456536662342, -28.0852963507957, 50)
GREEN_WARM = (-155.25485562709179, -0.44596950469579133, 104.49216199393888, 2)
BLUE_WARM = (-254.76935184120902, 0.8274096064007395, 115.67994401066147, 10)


def temperature_gains(kelvin: Column) -> list[Column]:
    """Gains for red, green, blue that undo the colour of light of a temperature; null where a channel is dark."""
    t = F.floor(kelvin / 100).cast("int")

    def fit(c: tuple) -> Column:
        a, b, k, s = c
        value = F.lit(a) + (t - s) * b + F.log(F.greatest(t - s, F.lit(1)).cast("double")) * k
        return F.floor(clip(value, 255))

    hot = t >= 66
    red = F.when(hot, fit(RED_HOT)).otherwise(255)
    green = F.when(hot, fit(GREEN_HOT)).otherwise(fit(GREEN_WARM))
    blue = F.when(hot, 255).when(t <= 19, 0).otherwise(fit(BLUE_WARM))
    return [F.when(c > 0, F.lit(255.0) / c) for c in (red, green, blue)]


def matrix(r: Column, g: Column, b: Column, m: list[list[float]]) -> list[Column]:
    """3 x 3 matrix product; rows are normalised to sum 1, so that grey stays grey."""
    out = []
    for row in m:
        total = sum(row) or 1.0
        out.append(r * (row[0] / total) + g * (row[1] / total) + b * (row[2] / total))
    return out


def pack_bgra8(r: Column, g: Column, b: Column, depth: int) -> list[Column]:
    to8 = lambda c: reduce_depth(c, depth, 8)
    return [to8(b).alias("b8"), to8(g).alias("g8"), to8(r).alias("r8"), F.lit(255).alias("a8")]


def pack_rgba16(r: Column, g: Column, b: Column) -> list[Column]:
    out = []
    for n, c in (("r", r), ("g", g), ("b", b)):
        out += [F.shiftright(c, 8).alias(f"{n}_hi"), c.bitwiseAND(255).alias(f"{n}_lo")]
    return out
