"""An edit as a plan over pixels: neutral parameters add no step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import color, tone
from prismlake.operators import geometry, stats, stencil


@dataclass
class Edit:
    exposure: float = 0.0
    contrast: float = 0
    shadow: float = 0
    highlight: float = 0
    saturation: float = 1.0
    gains: tuple[float, float, float] = (1.0, 1.0, 1.0)
    reverse_gamma: bool = False
    gamma: float = 2.4
    rotation: int = 0
    shadow_tint: tuple[float, float, float] = (0, 0, 0)
    highlight_tint: tuple[float, float, float] = (0, 0, 0)
    tint_balance: float = 0.5
    equalise: bool = False
    denoise: int = 0
    sharpen: int = 0

    def tones(self) -> bool:
        return bool(self.exposure or self.contrast or self.shadow or self.highlight or self.reverse_gamma or self.saturation != 1.0)


#: Entries of the tone table that goes into the plan; inputs between them take the lower one's.
CURVE_BITS = 12


def render(pixels: DataFrame, edit: Edit, depth: int, height: int, width: int, to: int = 8) -> DataFrame:
    """Pixels after an edit, with `to` bits a channel.

    In order: white balance, clip, tone curve on lightness and saturation, rotation,
    split tone, clip, equalisation, smoothing, sharpening, fewer bits. All steps on
    one pixel are one projection.
    """
    most = (1 << depth) - 1
    df, key = pixels, ["image_id", "y", "x"]
    rgb = [F.col(c) for c in "rgb"]
    if edit.gains != (1.0, 1.0, 1.0) or edit.tones():
        rgb = [color.clip(c, most) for c in color.white_balance(*rgb, edit.gains)]
    if edit.tones():
        curve = tone.tone_curve(depth, edit.exposure, edit.shadow, edit.contrast, edit.highlight, edit.reverse_gamma, edit.gamma)
        step = max(0, depth - CURVE_BITS)
        table = F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in curve[:: 1 << step]) + ")")
        # Generated, so that hue, saturation and lightness are worked out once.
        df = df.select(*key, F.inline(F.array(color.rgb_to_hsl(*rgb, most))))
        light = F.element_at(table, F.shiftright((F.col("l") * most).cast("int"), step) + 1)
        df = df.select(*key, F.inline(F.array(F.struct("h", (F.col("s") * edit.saturation).alias("s"), light.alias("l")))))
        df = df.select(*key, F.inline(F.array(color.hsl_to_rgb(F.col("h"), F.col("s"), F.col("l"), most))))
        rgb = [F.col(c) for c in "rgb"]
    df = df.select(*key, *[c.cast("int").alias(n) for c, n in zip(rgb, "rgb", strict=True)])
    if edit.rotation % 4:
        df = geometry.rotate(df, edit.rotation, height, width)
    if any(edit.shadow_tint) or any(edit.highlight_tint):
        tinted = color.split_tone(*[F.col(c) for c in "rgb"], edit.shadow_tint, edit.highlight_tint, edit.tint_balance, most)
        df = df.select(*key, *[color.clip_int(c, most).cast("int").alias(n) for c, n in zip(tinted, "rgb", strict=True)])
    if edit.equalise:
        df = stats.equalise(df, color.luma_601(*[F.col(c) for c in "rgb"]), ["r", "g", "b"], depth)
    df = stencil.sharpen(stencil.smooth(df, edit.denoise), edit.sharpen)
    return df.select(*key, *[color.reduce_depth(F.col(c), depth, to).alias(c) for c in "rgb"])
