"""Histograms, levels, equalisation, exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, channels: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, channel, bin, n) of the bins that occur; partial counts come before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(n).alias("channel"), c.cast("int").alias("bin")) for n, c in channels.items()])
    return df.select(*keys, F.inline(pairs)).groupBy(*keys, "channel", "bin").agg(F.count("*").alias("n"))


def dense(hist: DataFrame, bins: int) -> DataFrame:
    """Adds the empty bins; `bins` bounds what is broadcast."""
    spark = hist.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    channels = hist.select("channel").distinct()
    return channels.join(F.broadcast(every)).join(hist, ["channel", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def equalisation_lut(hist: DataFrame, most: int) -> DataFrame:
    """(keys..., bin, out): running share of all pixels, scaled to `most`, cut to whole numbers.

    hist: (bin, n) and any keys; at most 2^depth rows a key.
    """
    keys = [c for c in hist.columns if c not in ("bin", "n")]
    run, everything = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    return hist.select(*keys, "bin", ((F.sum("n").over(run) * most) / F.sum("n").over(everything)).cast("int").alias("out"))


def equalise(df: DataFrame, luma: Column, channels: Sequence[str], depth: int) -> DataFrame:
    """Each channel by the running histogram of the luma of its image.

    The table is dense: one array of 2^depth entries an image, which each pixel
    indexes.
    """
    hist = df.groupBy("image_id", luma.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.select("image_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit((1 << depth) - 1))))
    full = every.join(hist, ["image_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lut = equalisation_lut(full, (1 << depth) - 1).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "out"))), lambda s: s["out"]).alias("_lut"))
    found = df.join(lut, "image_id")
    return found.select(*[F.element_at("_lut", F.col(c) + 1).alias(c) if c in channels else F.col(c) for c in df.columns])


def phase_levels(df: DataFrame) -> DataFrame:
    """(image_id, phase, black): the median sample of each of the four sites of a 2 x 2 pattern.

    The median is the smallest value up to which more than half of the samples lie.
    """
    hist = df.groupBy("image_id", (F.col("y") % 2 * 2 + F.col("x") % 2).cast("int").alias("phase"), "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id", "phase")
    hist = hist.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("total", F.sum("n").over(w))
    return hist.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("image_id", "phase").agg(F.min("v").alias("black"))


def mean_level(df: DataFrame) -> DataFrame:
    """(image_id, black): mean of the samples of optically dark areas, in whole numbers."""
    return df.groupBy("image_id").agg(F.expr("sum(v) div count(*)").alias("black"))


def estimated_levels(df: DataFrame, height: int, width: int, border: int) -> DataFrame:
    """(image_id, black, white): least and largest sample inside a border."""
    inside = df.where(F.col("y").between(border, height - border - 1) & F.col("x").between(border, width - border - 1))
    return inside.groupBy("image_id").agg(F.min("v").alias("black"), F.max("v").alias("white"))


def alternating_sums(df: DataFrame) -> DataFrame:
    """(image_id, phase, total): sums of every other value, as black-level deltas use them."""
    return df.groupBy("image_id", (F.col("x") % 2).cast("int").alias("phase")).agg(F.sum("v").alias("total"))


def scale_levels(v: Column, black: int, white: int, depth: int) -> Column:
    """Black to 0 and white to the largest value; no step if that is so already."""
    most = (1 << depth) - 1
    if not 0 < white <= most:
        white = most
    if black == 0 and white == most:
        return v
    s = ((v - black) * F.lit(most / float(white - black))).cast("long")
    return F.when(s > white, most).when(s < 0, 0).otherwise(s).cast("int")


def auto_exposure(hist: DataFrame, target: int = 78, inverted: bool = False) -> DataFrame:
    """(keys..., mean, ev): stops that move the mean bin to the target.

    hist: (bin, n) and any keys. inverted takes the largest count less each, with
    two end points, as a drawn curve has them.
    """
    keys = [c for c in hist.columns if c not in ("bin", "n")]
    if inverted:
        w = Window.partitionBy(*keys)
        hist = hist.withColumns({"n": F.max("n").over(w) - F.col("n"), "bin": F.col("bin") + 1})
    mean = F.sum(F.col("n") * F.col("bin")).cast("double") / F.sum("n")
    out = hist.groupBy(*keys).agg(mean.alias("mean"))
    shift = F.lit(float(target)) - F.col("mean")
    return out.withColumn("ev", F.when(shift == 0, 0.0).otherwise(F.log2(F.abs(shift) / 8.0) * F.signum(shift)))


def smooth_histogram(hist: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Quarter, half, quarter over neighbouring bins, cut to whole numbers; the ends become 0."""
    w = Window.partitionBy(*keys).orderBy("bin")
    s = F.lag("n").over(w) * 0.25 + F.col("n") * 0.5 + F.lead("n").over(w) * 0.25
    return hist.select(*keys, "bin", F.coalesce(s.cast("long"), F.lit(0)).alias("n"))
