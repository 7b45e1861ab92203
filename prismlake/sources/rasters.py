"""Rasters and metadata tables derived from the driver's tables.

The test tables hold no images, so samples, pixels, tags and edits are computed
from other columns. Each function has its SQL twin in `plans/oracle.py`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an image made from embeddings, and its width.
HEIGHT, WIDTH = 100, 64
DEPTH = 16
MAX = (1 << DEPTH) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): one sample a photosite, from embedding components."""
    v = F.floor((F.col("e").cast("double") + 0.5) * 65536)
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", F.posexplode("embedding").alias("x", "e"))
        .select(F.expr(f"vec_id div {HEIGHT}").alias("image_id"), (F.col("vec_id") % HEIGHT).cast("int").alias("y"), "x", F.greatest(F.lit(0), F.least(F.lit(MAX), v)).cast("int").alias("v"))
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, r, g, b) with 16 bits a channel."""
    g = (F.col("v") * 3 + F.col("x") * 101).bitwiseAND(MAX)
    b = (F.col("v") * 5 + F.col("y") * 57).bitwiseAND(MAX)
    return mosaic(spark, sf_dir).select("image_id", "y", "x", F.col("v").alias("r"), g.alias("g"), b.alias("b"))


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, r, g, b): a large table of pixels without a place, from line items."""
    scale = lambda c, k: F.floor(F.col(c) * k).cast("long").bitwiseAND(MAX).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), scale("l_quantity", 1310).alias("r"), scale("l_extendedprice", 0.5).alias("g"), scale("l_discount", 655350).alias("b"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, ifd_id, parent_id, preorder, tag, num, text): directory entries, from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("image_id"), (F.col("event_id") % 7).cast("int").alias("ifd_id"), F.when(F.col("event_id") % 7 > 0, F.expr("cast((event_id % 7 - 1) div 2 as int)")).alias("parent_id"),
        F.col("event_id").alias("preorder"), (F.col("event_id") % 11).cast("int").alias("tag"), F.col("value").alias("num"), F.col("event_type").alias("text"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, seq, effect, value): an ordered log of edits for each image, from events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("effect"), "value")


def byte_rows(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(doc_id, bytes binary) of the documents' UTF-8 text.

    spread deals them out over the session's shuffle partitions, for queries that make many rows
    of each: a file of one row group is read by one task otherwise.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id") if spread else docs
