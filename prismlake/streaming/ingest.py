"""Extensions: streams of files and of edits. The operators themselves are the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import metadata

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A stream of files as they arrive, with their decoder and container format."""
    new = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).load(path)
    return new.withColumns({"decoder": metadata.decoder(F.col("path")), "kind": metadata.magic(F.col("content"))})


def edits_by_window(log: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Edits of each effect in time windows; those that come later than `late` are left out.

    log: a stream (ts, effect, value).
    """
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "effect").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
