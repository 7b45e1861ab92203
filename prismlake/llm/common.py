"""Pieces that several corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whitespace between words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a folder in
    the machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "prismlake-shared")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that `written` made."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_at_exit: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _at_exit:
        with contextlib.suppress(Exception):  # the session may be gone
            delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, removed when the program ends."""
    path = f"{shared_dir(spark)}/prismlake/{name}-{uuid.uuid4().hex}"
    _at_exit.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of `df`: writes it to the shared folder and reads it.

    A lost executor costs nothing that is written, and the rows (with any
    partition numbers among them) are the same for all later readers.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def written_slim(df: DataFrame, name: str) -> DataFrame:
    """`written` for rows of a few numbers: in as many files as their bytes ask for.

    Adaptive execution deals the rows out anew, so that many tasks with little to say
    don't leave as many small files.
    """
    return written(df.hint("rebalance"), name)


def forget(df: DataFrame) -> None:
    """Deletes what `written` wrote, when nothing reads it any more."""
    delete(df.sparkSession, df.written_path)


def release(spark: SparkSession) -> None:
    """Asks the driver to drop what no plan needs any more.

    Shuffle files of ended jobs stay until the driver collects the plans that made
    them. Operators with many jobs ask for that where the data of earlier ones end.
    """
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text) -> F.Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def document_columns(df: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in df.columns]


#: Rows of a few numbers that a join may broadcast; more are shuffled.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it is counted to have at most `rows` rows.

    For written tables of a few numbers a row; counting those reads footers alone.
    """
    return F.broadcast(df) if df.count() <= rows else df


def ordered(df: DataFrame, keys: Sequence, name: str, *weights: str) -> tuple[DataFrame, DataFrame]:
    """`df` written in the order of `keys`, and what lies before each of its partitions.

    The rows get _at, their place, and _part, their partition. The second table has a
    row for each partition, at most as many as shuffle partitions: the rows (_n0) and
    the sum of each weight (_<weight>0) before it, and in all (_n, _<weight>).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = written(run.withColumn("_at", F.monotonically_increasing_id()), name)
    run = rows.withColumn("_part", F.shiftright("_at", 33))
    run.written_path = rows.written_path
    sums = run.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(w).alias(f"_{w}") for w in weights])
    before, everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    out = []
    for c in ("_n", *[f"_{w}" for w in weights]):
        out += [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0"), F.sum(c).over(everything).alias(c)]
    return run, written(sums.select("_part", *out).coalesce(1), f"{name}-offsets")


# -- connected components ------------------------------------------------------

#: Links that a task joins up at once.
AT_ONCE = 1 << 20


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least node that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        root = forest_from(root, i, j)
    return root


def forest_from(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the pairs (i, j) are linked, too."""
    while True:
        ri, rj = root[i], root[j]
        off = ri != rj
        if not off.any():
            return root
        i, j = i[off], j[off]
        root = root.copy()
        np.minimum.at(root, np.maximum(ri[off], rj[off]), np.minimum(ri[off], rj[off]))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links as stars: every node of a block of links hangs on the least one that it reaches there."""

    def star(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        nodes, at = np.unique(np.concatenate([rows["u"], rows["v"]]), return_inverse=True)
        root = forest(len(nodes), iter([(at[: len(rows)], at[len(rows) :])]))
        off = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"u": nodes[off], "v": nodes[root[off]]})

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= AT_ONCE:
            yield star(held)
            held = []
    if held:
        yield star(held)


def components(links: DataFrame) -> DataFrame:
    """Labels each linked node with the smallest node it reaches.

    links: (u long, v long), undirected, in any order; loops are ignored.
    Returns (node long, component long), one row per node that has a link to
    another. Tasks first turn their links into stars, block by block. Then large-star
    and small-star steps alternate (Kiveris et al., 2014) until the links are stars
    over all tasks. Every step is a grouped minimum and an equi-join; the minima are
    written before the join, so that a node with very many links is a skewed join key
    that adaptive execution splits, never one task's group. The links of each round
    are written to the shared folder; they never reach the driver.
    """
    edges = links.select("u", "v").where("u <> v").mapInPandas(_stars, "u long, v long").distinct()
    edges = written_slim(edges, "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written_slim(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # Large star: larger neighbours hang on the least one.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written_slim(large.distinct(), "large-star")
        forget(least)
        forget(edges)
        least = written_slim(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        # Small star: smaller neighbours and the node itself hang on the least one.
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).mapInPandas(_stars, "u long, v long")
        edges = written_slim(small.distinct(), "small-star")
        forget(large)
        forget(least)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link at most and nothing hangs on a node that has one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()
