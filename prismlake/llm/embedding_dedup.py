"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned onto the principal axes of all
vectors, so that the leading dimensions carry most of every product. Tiles of
vectors that lie near each other along those axes are compared in pairs: the
product over the leading dimensions comes first, the rest can add at most the
product of the two suffix norms, and a pair whose bound stays below the threshold
is dropped. The bounds are exact, so no pair at or above the threshold is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, forget, table, written

#: Vectors in a tile and in a block of it that is compared at once, axes that bound a
#: tile, and dimensions after which products are bounded again.
TILE, BLOCK, BOX, FIRST = 2048, 512, 4, 8
#: Rounding that the turned vectors may show; pairs this near the threshold are computed again from the given ones.
SLACK = 1e-9
#: Moment matrices that a task adds up at a time.
FAN = 8
#: Lengths of vectors that get principal axes; rarer lengths keep their own axes.
LENGTHS = 4

UNUSABLE = "(label IS NULL OR embedding IS NULL OR size(embedding) = 0 OR exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) OR NOT exists(embedding, x -> x <> 0))"


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components leave the range of doubles.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by falling second moment for each of the commonest vector lengths.

    Every vector counts. Tasks add up their own moment matrices, then FAN matrices at
    a time are added up until one is left: the driver gets one matrix a length.
    """
    dims = [r[0] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, rows in batch.groupby("dim")["embedding"]:
                for k in range(0, len(rows), 4096):
                    x = _unit(np.stack(rows.iloc[k : k + 4096].to_numpy()).astype(np.float64))
                    total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pd.DataFrame({"dim": [d], "m": [m.tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        m = sum(np.frombuffer(b) for b in rows["m"])
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "g": [rows["g"].iloc[0]], "m": [m.tobytes()]})

    parts = vectors.where(F.col("dim").isin(dims)).select("dim", "embedding").mapInPandas(moments, "dim int, m binary")
    left = vectors.rdd.getNumPartitions()
    parts = parts.withColumn("g", F.spark_partition_id())
    while left > 1:
        left = -(-left // FAN)
        parts = parts.withColumn("g", F.expr(f"g div {FAN}").cast("int")).groupBy("dim", "g").applyInPandas(add, "dim int, g int, m binary")
    axes = {}
    for d, m in parts.select("dim", "m").collect():
        _, v = np.linalg.eigh(np.frombuffer(m).reshape(d, d))
        axes[d] = np.ascontiguousarray(v[:, ::-1])
    return axes


def _turned(rows: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    unit = _unit(rows)
    a = axes.get(rows.shape[1])
    return unit if a is None else unit @ a


def near_pairs(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, product) for the rows of turned unit vectors whose product is at least `least`.

    Dimensions are taken in growing blocks. While many pairs are left, a block is
    one matrix product; then only the pairs left are summed on.
    """
    d = a.shape[1]
    ends = [min(d, FIRST)]
    while ends[-1] < d:
        ends.append(min(d, 2 * ends[-1]))
    sa, sb = (np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])) for x in (a, b))
    part = a[:, : ends[0]] @ b[:, : ends[0]].T
    i = j = s = None
    for at, end in enumerate(ends):
        if at:
            cut = slice(ends[at - 1], end)
            if i is None:
                part += a[:, cut] @ b[:, cut].T
            else:
                s = s + np.einsum("ij,ij->i", a[i, cut], b[j, cut])
        if i is None:
            bound = part + np.outer(sa[:, end], sb[:, end]) if end < d else part
            near = bound >= least - SLACK
            if end == d or near.sum() * 8 < near.size:
                i, j = np.nonzero(near)
                s = part[i, j]
        else:
            near = s + (sa[i, end] * sb[j, end] if end < d else 0) >= least - SLACK
            i, j, s = i[near], j[near], s[near]
        if i is not None and not len(i):
            return
    yield i, j, s


def near_blocks(a: np.ndarray, b: np.ndarray, least: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`near_pairs` of whole tiles by blocks; i < j if both are the same tile.

    Blocks whose ranges on the first axis are too far apart are left out.
    """
    far = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    for p in range(0, len(a), BLOCK):
        x = a[p : p + BLOCK]
        for q in range(p if own else 0, len(b), BLOCK):
            y = b[q : q + BLOCK]
            if x[:, 0].min() - y[:, 0].max() > far or y[:, 0].min() - x[:, 0].max() > far:
                continue
            for i, j, s in near_pairs(x, y, least):
                if own and p == q:
                    keep = i < j
                    i, j, s = i[keep], j[keep], s[keep]
                yield i + p, j + q, s


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of two given vectors in double precision."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)))


TILE_SCHEMA = "label string, dim int, tile string, lo array<double>, hi array<double>, nodes binary, weights binary, vectors binary"


def _cut(axes: dict[int, np.ndarray], double: bool):
    """Cuts sorted rows into tiles of one label and length, with their box on the leading axes."""
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, held, key = TaskContext.get().partitionId(), 0, [], None

        def tile(rows: pd.DataFrame) -> dict:
            nonlocal made
            made += 1
            x = np.stack(rows["embedding"].to_numpy()).astype(kind)
            lead = _turned(x.astype(np.float64), axes)[:, :BOX]
            return {
                "label": key[0], "dim": key[1], "tile": f"{part}-{made}", "lo": lead.min(axis=0), "hi": lead.max(axis=0),
                "nodes": rows["node"].to_numpy(np.int64).tobytes(), "weights": rows["n"].to_numpy(np.int64).tobytes(), "vectors": x.tobytes(),
            }

        def close() -> list[dict]:
            nonlocal held
            if not held:
                return []
            rows, held = pd.concat(held), []
            return [tile(rows.iloc[k : k + TILE]) for k in range(0, len(rows), TILE)]

        for batch in batches:
            out = []
            for k, rows in batch.groupby(["label", "dim"], sort=False):
                if k != key:
                    out += close()
                    key = k
                held.append(rows)
                if sum(map(len, held)) >= 4 * TILE:
                    out += close()
            if out:
                yield pd.DataFrame(out)
        if out := close():
            yield pd.DataFrame(out)

    return run


def _compare(axes: dict[int, np.ndarray], least: float, double: bool):
    """(u, v, n): links that span what is linked (n null), and counts of links (v null)."""
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                given = np.frombuffer(row.vectors, kind).reshape(-1, row.dim).astype(np.float64)
                node, n = np.frombuffer(row.nodes, np.int64), np.frombuffer(row.weights, np.int64)
                a = _turned(given, axes)
                own = row.vectors2 is None
                if own:
                    given2, node2, n2, b = given, node, n, a
                else:
                    given2 = np.frombuffer(row.vectors2, kind).reshape(-1, row.dim).astype(np.float64)
                    node2, n2 = np.frombuffer(row.nodes2, np.int64), np.frombuffer(row.weights2, np.int64)
                    b = _turned(given2, axes)
                count, count2, found = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
                for i, j, s in near_blocks(a, b, least, own):
                    sure = s >= least + SLACK
                    for k in np.flatnonzero(~sure):
                        sure[k] = cosine(given[i[k]], given2[j[k]]) >= least
                    i, j = i[sure], j[sure]
                    np.add.at(count, i, n2[j])
                    np.add.at(count2, j, n[i])
                    found.append((i, j))
                if own:
                    count += count2
                    every, root = node, forest(len(a), iter(found))
                    counts, who = count, node
                else:
                    every, root = np.concatenate([node, node2]), forest(len(a) + len(b), ((i, j + len(a)) for i, j in found))
                    counts, who = np.concatenate([count, count2]), every
                off, some = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(counts)
                if len(some):
                    yield pd.DataFrame({
                        "u": np.concatenate([every[off], who[some]]),
                        "v": pd.array([*every[root[off]], *[None] * len(some)], dtype="Int64"),
                        "n": pd.array([*[None] * len(off), *counts[some]], dtype="Int64"),
                    })

    return run


def embedding_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """Links vectors of one label whose cosine is at least `least`.

    vectors: vec_id, embedding (array of float or double), label; other columns
    are ignored. Returns (vec_id, n_links, component_id, kept), one row per row.
    Null, empty and zero vectors, those with null or non-finite components, and
    rows without a label link with nothing and stand alone; so do vectors of
    unequal length with each other. Equal vectors of a label are compared once and
    counted as often as they occur. A null vec_id counts as a link and has
    component_id of its component, null if that has no id; kept is then false. No
    rows give no rows.

    A label with n vectors costs the pairs of its tiles that lie within the
    threshold's distance along the first axis and in the box of the leading axes;
    every pair of tiles is a row of its own, so a label with a third of all
    vectors spreads over all tasks.
    """
    spark = vectors.sparkSession
    double = dict(vectors.dtypes)["embedding"] == "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("ok", ~F.expr(UNUSABLE))
    reps = rows.where("ok").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    reps = reps.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding"))
    reps = written(reps, "vector-classes")
    axes = principal_axes(reps)

    @F.pandas_udf("double")
    def lead(x: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        sizes = x.map(len).to_numpy()
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            out[at] = _turned(np.stack(x.iloc[at].to_numpy()).astype(np.float64), axes)[:, 0]
        return pd.Series(out)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = reps.select("label", "dim", "node", "n", "embedding", lead("embedding").alias("lead"))
    keyed = keyed.repartitionByRange(parts, "label", "dim", "lead", "node").sortWithinPartitions("label", "dim", "lead", "node")
    tiles = written(keyed.mapInPandas(_cut(axes, double), TILE_SCHEMA), "vector-tiles")
    # Unit vectors with cosine c are sqrt(2 - 2c) apart, along any axis at most.
    far = math.sqrt(2 - 2 * least) + 1e-6
    boxes = tiles.select("label", "dim", "tile", "lo", "hi")
    cells = F.sequence(F.floor((F.element_at("lo", 1)) / far), F.floor((F.element_at("hi", 1) + far) / far))
    left = boxes.withColumn("cell", F.explode(cells))
    right = boxes.select("label", "dim", *[F.col(c).alias(f"{c}2") for c in ("tile", "lo", "hi")]).withColumn("cell", F.explode(F.expr(f"sequence(floor(lo2[0] / {far!r}), floor((hi2[0] + {far!r}) / {far!r}))")))
    gap = F.expr("aggregate(zip_with(zip_with(lo, hi2, (a, b) -> a - b), zip_with(lo2, hi, (a, b) -> a - b), (a, b) -> greatest(a, b, 0D)), 0D, (s, g) -> s + g * g)")
    met = left.join(right, ["label", "dim", "cell"]).where((F.col("tile") < F.col("tile2")) & (gap <= far * far)).select("tile", "tile2").distinct()
    body = tiles.select("dim", "tile", "nodes", "weights", "vectors")
    other = tiles.select(*[F.col(c).alias(f"{c}2") for c in ("tile", "nodes", "weights", "vectors")])
    pairs = met.join(body, "tile").join(other, "tile2").select(*body.columns, "nodes2", "weights2", "vectors2")
    own = body.select(*body.columns, *[F.lit(None).cast("binary").alias(c) for c in ("nodes2", "weights2", "vectors2")])
    work = own.unionByName(pairs).withColumn("_deal", F.xxhash64("nodes", "nodes2")).repartition(parts, "_deal").drop("_deal")
    found = written(work.mapInPandas(_compare(axes, least, double), "u long, v long, n long"), "vector-links")

    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    labels = components(found.where("v is not null"))
    forget(tiles)
    reps = reps.join(counts, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = reps.groupBy("component").agg(F.min("least_id").alias("component_id"))
    reps = reps.join(ids, "component").select("label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = rows.where("ok").drop("ok").join(reps, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_pca(spark, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), 0.93)
