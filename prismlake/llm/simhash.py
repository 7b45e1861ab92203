"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the Gray code, in which neighbours share
most bits. A node of the index stands for a run of the sorted fingerprints and
holds the bits that all of them share: a mask and a pattern. Lower nodes add the
bits that only they share. Two nodes can hold fingerprints within the radius only
if the bits that both share differ in at most that many places, so a search
descends with the differences accumulated so far and drops whole groups.

For a distributed search each fingerprint is filed radius + 1 times, each time
rotated so that another block of its bits leads. Two fingerprints within the
radius agree in one block at least, so they meet under that block: its value is
the pattern of the topmost node. Sorted runs under one block value are cut into
tiles of bounded size, and pairs of tiles under one block whose nodes aren't too
far apart are compared, each pair in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, forget, table, written, written_slim

#: Fingerprints in a tile, fan-out of the index nodes, and node or fingerprint pairs compared at once.
TILE, FANOUT, AT_ONCE = 1024, 8, 1 << 18
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


# -- fingerprints --------------------------------------------------------------


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included; of no words: 0."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    bits = np.zeros(64, dtype=np.int64)
    last = np.minimum(np.arange(n) + words, len(w)) - 1
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 16):  # bounded memory for very long texts
        span = zip(starts[a : min(n, a + (1 << 16))].tolist(), ends[last[a : a + (1 << 16)]].tolist(), strict=True)
        h = np.array([digest(joined[i:j], seed=42) for i, j in span], dtype=np.uint64)
        bits += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; fp has the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [signed(fingerprint(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# -- the index -----------------------------------------------------------------


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def rotated(code: np.ndarray, by: int) -> np.ndarray:
    return code if by == 0 else (code << np.uint64(by)) | (code >> np.uint64(64 - by))


def shared(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits that the codes from each start to the next share."""
    ones = np.bitwise_and.reduceat(codes, starts)
    zeros = np.bitwise_and.reduceat(~codes, starts)
    return ones | zeros, ones


class GrayIndex:
    """Levels of nodes over one sorted run of fingerprints.

    levels[0] is the fingerprints themselves, with every bit shared; node i of
    level k + 1 stands for nodes FANOUT * i to FANOUT * i + FANOUT - 1 of level k.
    """

    def __init__(self, codes: np.ndarray):
        self.levels = [(np.full(len(codes), ONES), codes)]
        starts = np.arange(0, len(codes), FANOUT)
        size = FANOUT
        while True:
            self.levels.append(shared(codes, starts))
            if len(starts) == 1:
                return
            size *= FANOUT
            starts = np.arange(0, len(codes), size)


def pairs_within(a: GrayIndex, b: GrayIndex, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of a's and b's fingerprints within the radius, in blocks; i < j if they are the same index."""
    while len(a.levels) < len(b.levels):
        a.levels.append(a.levels[-1])
    while len(b.levels) < len(a.levels):
        b.levels.append(b.levels[-1])
    top = len(a.levels) - 1
    used, ones = a.levels[top][0] & b.levels[top][0], a.levels[top][1] ^ b.levels[top][1]
    acc = np.bitwise_count(ones & used)
    zero = np.zeros(1, dtype=np.int64)
    stack = [(top, zero, zero, used[:1], acc[:1].astype(np.int64))] if acc[0] <= radius else []
    fan = np.arange(FANOUT)
    while stack:
        level, i, j, used, acc = stack.pop()
        if level == 0:
            yield i, j
            continue
        (ma, pa_), (mb, pb) = a.levels[level - 1], b.levels[level - 1]
        step = max(1, AT_ONCE // FANOUT**2)
        for k in range(0, len(i), step):
            s = slice(k, k + step)
            # A run that was filled up to the other's height has one child, itself.
            ci = (i[s, None] * FANOUT + fan)[:, :, None] + np.zeros((1, 1, FANOUT), dtype=np.int64)
            cj = (j[s, None] * FANOUT + fan)[:, None, :] + np.zeros((1, FANOUT, 1), dtype=np.int64)
            u = np.broadcast_to(used[s, None, None], ci.shape)
            c = np.broadcast_to(acc[s, None, None], ci.shape)
            ok = (ci < len(ma)) & (cj < len(mb))
            if same:
                ok &= (ci < cj) if level == 1 else (ci <= cj)
            ci, cj, u, c = ci[ok], cj[ok], u[ok], c[ok]
            both = ma[ci] & mb[cj]
            c = c + np.bitwise_count((pa_[ci] ^ pb[cj]) & both & ~u)
            near = c <= radius
            if near.any():
                stack.append((level - 1, ci[near], cj[near], both[near], c[near]))


# -- tiles ---------------------------------------------------------------------

TILE_SCHEMA = "rotation int, block long, tile string, mask long, pattern long, codes binary"


CODE = np.dtype([("code", "<u8")])


def _rows(batch: pd.DataFrame, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(batch), kind)
    for name in kind.names:
        column = batch[name]
        out[name] = np.frombuffer(b"".join(column), np.uint64).reshape(len(out), -1) if column.dtype == object else column.to_numpy().astype(np.int64).view(kind[name].base)
    return out


def _tiles(width: list[int], kind: np.dtype = CODE):
    """Cuts sorted (rotation, code, ...) rows into tiles.

    A tile holds whole blocks and stands alone (block null), or it is a piece of
    one block that is larger than a tile or touches the partition's edge and so
    may go on in the next partition (block set).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0

        def tile(rotation: int, codes: np.ndarray, block: int | None) -> dict:
            nonlocal made
            made += 1
            mask, pattern = shared(np.ascontiguousarray(codes["code"]), np.array([0]))
            return {"rotation": rotation, "block": block, "tile": f"{part}-{made}", "mask": mask.view(np.int64)[0], "pattern": pattern.view(np.int64)[0], "codes": codes.tobytes()}

        def cut(rotation: int, codes: np.ndarray, edge: bool) -> list[dict]:
            """Tiles of one block's codes, which don't fit with others."""
            block = int(codes["code"][0] >> np.uint64(64 - width[rotation]))
            alone = len(codes) <= TILE and not edge
            return [tile(rotation, codes[k : k + TILE], None if alone else block) for k in range(0, len(codes), TILE)]

        held: list[np.ndarray] = []  # whole blocks that make up the next tile
        held_n = 0
        open_, rotation, first = np.empty(0, kind), -1, True  # the block that may go on

        def flush() -> list[dict]:
            nonlocal held, held_n
            out = [tile(rotation, np.concatenate(held), None)] if held else []
            held, held_n = [], 0
            return out

        def close(edge: bool) -> list[dict]:
            """Ends the open block."""
            nonlocal open_, held_n, first
            out: list[dict] = []
            if not len(open_):
                return out
            if first or edge or len(open_) > TILE:
                out += cut(rotation, open_, first or edge)
            else:
                if held_n + len(open_) > TILE:
                    out += flush()
                held.append(open_)
                held_n += len(open_)
            open_, first = np.empty(0, kind), False
            return out

        for batch in batches:
            rows: list[dict] = []
            rot, codes = batch["rotation"].to_numpy(), _rows(batch, kind)
            for r in np.unique(rot):  # ascending, as the rows are
                some = codes[rot == r]
                if r != rotation:
                    rows += close(False) + flush()
                    rotation = int(r)
                blocks = some["code"] >> np.uint64(64 - width[rotation])
                cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
                pieces = np.split(some, cuts)
                for k, piece in enumerate(pieces):
                    goes_on = k == 0 and len(open_) and open_["code"][0] >> np.uint64(64 - width[rotation]) == blocks[0]
                    if not goes_on:
                        rows += close(False)
                    open_ = np.concatenate([open_, piece]) if len(open_) else piece
                    while len(open_) > 2 * TILE:  # a large block leaves as it comes
                        block = int(open_["code"][0] >> np.uint64(64 - width[rotation]))
                        rows.append(tile(rotation, open_[:TILE], block))
                        open_, first = open_[TILE:], True
            if rows:
                yield pd.DataFrame(rows).astype({"block": "Int64"})
        rows = close(True) + flush()
        if rows:
            yield pd.DataFrame(rows).astype({"block": "Int64"})

    return run


def _compare(radius: int, back: list[int]):
    """Links within and between the tiles of each row, as (u, v) of unrotated fingerprints.

    Of linked fingerprints only a spanning forest is returned: one link for each
    fingerprint at most, however many are close to each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, x, y in zip(batch["rotation"], batch["codes"], batch["codes2"], strict=True):
                a = np.frombuffer(x, np.uint64)
                if y is None:
                    index = GrayIndex(a)
                    both, root = a, forest(len(a), pairs_within(index, index, radius, True))
                else:
                    b = np.frombuffer(y, np.uint64)
                    n = len(a)
                    both = np.concatenate([a, b])
                    root = forest(len(both), ((i, j + n) for i, j in pairs_within(GrayIndex(a), GrayIndex(b), radius, False)))
                off = np.flatnonzero(root != np.arange(len(root)))
                if len(off):
                    yield pd.DataFrame({"u": rotated(both[off], back[r]).view(np.int64), "v": rotated(both[root[off]], back[r]).view(np.int64)})

    return run


def tile_pairs(tiles: DataFrame, radius: int, parts: int) -> DataFrame:
    """(rotation, codes, codes2): every tile alone, and the pairs of one block that aren't too far apart."""
    own = tiles.select("rotation", "codes", F.lit(None).cast("binary").alias("codes2"))
    # Pieces of one block meet in pairs, first by their nodes alone.
    nodes = tiles.where("block is not null").select("rotation", "block", "tile", "mask", "pattern")
    other = nodes.select("rotation", "block", F.col("tile").alias("tile2"), F.col("mask").alias("mask2"), F.col("pattern").alias("pattern2"))
    apart = F.bit_count((F.col("pattern").bitwiseXOR(F.col("pattern2"))).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    met = nodes.join(other, ["rotation", "block"]).where((F.col("tile") < F.col("tile2")) & (apart <= radius)).select("rotation", "tile", "tile2")
    codes = tiles.where("block is not null").select("tile", "codes")
    met = met.join(codes, "tile").join(codes.select(F.col("tile").alias("tile2"), F.col("codes").alias("codes2")), "tile2")
    work = own.unionByName(met.select("rotation", "codes", "codes2"))
    # Rows of unequal work are dealt out evenly.
    return work.withColumn("_deal", F.xxhash64("codes", "codes2")).repartition(parts, "_deal").drop("_deal")


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links that connect all fingerprints within `radius` bits of each other.

    distinct: (fp long), without repeats or nulls. The links span the same
    components as all pairs within the radius. Work on a block value held by n
    fingerprints is the tile pairs whose nodes are near enough, each of bounded
    size; nothing is dropped or capped.
    """
    spark = distinct.sparkSession
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    offset, width = edges[:-1], [b - a for a, b in zip(edges, edges[1:], strict=False)]

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = batch["fp"].to_numpy().astype(np.int64).view(np.uint64)
            for k in range(blocks):
                turned = rotated(codes, offset[k])
                # Signed order of the shifted rank is the unsigned order of the rank.
                rank = gray_rank(turned) ^ np.uint64(1 << 63)
                yield pd.DataFrame({"rotation": np.int32(k), "rank": rank.view(np.int64), "code": turned.view(np.int64)})

    filed = distinct.mapInPandas(file, "rotation int, rank long, code long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filed = filed.repartitionByRange(parts, "rotation", "rank").sortWithinPartitions("rotation", "rank")
    tiles = written(filed.select("rotation", "code").mapInPandas(_tiles(width), TILE_SCHEMA), "gray-tiles")
    back = [(64 - o) % 64 for o in offset]
    work = tile_pairs(tiles, radius, parts)
    found = written_slim(work.mapInPandas(_compare(radius, back), "u long, v long"), "gray-links")
    forget(tiles)
    return found


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that it reaches by links.

    docs: doc_id, text; other columns are ignored. Returns (doc_id, fingerprint 16
    hex digits, component_id), one row per row of docs. Texts without words (null
    ones too) have fingerprint 0 and link like any other. Equal fingerprints are
    one node of the index, so copies cost one row each and no pairs. Rows with a
    null doc_id belong to their component but don't name it; a component of such
    rows alone has a null id. No documents give no rows.
    """
    fp = written(fingerprints(docs, words), "fingerprints")
    return _with_components(fp, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_components(fp: DataFrame, radius: int) -> DataFrame:
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "fingerprint-nodes")
    found = components(links(nodes.select("fp"), radius))
    nodes = nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(ids, "component").select("fp", "component_id")
    return fp.join(nodes, "fp")


def op2_simhash_gray(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 2)
