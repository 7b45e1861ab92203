"""Sharding in Hilbert-curve order.

Several metadata dimensions are quantised to equally filled cells, rows are
sorted by the index of their cell on the Hilbert curve, and the sorted sequence
is cut into runs. A run covers a compact region in all dimensions, so readers
that filter on any of them skip most shards by the files' minima and maxima.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import document_columns, forget, ordered, table, written, written_slim

#: Cells along each dimension, as a power of two.
BITS = 8


def hilbert_index(cells: Sequence[str], bits: int = BITS) -> F.Column:
    """Position of a row's cell on the Hilbert curve through a cube of 2^bits cells a side.

    cells: columns of whole numbers from 0 to below 2^bits, one a dimension, in all
    bits * dimensions < 64. Skilling's transform (2004) as folds over arrays: undo
    the excess rotations from the highest bit to the lowest, Gray-encode, and
    interleave the bits.
    """
    n = len(cells)
    point = f"array({', '.join(f'cast({c} as bigint)' for c in cells)})"
    turns = ", ".join(f"struct({1 << b}L AS q, {d} AS d)" for b in range(bits - 1, 0, -1) for d in range(n))
    # A set bit inverts the lower bits of the first axis; a clear one swaps them with this axis.
    flip = "if((x[s.d] & s.q) <> 0, if(i = 0, v ^ (s.q - 1), v), if(i = 0 OR i = s.d, v ^ ((x[0] ^ x[s.d]) & (s.q - 1)), v))"
    turned = f"aggregate(array({turns}), {point}, (x, s) -> transform(x, (v, i) -> {flip}))" if bits > 1 else point
    gray = f"aggregate({turned}, cast(array() as array<bigint>), (g, v) -> concat(g, array(if(size(g) = 0, v, v ^ g[size(g) - 1]))))"
    lows = ", ".join(f"{1 << b}L" for b in range(bits - 1, 0, -1))
    last = f"aggregate(array({lows}), 0L, (t, q) -> if((g[{n - 1}] & q) <> 0, t ^ (q - 1), t))" if bits > 1 else "0L"
    places = ", ".join(f"struct({b} AS b, {d} AS d)" for b in range(bits - 1, -1, -1) for d in range(n))
    index = f"aggregate(array({places}), 0L, (h, p) -> shiftleft(h, 1) | (shiftright(g[p.d] ^ t, p.b) & 1))"
    # Each step is an array of one value, so that it is worked out once.
    return F.expr(f"transform(transform(array({gray}), g -> struct(g AS g, {last} AS t)), r -> transform(array(r.g), g -> transform(array(r.t), t -> {index})[0])[0])[0]")


def text_bounds(df: DataFrame, column: str, cells: int) -> list[str]:
    """Values at which the column's cells begin, so that cells hold about equally many rows.

    Whole values count, in the order of their bytes; null counts as empty. At most
    `cells` values reach the driver.
    """
    values = df.groupBy(F.coalesce(column, F.lit("")).alias("value")).agg(F.count("*").alias("rows"))
    run, offsets = ordered(values, ["value"], "shard-values", "rows")
    upto = F.sum("rows").over(Window.partitionBy("_part").orderBy("_at"))
    placed = run.withColumn("_upto", upto).join(F.broadcast(offsets), "_part")
    cell = F.expr(f"((_rows0 + _upto - rows) * {cells}) div _rows")
    firsts = placed.groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).select("value").collect()
    forget(run)
    forget(offsets)
    return sorted((r.value for r in firsts), key=lambda v: v.encode())


def number_bounds(df: DataFrame, column: str, cells: int) -> list[int]:
    cuts = df.agg(F.percentile_approx(column, [i / cells for i in range(1, cells)], 100 * cells)).first()[0]
    return sorted(set(cuts or []))


def cell(value: F.Column, bounds: list) -> F.Column:
    """The number of bounds that aren't above the value."""
    if not bounds:
        return F.lit(0)
    inside = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(inside, lambda b: b <= value))


def hilbert_cells(df: DataFrame, texts: Sequence[str], numbers: Sequence[str], bits: int = BITS) -> dict[str, F.Column]:
    """Columns _c0, _c1, ... : the row's cell along each dimension.

    The bounds come from one aggregate a dimension over all rows, and are at most
    2^bits values each, whatever the size of the data.
    """
    cells = 1 << bits
    out = [cell(F.coalesce(c, F.lit("")), text_bounds(df, c, cells)[1:]) for c in texts]
    out += [cell(F.col(c), number_bounds(df, c, cells)) for c in numbers]
    return {f"_c{k}": F.least(c, F.lit(cells - 1)) for k, c in enumerate(out)}


def sorted_positions(df: DataFrame, keys: Sequence, law: str, shards: int, size: str, name: str) -> DataFrame:
    """Cuts `df` in the order of `keys` into shards; adds shard and slot.

    Rows are shuffled once, by range. A row's number within its partition comes from
    the order in which it is read; the partitions' row and byte totals are summed up
    (one row a partition) and added as offsets. law rows: counts at most one apart.
    law bytes: a row goes where the middle of its bytes falls, so that a shard is off
    an equal share by at most one row's bytes; the running sums read places and sizes
    alone, and give the first place of each shard in each partition, which the rows
    look up.
    """
    run, offsets = ordered(df, keys, name, size)
    offsets = offsets.withColumnRenamed(f"_{size}0", "_b0").withColumnRenamed(f"_{size}", "_b")
    at = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_n0")
    if law == "rows":
        # Shard k starts at ceil(k * all / shards).
        run = run.join(F.broadcast(offsets), "_part").withColumn("_pos", at)
        run = run.withColumn("shard", F.expr(f"(_pos * {shards}) div _n").cast("int"))
        first = F.expr(f"(cast(shard as bigint) * _n + {shards} - 1) div {shards}")
        return run.withColumn("slot", (F.col("_pos") - first).cast("long")).drop("_at", "_part", "_pos", *offsets.columns)
    if law != "bytes":
        raise ValueError(f"no such law: {law}")
    slim = run.select("_part", "_at", F.col(size).alias("_s")).withColumn("_upto", F.sum("_s").over(Window.partitionBy("_part").orderBy("_at")))
    slim = slim.join(F.broadcast(offsets), "_part").withColumn("_mid", 2 * (F.col("_b0") + F.col("_upto")) - F.col("_s"))
    slim = slim.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(_mid * {shards}) div greatest(2 * _b, 1)")).cast("int"))
    pieces = slim.groupBy("_part", "shard").agg(F.min("_at").alias("from"), F.min(at).alias("first"))
    # A row for each partition and shard that meet: at most as many as both together.
    first = Window.partitionBy("shard")
    pieces = pieces.withColumn("first", F.min("first").over(first)).groupBy("_part").agg(F.collect_list(F.struct("from", "shard", "first")).alias("_pieces"))
    pieces = written(pieces.join(offsets.select("_part", "_n0"), "_part").coalesce(1), f"{name}-pieces")
    run = run.join(F.broadcast(pieces), "_part").withColumn("_piece", F.array_max(F.filter("_pieces", lambda p: p["from"] <= F.col("_at"))))
    return run.withColumn("shard", F.col("_piece.shard")).withColumn("slot", at - F.col("_piece.first")).drop("_at", "_part", "_n0", "_pieces", "_piece")


def row_size() -> F.Column:
    """UTF-8 bytes of the text plus 16."""
    return (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long")


def hilbert_shards(docs: DataFrame, shards: int = 40, law: str = "rows", bits: int = BITS) -> DataFrame:
    """Assigns each document its shard and its slot in the shard.

    docs: doc_id, text, source, lang; other columns are ignored. Returns (doc_id,
    size, text_crc32, law, shard, slot, grown_shard, hilbert), one row per row of
    docs. size is the UTF-8 bytes of the text plus 16 (null: 16), text_crc32 that
    of the text (null: of no bytes, 0).

    Equal texts are a group. A group lies at the smallest Hilbert index of its rows,
    so its rows follow one another in the order of all rows and share a shard unless
    a cut falls into the group; the law comes first then, as a group may be larger
    than a shard. Groups of one index are ordered by the hash of the text, rows of a
    group by doc_id, nulls first; repeated rows are numbered as they come. Null and
    empty sources or languages share the lowest cell. Fewer documents than shards
    leave shards empty; no documents give no rows. Only metadata moves, not texts.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select("doc_id", "source", "lang", row_size().alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    slim = written(slim, "shard-sizes")
    places = hilbert_cells(slim, ["source", "lang"], ["size"], bits)
    cells = slim.withColumns(places).withColumn("hilbert", hilbert_index(list(places), bits)).drop("source", "lang", *places)
    cells = written(cells, "shard-cells")
    forget(slim)
    # Most texts occur once and lie where they are; the others take the first place of their group.
    groups = cells.groupBy("h1", "h2").agg(F.min("hilbert").alias("_least"), F.max("hilbert").alias("_most")).where("_least < _most")
    groups = written_slim(groups.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "_least"), "shard-groups")
    spread = cells.join(groups, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    spread = spread.select("doc_id", "size", "text_crc32", "h1", "h2", F.coalesce("_least", "hilbert").alias("hilbert"))
    out = sorted_positions(spread, ["hilbert", "h1", "h2", "doc_id"], law, shards, "size", "shard-run")
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op1_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


def sharded_documents(docs: DataFrame, shards: int = 40, law: str = "bytes", bits: int = BITS) -> DataFrame:
    """Pipeline stage: whole documents with shard and slot, for a write by shard.

    Texts are shuffled once, into the order along the curve. Rows of one index are
    ordered by the hash of the text and doc_id; otherwise as `hilbert_shards`, whose
    cases hold here, too.
    """
    columns = document_columns(docs)
    slim = written(docs.select("source", "lang", row_size().alias("size")), "shard-sizes")
    places = hilbert_cells(slim, ["source", "lang"], ["size"], bits)
    forget(slim)
    wide = docs.select(*columns, row_size().alias("size"), F.xxhash64("text").alias("_h")).withColumns(places)
    wide = wide.withColumn("hilbert", hilbert_index(list(places), bits)).drop(*places)
    out = sorted_positions(wide, ["hilbert", "_h", "doc_id"], law, shards, "size", "shard-run")
    return out.select(*columns, "size", "shard", "slot", "hilbert")
