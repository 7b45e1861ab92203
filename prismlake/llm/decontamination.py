"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item of m words is compared with windows of m words. Windows and
items get a SimHash of their words, and a multi-index over blocks of the
fingerprint finds all pairs within a Hamming radius: if the fingerprints of a
pair differ in at most RADIUS bits, one of the BLOCKS blocks differs in at most
RADIUS // BLOCKS bits, and the index holds every value so near to the item's
block. An exact similarity of weighted word shingles verifies the candidates.

Only windows that can be similar enough are made. A similarity of t leaves at
most (1 - t) of an item's shingles without a match, so of any more shingles than
that at least one occurs in the window. The choice falls on those with the
longest words. A scan looks each word of the documents up among the longest words
of the chosen shingles, compares the shingle, and makes the windows around.

Built from DataFrame operations only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, document_columns, table, written, written_slim

RADIUS, BLOCKS = 23, 8
#: Rows of chosen shingles that are broadcast at once; a larger benchmark is worked off in blocks of items.
CHOSEN_ROWS = 200_000
#: Tasks that prepare the benchmark.
ITEM_TASKS = 8

WORDS = r"array_remove(split(lower({}), '[^\\p{{L}}\\p{{N}}]+'), '')"


def words(text: str) -> F.Column:
    """Lower-cased runs of letters and digits."""
    return F.coalesce(F.expr(WORDS.format(text)), F.array().cast("array<string>"))


def _lanes(longest: int) -> int:
    """Bits of a counter that counts to `longest`."""
    return next(b for b in (8, 16, 32) if longest < 1 << b)


def simhash(hashes: str, lanes: int) -> F.Column:
    """SimHash of an array of 64-bit hashes.

    The 64 counters lie side by side in `lanes` longs: long j counts, in lanes of
    that many bits, the hash bits j, j + lanes, j + 2 * lanes and so on.
    """
    mask = sum(1 << k for k in range(0, 64, lanes))
    zero = "named_struct(" + ", ".join(f"'c{j}', 0L" for j in range(lanes)) + ")"
    step = "named_struct(" + ", ".join(f"'c{j}', a.c{j} + (shiftright(h, {j}) & {mask}L)" for j in range(lanes)) + ")"
    full = (1 << lanes) - 1

    def bit(i: int) -> str:
        value = f"shiftleft(1L, {i})"
        return f"if((shiftright(a.c{i % lanes}, {i - i % lanes}) & {full}L) * 2 > size({hashes}), {value}, 0L)"

    end = " | ".join(bit(i) for i in range(64))
    # Not null to the planner, which would otherwise test it in a filter of its own.
    return F.coalesce(F.expr(f"aggregate({hashes}, {zero}, (a, h) -> {step}, a -> {end})"), F.lit(0).cast("long"))


def benchmark_items(benchmark: DataFrame, shingle: int) -> DataFrame:
    """(item, m, n, words, shingles) for each distinct word sequence that has words.

    n is the words of a shingle: `shingle`, or all of a shorter item.
    """
    items = benchmark.select(words("text").alias("words")).where("size(words) > 0").distinct()
    items = items.withColumn("m", F.size("words")).withColumn("n", F.least(F.lit(shingle), F.size("words")))
    shingles = F.expr("transform(sequence(0, m - n), i -> array_join(slice(words, i + 1, n), ' '))")
    return items.select(F.xxhash64("words").alias("item"), "m", "n", "words", shingles.alias("shingles"))


def chosen_shingles(items: DataFrame, least: float) -> DataFrame:
    """(probe, off, shingle, n, m): of each item so many shingles that a similar window has one of them.

    probe is the shingle's longest word, off its place.
    """
    each = items.select("m", "n", "item", F.posexplode("shingles").alias("at", "shingle"), F.size("shingles").alias("k"))
    each = each.withColumn("w", F.split("shingle", " "))
    each = each.withColumn("long", F.expr("array_max(transform(w, x -> length(x)))"))
    each = each.withColumn("off", F.expr("array_position(transform(w, x -> length(x)), long) - 1").cast("int"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("long"), "at"))
    # At most k - ceil(least * k) shingles lack a match.
    enough = F.col("k") - F.ceil(F.col("k") * least - 1e-9) + 1
    each = each.withColumn("rank", rank).where(F.col("rank") <= enough)
    return each.select(F.element_at("w", F.col("off") + 1).alias("probe"), "off", "shingle", "n", "m").distinct()


def windows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, m, n, start, win): every m-word window that has a chosen shingle, once.

    chosen is broadcast; the caller bounds its rows by CHOSEN_ROWS. Documents of fewer than
    m words are one window. Only the words around a hit are shuffled. Windows are
    as many as the words of the passages that are found.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), words("text").alias("words"))
    each = base.select("*", F.posexplode("words").alias("at", "word"))
    hits = each.join(F.broadcast(chosen), F.col("word") == F.col("probe"))
    hits = hits.withColumn("p", F.col("at") - F.col("off")).where("p >= 0 AND array_join(slice(words, p + 1, n), ' ') = shingle")
    hits = hits.select("doc_id", "h1", "h2", "m", "n", "p", F.expr("size(words)").alias("size"), F.expr("greatest(0, p + n - m)").alias("r0"), F.expr("slice(words, greatest(0, p + n - m) + 1, 2 * m - n)").alias("region"))
    # Few rows become many here, so the number of partitions doesn't follow their bytes.
    hits = hits.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "h1", "h2", "m")
    # The first hit in a window makes it, so each window is made once.
    before = F.lag("p").over(Window.partitionBy("doc_id", "h1", "h2", "m", "n").orderBy("p"))
    hits = hits.withColumn("first", F.greatest(F.coalesce(before + 1, F.lit(0)), F.col("r0"))).withColumn("last", F.expr("least(p, greatest(size - m, 0))"))
    hits = hits.where("first <= last")
    made = hits.select("doc_id", "h1", "h2", "m", "n", "r0", "region", F.explode(F.sequence("first", "last")).alias("start"))
    return made.select("doc_id", "h1", "h2", "m", "n", "start", F.expr("slice(region, start - r0 + 1, m)").alias("win"))


def block_values(radius: int) -> F.Column:
    """All (block, value) under which the index files fingerprint `fp`."""
    width, flips = 64 // BLOCKS, radius // BLOCKS
    masks = [sum(1 << b for b in c) for f in range(flips + 1) for c in combinations(range(width), f)]
    each = ", ".join(f"transform(array({', '.join(map(str, masks))}), x -> struct({b} AS block, cast(shiftright(fp, {b * width}) & {(1 << width) - 1} ^ x AS int) AS value))" for b in range(BLOCKS))
    return F.expr(f"flatten(array({each}))")


def candidates(wins: DataFrame, items: DataFrame, radius: int, lanes: int) -> DataFrame:
    """Pairs of windows and items of one size whose fingerprints are within the radius."""
    width, flips = 64 // BLOCKS, radius // BLOCKS
    index = items.select("item", "m", F.expr("transform(words, w -> xxhash64(w))").alias("hashes"))
    index = index.select("item", "m", simhash("hashes", lanes).alias("fp"))
    index = written(index.select("item", F.col("m").alias("m2"), F.col("fp").alias("fp2"), F.inline(block_values(radius))).coalesce(ITEM_TASKS), "benchmark-index")
    wins = wins.withColumn("hashes", F.expr("transform(win, w -> xxhash64(w))")).withColumn("fp", simhash("hashes", lanes)).drop("hashes")
    # A window looks up its own block values; flips were filed by the index.
    own = F.expr("array(" + ", ".join(f"struct({b} AS b, cast(shiftright(fp, {b * width}) & {(1 << width) - 1} AS int) AS v)" for b in range(BLOCKS)) + ")")
    wins = wins.select("*", F.inline(own))
    met = wins.join(bounded(index), (F.col("m") == F.col("m2")) & (F.col("b") == F.col("block")) & (F.col("v") == F.col("value")))
    # The first block that agrees reports the pair.
    earlier = " + ".join(f"if({b} < b AND bit_count(shiftright(fp ^ fp2, {b * width}) & {(1 << width) - 1}) <= {flips}, 1, 0)" for b in range(BLOCKS - 1))
    met = met.withColumn("hamming", F.expr("bit_count(fp ^ fp2)").cast("int")).where(f"hamming <= {radius} AND {earlier} = 0")
    return met.select("doc_id", "h1", "h2", "m", "n", "start", "win", "item", "hamming")


def labelled(shingles: str) -> str:
    """The shingles as a set: the k-th repeat of one gets a number, so that set sizes count repeats."""
    run = f"array_sort({shingles})"
    number = f"transform({run}, (x, i) -> if(i = array_position({run}, x) - 1, x, concat(x, '#', i - array_position({run}, x) + 1)))"
    return f"if(size(array_distinct({shingles})) = size({shingles}), {shingles}, {number})"


def verified(met: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Candidates whose shingles, weighted by how often they occur, are similar enough.

    The similarity is the sum of the smaller over the sum of the larger weights.
    """
    mine = items.select("item", F.size("shingles").alias("ki"), F.expr(labelled("shingles")).alias("theirs"))
    if items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] <= CHOSEN_ROWS:
        mine = F.broadcast(mine)
    each = met.withColumn("shingles", F.expr("transform(sequence(0, size(win) - n), i -> array_join(slice(win, i + 1, n), ' '))")).drop("win")
    each = each.join(mine, "item")
    # Generated, so that the overlap is worked out once and not again in the filter.
    both = F.struct(F.size(F.array_intersect(F.expr(labelled("shingles")), "theirs")).alias("o"), F.size("shingles").alias("kw"))
    each = each.select("doc_id", "h1", "h2", "m", "start", "item", "hamming", "ki", F.inline(F.array(both)))
    each = each.withColumn("similarity", F.col("o") / (F.col("kw") + F.col("ki") - F.col("o")))
    return each.where(F.col("similarity") >= least)


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The best window of each document for each benchmark item that it holds.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Returns
    (doc_id, h1, h2, item, start, words, similarity, hamming): start is in words, the
    hashes are those of the text. Words are lower-cased runs of letters and digits.
    Items of fewer than `shingle` words are one shingle, those without words are
    found nowhere; null texts hold nothing. Of equal similarities the earliest window
    counts. Repeated rows give one result, repeated items one each. Documents of
    fewer words than an item are compared with it as a whole. Empty tables give no
    rows.

    The shingles that are looked for are broadcast in blocks of about CHOSEN_ROWS rows:
    the documents are scanned once for each block. The index and the items' shingles
    are broadcast only if they are counted to be few, and else shuffled to the
    windows. No document is compared with more than the items whose shingles it has.
    """
    items = written(benchmark_items(benchmark, shingle).coalesce(ITEM_TASKS), "benchmark-items")
    shingles = F.size("shingles")
    size = items.agg(F.sum(shingles - F.ceil(shingles * least - 1e-9) + 1).alias("n"), F.max("m").alias("m")).first()
    blocks = max(1, -(-int(size["n"] or 0) // CHOSEN_ROWS))
    lanes = _lanes(max(size["m"] or 1, 1))
    out = None
    for k in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod("item", F.lit(blocks)) == k)
        found = verified(candidates(windows(docs, chosen_shingles(some, least)), some, radius, lanes), some, least)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_id", "h1", "h2", "item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "m", "hamming")).alias("b"))
    return best.select("doc_id", "h1", "h2", "item", "b.start", F.col("b.m").alias("words"), (-F.col("b.s")).alias("similarity"), "b.hamming")


def with_item_ids(found: DataFrame, benchmark: DataFrame) -> DataFrame:
    ids = benchmark.select("item_id", words("text").alias("words")).where("size(words) > 0").select("item_id", F.xxhash64("words").alias("item")).distinct()
    return found.join(ids, "item").drop("item")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    found = contaminated(table(spark, sf_dir, "documents"), benchmark)
    return with_item_ids(found, benchmark).select("doc_id", "item_id", "start", "words", F.round("similarity", 6).alias("similarity"), "hamming")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item, unchanged."""
    found = written_slim(contaminated(docs, benchmark).select("doc_id", "h1", "h2").distinct(), "contaminated")
    found = found.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h1")) & (F.xxhash64(F.lit(1), "text") == F.col("_h2"))
    return docs.select(*document_columns(docs)).join(bounded(found), same, "left_anti")
