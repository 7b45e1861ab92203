"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its id and text. A source's budget is met by the documents
below a hash threshold, so a selection is a filter and never a sort. The
threshold comes from histograms: words are summed by source and hash bucket, the
running sum names the bucket in which the budget ends, and only that boundary
bucket is split into finer buckets, until it holds one hash. Thresholds for
larger budgets lie above those for smaller ones, so mixes of growing size nest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, document_columns, forget, ordered, table, written, written_slim

#: Hash bits that each histogram resolves, and of all hash bits (15 hex digits).
LEVEL_BITS, HASH_BITS = 12, 60


def word_count(text: str) -> F.Column:
    return F.coalesce(F.expr(rf"regexp_count({text}, '{WORD}')".replace("\\", "\\\\")), F.lit(0)).cast("long")


def row_hash(doc_id: str, text: str) -> F.Column:
    """60 bits of the MD5 of the id and the text's MD5; nulls hash like the text 'null'."""
    null = F.lit("null")
    both = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), null), F.coalesce(F.md5(F.encode(text, "UTF-8")), null))
    return F.conv(F.substring(F.md5(F.encode(both, "UTF-8")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Each source's target by weighted filling up to `most` times its size.

    sizes: (source string, source_size long). Sources take the weights in turn,
    by code point, null last. All targets sum to `share` times all sizes unless
    every source is at its cap. A source is at its cap when cap / weight is at
    most the common level; in the order of cap / weight the sources at their cap
    come first, so the level follows from running sums over that order. Sources
    are put in order by ranges, so no task holds them all, however many there are.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    named, offsets = ordered(sizes.withColumn("none", F.col("source").isNull()), ["none", F.encode("source", "UTF-8")], "mix-sources", "source_size")
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_n0")
    t = named.join(F.broadcast(offsets), "_part").select("source", "source_size", place.alias("i"), (F.col("_source_size") * share).alias("budget"))
    t = t.withColumn("w", weight).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    t, offsets = ordered(t, ["ratio", "i"], "mix-ratios", "cap", "w")
    run = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"caps": F.sum("cap").over(run) - F.col("cap"), "ws": F.sum("w").over(run) - F.col("w")}).join(F.broadcast(offsets), "_part")
    t = t.withColumn("level", (F.col("budget") - F.col("_cap0") - F.col("caps")) / (F.col("_w") - F.col("_w0") - F.col("ws")))
    # From the first source below its cap on, the levels fall: the first is the largest.
    level = t.agg(F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level")))).first()[0]
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("w"))
    return t.select("source", "source_size", target.alias("target"))


def thresholds(slim: DataFrame, budgets: DataFrame, level_bits: int = LEVEL_BITS) -> DataFrame:
    """Nested hash thresholds for budgets.

    slim: (source, size, hash); budgets: (source, budget_id, budget double), any
    number per source. Returns (source, budget_id, threshold): the documents with
    hash < threshold hold the budget's words, to the nearest document (documents
    of one hash go together). Each level reads only the documents in the buckets
    where some budget ends; a bucket is at most 1 / 4096 of its source.
    """
    # lo: the hashes below are in; left: words still wanted from bucket lo on.
    state = budgets.select("source", "budget_id", F.lit(0).cast("long").alias("lo"), F.col("budget").cast("double").alias("left"))
    inside, shift, done = slim, HASH_BITS, []
    while shift > 0:
        width = min(level_bits, shift)
        span, shift = shift, shift - width
        keys = state.select("source", "lo").distinct()
        if span < HASH_BITS:
            inside = inside.withColumn("lo", F.shiftleft(F.shiftright("hash", span), span))
            inside = _same(inside, keys, ["source", "lo"], "left_semi")
        else:
            inside = inside.withColumn("lo", F.lit(0).cast("long"))
        bucket = F.shiftleft(F.shiftright("hash", shift), shift)
        hist = inside.groupBy("source", "lo", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("h0"), F.max("hash").alias("h1"))
        run = Window.partitionBy("source", "lo").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(run)).withColumn("below", F.col("upto") - F.col("words"))
        joined = _same(state, hist, ["source", "lo"], "inner")
        # The first bucket whose running sum passes the budget is the boundary.
        past = F.when(F.col("upto") > F.col("left"), F.struct("bucket", "below", "words", "h0", "h1"))
        state = joined.groupBy("source", "budget_id", "left").agg(F.min(past).alias("at"))
        state = written(state, "mix-level")
        over = F.col("at").isNull()
        one = F.col("at.h0") == F.col("at.h1")
        half = 2 * F.col("at.below") + F.col("at.words") <= 2 * F.col("left")
        closed = state.where(over | one | F.lit(shift == 0))
        done.append(closed.select("source", "budget_id", F.when(over, F.lit(1 << HASH_BITS)).when(half, F.col("at.h0") + 1).otherwise(F.col("at.h0")).cast("long").alias("threshold")))
        state = state.where(~over & ~one).select("source", "budget_id", F.col("at.bucket").alias("lo"), (F.col("left") - F.col("at.below")).alias("left"))
        if shift == 0 or state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _same(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys equal null keys."""
    b = b.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in b.columns])
    cond = None
    for c in on:
        eq = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = eq if cond is None else cond & eq
    return a.join(b, cond, how).drop(*[f"_{c}" for c in on])


def mix_plan(slim: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target, times, threshold) for (source, size, hash) rows, written."""
    plan = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("times", full.cast("long"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")), "mix-plan")
    cut = thresholds(slim, plan.select("source", F.lit(0).alias("budget_id"), F.col("rest").alias("budget")))
    # One small table, so that joins know its size.
    out = written_slim(_same(plan, cut.drop("budget_id"), ["source"], "left").drop("rest"), "mix-cut")
    forget(plan)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How many words of each document a weighted mix takes.

    docs: doc_id, text, source and any other columns, which are ignored. Returns
    (doc_id, size, source_size, target, taken), one row per row of docs. A target
    of r times the source's size takes every document floor(r) times, and the
    documents below a hash threshold once more for the rest.

    Null or empty texts have size 0 and nothing is taken of them. Null sources
    form a source of their own, the last. The hash is that of id and text, so rows
    that share an id or have none part by their texts; only rows that repeat one
    another in both are taken or left together. No documents give no rows. Only
    (hash, id, source, size) is written and read again, never texts.
    """
    slim = docs.select("doc_id", "source", word_count("text").alias("size"), row_hash("doc_id", "text").alias("hash"))
    slim = written(slim, "mix-sizes")
    plan = mix_plan(slim, weights, share, most)
    extra = F.when(F.col("hash") < F.coalesce("threshold", F.lit(0)), 1).otherwise(0)
    out = _same(slim, bounded(plan), ["source"], "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + extra)).alias("taken"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixed_documents(spark, docs: DataFrame, sf_dir: str, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Pipeline stage: the mix itself, documents repeated as often as they are taken.

    Documents without words have nothing to repeat; they stay once. The plan has a
    row a source, so documents aren't shuffled while the sources are few enough to
    be broadcast.
    """
    columns = document_columns(docs)
    keep = docs.select(*columns, word_count("text").alias("_size"), row_hash("doc_id", "text").alias("_hash"))
    slim = written(keep.select("source", F.col("_size").alias("size"), F.col("_hash").alias("hash")), "mix-sizes")
    plan = mix_plan(slim, weights, share, most)
    forget(slim)
    times = F.col("times") + F.when(F.col("_hash") < F.coalesce("threshold", F.lit(0)), 1).otherwise(0)
    out = _same(keep, bounded(plan), ["source"], "left").withColumn("_n", F.when(F.col("_size") == 0, 1).otherwise(times).cast("int"))
    return out.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_one")).drop("_one")


#: Weighted filling in the same closed form; the threshold is a sort here.
ORACLE_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS hash
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS i, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS budget FROM sizes),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((i - 1) % 3 + 1)::INT] AS w FROM ranked),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level0 FROM weighed),
leveled AS (SELECT *, max(CASE WHEN cap > level0 * w THEN level0 END) OVER () AS level FROM levels),
plan AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR cap <= level * w THEN cap ELSE level * w END AS target FROM leveled),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM plan),
hashes AS (
  SELECT source, hash, sum(size) AS words FROM slim GROUP BY source, hash),
runs AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM hashes),
extra AS (
  SELECT r.source, r.hash, 2 * (r.upto - r.words) + r.words <= 2 * (p.target - p.times * p.source_size)
         AND p.target - p.times * p.source_size > 0 AS more
  FROM runs r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source)
SELECT s.doc_id, s.size, p.source_size, p.target,
       s.size * (p.times + CASE WHEN e.more THEN 1 ELSE 0 END)::BIGINT AS taken
FROM slim s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
JOIN extra e ON e.source IS NOT DISTINCT FROM s.source AND e.hash = s.hash
"""
