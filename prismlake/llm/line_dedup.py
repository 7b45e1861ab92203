"""Line deduplication over levelled sorted runs of line hashes.

The lines known so far are kept as runs: tables of line hashes, hash-bucketed and
sorted within the buckets, each hash in one run only. A new batch counts its own
lines and is merge-anti-joined with the runs bucket by bucket, without a shuffle:
hashes that no run has become a run of their own on level 0, the others a run of
repeats, with the number of documents that they add. When a level has `fanout` runs
they are merged into one run of the next level, so a hash is rewritten a
logarithmic number of times and a batch joins a logarithmic number of runs. A
manifest in the runs' folder lets a later session go on with them.

Built from DataFrame operations only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, ascii_lower, delete, document_columns, forget, new_path, table, written, written_slim

KEY = ["k1", "k2"]
#: Positions of dropped lines that a join may broadcast, besides BROADCAST_ROWS rows.
BROADCAST_LINES = 2_000_000


def key_hash(key: str) -> list[F.Column]:
    """128 bits of a key, as two numbers."""
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")]


class LineRuns:
    """Runs of lines and of their repeats, in a folder that all executors share.

    A row is (k1, k2, docs): a line's hash and the number of documents that have it.
    home: the folder, which stays; what it holds already is taken up, with its number
    of buckets. Without one the runs are temporary and go with `close`. One writer
    at a time: a batch is in the manifest when `add` has returned, and not before.
    """

    def __init__(self, spark: SparkSession, home: str | None = None, fanout: int = 2):
        self.spark, self.fanout, self.kept = spark, fanout, home is not None
        self.home = home.rstrip("/") if home else new_path(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Runs and repeats by level: (table, path).
        self.runs: list[list[tuple[str, str]]] = [[]]
        self.repeats: list[list[tuple[str, str]]] = [[]]
        if self.kept:
            self._open()

    def _file(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _open(self) -> None:
        fs, path = self._file(f"{self.home}/manifest")
        if not fs.exists(path):
            return
        said = json.loads(self.spark.read.text(f"{self.home}/manifest", wholetext=True).first()[0])
        self.buckets = said["buckets"]
        self.runs, self.repeats = ([[(self._registered(p), p) for p in level] for level in said[k]] for k in ("runs", "repeats"))

    def _registered(self, path: str) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        key = ", ".join(KEY)
        self.spark.sql(f"CREATE TABLE {name} (k1 BIGINT, k2 BIGINT, docs BIGINT) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _save(self) -> None:
        """Replaces the manifest in one step."""
        said = {"buckets": self.buckets} | {k: [[p for _, p in level] for level in v] for k, v in (("runs", self.runs), ("repeats", self.repeats))}
        fs, new = self._file(f"{self.home}/manifest.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        _, path = self._file(f"{self.home}/manifest")
        fs.delete(path, False)
        fs.rename(new, path)

    def store(self, rows: DataFrame) -> tuple[str, str]:
        """Writes a sorted run of rows that are partitioned as the buckets are."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.home}/{name}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name, path

    def drop(self, *tables: tuple[str, str]) -> None:
        for name, path in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)

    def read(self, run: tuple[str, str]) -> DataFrame:
        return self.spark.table(run[0])

    def add(self, batch: DataFrame) -> None:
        """Takes in a batch, (k1, k2, docs) with each hash in one row."""
        old: list[tuple[str, str]] = []
        came = self.store(batch.select(*KEY, "docs").repartition(self.buckets, *KEY))
        known = [run for level in self.runs for run in level]
        if known:
            fresh = self.read(came)
            for run in known:
                fresh = fresh.join(self.read(run).hint("merge"), KEY, "left_anti")
            new = self.store(fresh)
            again = self.read(came).join(self.read(new).hint("merge"), KEY, "left_anti")
            self.repeats[0].append(self.store(again))
            old, came = [came], new
        self.runs[0].append(came)
        old += self._compact(self.runs) + self._compact(self.repeats)
        if self.kept:
            self._save()
        self.drop(*old)

    def _compact(self, levels: list[list[tuple[str, str]]]) -> list[tuple[str, str]]:
        """Merges full levels, bucket by bucket; returns the runs that were merged."""
        old: list[tuple[str, str]] = []
        for k, level in enumerate(levels):
            if len(level) < self.fanout:
                continue
            merged = self.read(level[0])
            for run in level[1:]:
                both = merged.join(self.read(run).withColumnRenamed("docs", "more").hint("merge"), KEY, "full_outer")
                merged = both.select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
            name = self.store(merged)
            old += level
            levels[k] = []
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(name)
        return old

    def frequent(self, least: int) -> DataFrame:
        """(k1, k2) of the lines that at least `least` documents have."""
        out = None
        for run in (r for level in self.runs for r in level):
            some = self.read(run)
            for more in (r for level in self.repeats for r in level):
                some = some.join(self.read(more).withColumnRenamed("docs", "more").hint("merge"), KEY, "left")
                some = some.select(*KEY, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"))
            some = some.where(F.col("docs") >= least).select(*KEY)
            out = some if out is None else out.unionByName(some)
        return out

    def close(self) -> None:
        """Takes the tables out of the catalogue; temporary runs are deleted."""
        for name, _ in (r for levels in (self.runs, self.repeats) for level in levels for r in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not self.kept:
            delete(self.spark, self.home)


def keys(text: str) -> F.Column:
    """Each line's key: A-Z lower-cased, whitespace stripped at both ends."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(SPACES)))


def counted_lines(docs: DataFrame, shortest: int) -> DataFrame:
    """(k1, k2, docs): how many rows of docs have each line key of at least `shortest` code points."""
    found = docs.select(F.explode(F.array_distinct(keys("text"))).alias("key")).where(F.length("key") >= shortest)
    return found.select(*key_hash("key")).groupBy(*KEY).agg(F.count("*").alias("docs"))


def repeated_lines(docs: DataFrame, least: int = 10, shortest: int = 1, batches: int = 4, home: str | None = None) -> DataFrame:
    """(k1, k2) of the line keys found in at least `least` rows of docs, and of what `home` holds from earlier calls.

    The rows of docs come in `batches`, by the hash of their id; each batch counts its
    own lines and meets those before it in the runs alone.
    """
    runs = LineRuns(docs.sparkSession, home)
    for b in range(batches):
        batch = docs if batches == 1 else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b)
        runs.add(counted_lines(batch, shortest))
    out = written_slim(runs.frequent(least), "repeated-lines")
    runs.close()
    return out


def without_repeated_lines(docs: DataFrame, least: int = 10, shortest: int = 1, batches: int = 4, home: str | None = None) -> DataFrame:
    """Documents without the lines that many documents have.

    docs: doc_id, text and any other columns. Returns the columns of documents that
    docs has, with the text that is left, and n_lines (before) and n_dropped, one
    row per row of docs. Texts are split at newlines; null and empty texts are one
    empty line and stay as they are. A line's key is the line without whitespace at
    its ends and with A-Z lower-cased; keys shorter than `shortest` code points
    stay. All lines of a dropped key go, in every document. Rows count as documents
    of their own even if their ids or texts repeat; a document counts once for a
    line however often it has it. No rows give no rows. With a `home`, lines of
    documents that came before count, too.

    Only hashes are joined with the repeated lines. A line that a third of all
    documents have is a skewed key of that join, which adaptive execution splits.
    The positions of dropped lines are brought to the texts if they are counted to be
    few, and else texts are shuffled once to meet them; texts are put together from
    the runs between those positions, in linear time.
    """
    frequent = repeated_lines(docs, least, shortest, batches, home)
    columns = document_columns(docs)
    ident = [F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2")]
    lines = docs.select("doc_id", *ident, F.posexplode(keys("text")).alias("_at", "_key")).where(F.length("_key") >= shortest)
    lines = lines.select("doc_id", "_h1", "_h2", "_at", *key_hash("_key"))
    hits = lines.join(frequent, KEY, "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"))
    hits = written(hits.agg(F.sort_array(F.collect_set("_at")).alias("_gone")), "dropped-lines")
    forget(frequent)
    size = hits.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_gone")), F.lit(0)).alias("lines")).first()
    if size["rows"] <= BROADCAST_ROWS and size["lines"] <= BROADCAST_LINES:
        hits = F.broadcast(hits)
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines")
    whole = docs.select(*[c for c in columns if c != "text"], *ident, F.col("text").isNull().alias("_null"), split)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    out = whole.join(hits, same, "left")
    left = F.expr(
        "array_join(flatten(transform(sequence(0, size(_gone)), j -> slice(_lines,"
        " if(j = 0, 1, _gone[j - 1] + 2),"
        " if(j = size(_gone), size(_lines), _gone[j]) - if(j = 0, 0, _gone[j - 1] + 1)))), '\\n')"
    )
    text = F.when(F.col("_null"), F.lit(None)).when(F.col("_gone").isNull(), F.array_join("_lines", "\n")).otherwise(left)
    return out.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in columns],
        F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op10_line_runs(spark, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(table(spark, sf_dir, "documents"), 10, 1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM docs),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key
GROUP BY r, doc_id
"""
