"""Quality by co-training two views of a document.

One classifier sees the text alone, the other the page's metadata alone (source,
language, stated length). In each round either one labels unlabelled documents
that it is sure of, and these train the other. In the end both views are
calibrated on labelled documents that neither was trained on, and a logistic
curve over the two calibrated views scores every document.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_columns, forget, table, written

#: The most labelled rows that a fit uses, and the tasks that these are spread over.
FIT_ROWS, SAMPLE_TASKS = 20_000, 16
#: Rounds of co-training; sure is a calibrated probability this near 0 or 1; share of the labelled rows that a round may add of a class.
ROUNDS, SURE, GROW = 4, 0.05, 0.2
#: Hash buckets of words, sources, languages, and classes of stated lengths.
WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS, LENGTHS = 64, 64, 16, 24

_RUN = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
_CLASSES = [b"0123456789", bytes(range(65, 91)), b".,;:", b"!?", b"|/\\<>[]{}", b"#$%&*@^~_+=", b"\"'()-", b"\n"]
N_TEXT = 18 + len(_CLASSES) + WORD_BUCKETS
N_META = 4 + SOURCE_BUCKETS + LANG_BUCKETS + LENGTHS


def text_view(text: str | None) -> np.ndarray:
    """Shape, repetition and hashed words of a whole text; a text without words has its own flag."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words, lines = text.split(), text.split("\n")
    n, size = len(words), max(len(raw), 1)
    out = np.zeros(N_TEXT)
    if not n:
        out[0] = 1
        return out
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    top = counts.most_common(3)
    own = Counter(x.strip() for x in lines)
    runs = _RUN.findall(raw)
    out[1:18] = (
        math.log1p(n), math.log1p(size), lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths >= 15).mean(),
        len(counts) / n, len(counts) / math.sqrt(n), sum(c for _, c in top) / n, top[0][1] / n,
        sum(map(operator.eq, words, words[1:])) / n, math.log1p(len(lines)), n / len(lines), 1 - len(own) / len(lines),
        len(runs) / n, sum(map(len, runs)) / size, (len(raw) - len(text)) / size,
    )
    out[18 : 18 + len(_CLASSES)] = [(len(raw) - len(raw.translate(None, c))) / size for c in _CLASSES]
    buckets = np.bincount([zlib.crc32(w.encode("utf-8", "replace")) % WORD_BUCKETS for w in counts], minlength=WORD_BUCKETS)
    out[18 + len(_CLASSES) :] = np.sqrt(buckets / len(counts))
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language, and the stated length in half powers of two; nulls have flags."""
    out = np.zeros(N_META)
    for k, (value, buckets, at) in enumerate(((source, SOURCE_BUCKETS, 4), (lang, LANG_BUCKETS, 4 + SOURCE_BUCKETS))):
        if value is None:
            out[k] = 1
        else:
            out[at + zlib.crc32(value.encode("utf-8", "replace")) % buckets] = 1
    if n_chars is None:
        out[2] = 1
    else:
        size = math.log2(1 + max(0, n_chars))
        out[3] = size / 20
        out[N_META - LENGTHS + min(LENGTHS - 1, int(size))] = 1
    return out


def _blocks(x: np.ndarray) -> list[slice]:
    """Slices of rows, so that work on a matrix of 32-bit numbers needs little more than itself."""
    return [slice(k, k + 2048) for k in range(0, len(x), 2048)]


@dataclass
class Logistic:
    """Ridge-regularised logistic regression on standardised columns."""

    ridge: float = 1.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Logistic:
        w, d = np.ones(len(y)) if w is None else w, x.shape[1]
        n = max(len(x), 1)
        self.mean = sum((x[s].sum(axis=0, dtype=np.float64) for s in _blocks(x)), np.zeros(d)) / n
        self.scale = np.sqrt(sum((((x[s] - self.mean) ** 2).sum(axis=0) for s in _blocks(x)), np.zeros(d)) / n)
        self.scale = np.where(self.scale > 1e-9, self.scale, 1.0)
        pull = np.full(d + 1, self.ridge)
        pull[0] = 1e-3
        b = np.zeros(d + 1)
        for _ in range(25):
            bend, slope = np.diag(pull), -pull * b
            for s in _blocks(x):
                z = np.hstack([np.ones((len(x[s]), 1)), (x[s] - self.mean) / self.scale])
                p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
                bend = bend + (z.T * (w[s] * p * (1 - p))) @ z
                slope = slope + z.T @ (w[s] * (y[s] - p))
            step = np.linalg.solve(bend, slope)
            b += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-7:
                break
        self.weights = b
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        each = [self.weights[0] + ((x[s] - self.mean) / self.scale) @ self.weights[1:] for s in _blocks(x)]
        return np.clip(np.concatenate(each), -15, 15) if each else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class CoTrained:
    """Two views, a calibration for each, and their combination."""

    views: list[Logistic]
    scales: list[Logistic]
    both: Logistic
    added: list[tuple[int, int]] = field(default_factory=list)

    def calibrated(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.scales, (text, meta), strict=True)], axis=1)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The combined score and the two views' own probabilities."""
        z = self.calibrated(text, meta)
        return self.both.probability(z), 1 / (1 + np.exp(-z))


Pick = Callable[[list[Logistic], list[Logistic], list[list[int]]], list[list[np.ndarray]]]


def _sure(view: Logistic, scale: Logistic, x: np.ndarray) -> list[np.ndarray]:
    """How far the rows are from being surely bad and surely good; rounded, so that blocks of any size say the same."""
    p = np.round(scale.probability(view.logit(x)[:, None]), 9)
    return [p, np.round(1 - p, 9)]


def co_train(x: list[np.ndarray], y: np.ndarray, fold: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """`co_train_from` with all unlabelled rows, in both views, at hand."""
    left = np.ones(len(pool[0]), dtype=bool)

    def pick(views: list[Logistic], scales: list[Logistic], shares: list[list[int]]) -> list[list[np.ndarray]]:
        found = []
        for v in (0, 1):
            for off, share in zip(_sure(views[v], scales[v], pool[v]), shares[v], strict=True):
                sure = np.flatnonzero(left & (off <= SURE))
                found.append(sure[np.argsort(off[sure], kind="stable")][:share])
        left[np.concatenate(found)] = False
        return [[pool[1][k] for k in found[:2]], [pool[0][k] for k in found[2:]]]

    return co_train_from(x, y, fold, pick, rounds)


def co_train_from(x: list[np.ndarray], y: np.ndarray, fold: np.ndarray, pick: Pick, rounds: int = ROUNDS) -> CoTrained:
    """Co-trains on the rows of folds 0 to 3 and calibrates on fold 4.

    x: the labelled rows in both views. pick: for each view the unlabelled rows, not
    picked before, that it is surest are bad and are good, at most a share of each, as
    the other view sees them. A view that is sure of nothing adds nothing. Too few
    rows or classes to calibrate on are made up by all rows.
    """
    train, held = fold != 4, fold == 4
    if len(set(y[held])) < 2 or len(set(y[train])) < 2:
        train = held = np.ones(len(y), dtype=bool)
    given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    added = []
    for r in range(rounds + 1):
        views, scales = [], []
        for v in (0, 1):
            rows = np.concatenate([x[v][train]] + [new for new, _ in given[v]])
            marks = np.concatenate([y[train]] + [m for _, m in given[v]])
            weight = np.concatenate([np.ones(train.sum())] + [np.full(len(m), 0.5) for _, m in given[v]])
            views.append(Logistic(3.0).fit(rows, marks, weight))
            scales.append(Logistic(0.1).fit(views[v].logit(x[v][held])[:, None], y[held]))
        if r == rounds or len(set(y[train])) < 2:
            break
        most = max(1, int(GROW * train.sum()))
        shares = [max(1, int(most * (y[train] == mark).mean())) for mark in (0.0, 1.0)]
        found = pick(views, scales, [shares, shares])
        if not any(len(new) for each in found for new in each):
            break  # further rounds would say the same
        for v in (0, 1):
            given[1 - v] += [(new, np.full(len(new), mark)) for new, mark in zip(found[v], (0.0, 1.0), strict=True)]
        added.append((sum(map(len, found[0])), sum(map(len, found[1]))))
    model = CoTrained(views, scales, Logistic(0.1), added)
    model.both.fit(model.calibrated(x[0][held], x[1][held]), y[held])
    return model


def _surest(views: list[Logistic], scales: list[Logistic], shares: list[list[int]], gone: np.ndarray):
    """(g, off, doc_id, row): a task's surest rows of each view and mark, g, none of which is gone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, pd.DataFrame] = {}
        for b in batches:
            b = b[~np.isin(b["row"].to_numpy(), gone)]
            if not len(b):
                continue
            for v, c in ((0, "t"), (1, "m")):
                x = np.frombuffer(b"".join(b[c]), np.float32).reshape(len(b), -1)
                for mark, off in enumerate(_sure(views[v], scales[v], x)):
                    g, ok = 2 * v + mark, off <= SURE
                    new = pd.DataFrame({"g": np.int32(g), "off": off[ok], "doc_id": b["doc_id"].to_numpy()[ok], "h": b["h"].to_numpy()[ok], "row": b["row"].to_numpy()[ok]})
                    new = pd.concat([best[g], new]) if g in best else new
                    best[g] = new.sort_values(["off", "doc_id", "h"], kind="stable").head(shares[v][mark])
        yield from (rows for rows in best.values() if len(rows))

    return run


def _pick_from(pool: DataFrame) -> Pick:
    """Picks from all rows of a written table (doc_id, h, row, t, m), scored where they lie; the driver gets the picked rows only."""
    gone = np.empty(0, np.int64)

    def pick(views: list[Logistic], scales: list[Logistic], shares: list[list[int]]) -> list[list[np.ndarray]]:
        nonlocal gone
        best = written(pool.mapInPandas(_surest(views, scales, shares, gone), "g int, off double, doc_id long, h long, row long"), "quality-sure")
        rows = []
        for g in range(4):
            top = best.where(F.col("g") == g).orderBy("off", "doc_id", "h").limit(shares[g // 2][g % 2])
            rows.append(np.array([r.row for r in top.select("row", "off", "doc_id", "h").collect()], dtype=np.int64))
        forget(best)
        mine = np.unique(np.concatenate(rows))
        gone = np.concatenate([gone, mine])
        if not len(mine):
            return [[np.empty((0, n), np.float32)] * 2 for n in (N_META, N_TEXT)]

        def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[np.isin(b["row"].to_numpy(), mine)]

        got = {r.row: (r.t, r.m) for r in pool.select("row", "t", "m").mapInPandas(chosen, "row long, t binary, m binary").collect()}
        see = lambda k, c, n: np.frombuffer(b"".join(bytes(got[r][c]) for r in rows[k].tolist()), np.float32).reshape(-1, n)
        return [[see(0, 1, N_META), see(1, 1, N_META)], [see(2, 0, N_TEXT), see(3, 0, N_TEXT)]]

    return pick


def _held_out(doc_id: str) -> str:
    return f"pmod(crc32(encode(cast({doc_id} as string), 'UTF-8')), 4) = 2"


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, pool: int | None = None) -> CoTrained:
    """Co-trains on at most `rows` labelled and all unlabelled documents, or at most `pool` of them.

    A sample is the documents with the least hash of their id, the same in every run.
    Ids whose CRC-32 is 2 modulo 4 are held out of both. Repeated labels of an id count
    once, good only if all say so. Every round scores all unlabelled documents on the
    executors; the driver gets the features of the labelled rows and of the picked ones.
    """
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(f"NOT {_held_out('doc_id')}")
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min((F.col("quality") == 1).cast("int")).alias("y"))
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    free = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id")).where(f"NOT {_held_out('_id')}").join(known, "_id", "left_anti")
    order = [F.xxhash64("_id"), "_id"]
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    chosen = F.broadcast(ids.orderBy(*order).limit(rows))  # at most `rows` rows of 16 bytes
    sample = parts.join(chosen, F.expr("doc_id = _id")).select("doc_id", "text", "source", "lang", "n_chars", "y").repartition(SAMPLE_TASKS)
    if pool is None:
        rest = parts.where("doc_id IS NOT NULL").where(f"NOT {_held_out('doc_id')}")
        slim = rest.withColumn("y", F.lit(None).cast("int"))
    else:
        slim = parts.join(F.broadcast(free.distinct().orderBy(*order).limit(pool)), F.expr("doc_id = _id")).withColumn("y", F.lit(None).cast("int"))
    slim = slim.select("doc_id", "text", "source", "lang", "n_chars", "y")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "y": b["y"].astype("Int32"), "t": [text_view(t).astype(np.float32).tobytes() for t in b["text"]],
                "m": [meta_view(s, g, None if pd.isna(c) else int(c)).astype(np.float32).tobytes() for s, g, c in zip(b["source"], b["lang"], b["n_chars"], strict=True)],
            })

    schema = "doc_id long, y int, t binary, m binary"
    got = written(sample.mapInPandas(features, schema), "quality-sample").toPandas().sort_values(["doc_id"], kind="stable")
    far = slim.mapInPandas(features, schema).select("doc_id", F.xxhash64("t", "m").alias("h"), "t", "m").join(known, F.col("doc_id") == F.col("_id"), "left_anti")
    # Numbered as written, so that later readers see the same numbers.
    far = written(far.withColumn("row", F.monotonically_increasing_id()), "quality-pool")
    views = [np.frombuffer(b"".join(got[c]), np.float32).reshape(-1, n) for c, n in (("t", N_TEXT), ("m", N_META))]
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % 5 for i in got["doc_id"]], dtype=int)
    return co_train_from(views, got["y"].to_numpy(np.float64), fold, _pick_from(far))


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, score, text_score, meta_score) for every document, from its whole text.

    docs: doc_id, text, source, lang, n_chars; other columns are ignored. One row per
    row of docs. Null, empty and blank texts share one text view, and null metadata
    have flags of their own. One pass without a shuffle. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            text = np.stack([text_view(t.as_py()) for t in b.column("text")])
            meta = np.stack([meta_view(s.as_py(), g.as_py(), c.as_py()) for s, g, c in zip(b.column("source"), b.column("lang"), b.column("n_chars"), strict=True)])
            p, own = model.score(text, meta)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(own[:, 0]), pa.array(own[:, 1])], ["doc_id", "score", "text_score", "meta_score"])

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text", "source", "lang", "cast(n_chars as long) n_chars")
    return slim.mapInArrow(run, "doc_id long, score double, text_score double, meta_score double")


def op5_quality_cotraining(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.expr(f"coalesce({_held_out('doc_id')}, false)")
    return out.select("doc_id", held.alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).cast("int").alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is at least `least`, with the columns of documents."""
    model = fit(docs, labels)
    columns = document_columns(docs)
    rows = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                text = np.stack([text_view(t.as_py()) for t in b.column("text")])
                meta = np.stack([meta_view(s.as_py(), g.as_py(), c.as_py()) for s, g, c in zip(b.column("source"), b.column("lang"), b.column("n_chars"), strict=True)])
                yield b.filter(pa.array(model.score(text, meta)[0] >= least))

    return rows.mapInArrow(run, rows.schema)
