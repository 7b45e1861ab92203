"""Toxicity by maximum-scoring segments of token log-odds.

Token log-odds come from labelled documents under Dirichlet priors: the rate of
a word among toxic tokens is drawn towards the rate of its prefixes, and those
towards the rate of all tokens, so that rare inflections lean on their stem. The
scores of a document's tokens, less a fixed cost a token, are scanned once for
all maximal scoring segments (Ruzzo and Tompa, 1999). Karlin-Altschul statistics
turn a segment's score into a number of segments as good that chance alone would
give in a text of that length; the segments that stand out are the toxic
passages. A document's evidence is the sum over its passages, and a logistic
curve fitted on the labels gives its score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_columns, forget, table, written

#: The most labelled rows that a fit uses. More rows change little, and the bound
#: keeps the counts and the calibration sample small.
FIT_ROWS = 20_000
#: Tasks that the fitted rows are spread over.
SAMPLE_TASKS = 16
#: Hash buckets of features, lengths of prefixes, strength of the priors in tokens.
BUCKETS, PREFIXES, PRIOR = 1 << 20, (3, 4, 5, 6, 7), 10.0
#: Cost of a token in nats, and the largest log-odds either way.
COST, MOST = 1.0, 8.0
#: A passage counts if chance gives fewer than this many as good.
EXPECTED = 0.5
#: Evidence in nats, and in strongly toxic words, from which more makes no difference to a score.
SURE, SURE_WORDS = 40.0, 12.0

_WORD = re.compile(r"[^\W\d_]+")
CACHE = 1 << 18


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(word: str) -> list[int]:
    """Buckets of the word's prefixes, shorter ones first, and of the whole word."""
    parts = [word[:k] + "*" for k in PREFIXES if k < len(word)] + [word]
    return [zlib.crc32(p.encode()) & (BUCKETS - 1) for p in parts]


class LogOdds(dict):
    """word -> log-odds of toxic against clean tokens, from hashed counts; a bounded cache."""

    def __init__(self, buckets: np.ndarray, toxic: np.ndarray, both: np.ndarray, root: float):
        super().__init__()
        self.sparse = (buckets.astype(np.int32), toxic.astype(np.float32), both.astype(np.float32))
        self.toxic = self.both = None
        self.root, self.base = root, math.log(root / (1 - root))

    def __reduce__(self):
        return LogOdds, (*self.sparse, self.root)

    def __missing__(self, word: str) -> float:
        if self.toxic is None:  # where words are looked up, not where the model is made
            at, toxic, both = self.sparse
            self.toxic, self.both = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
            self.toxic[at], self.both[at] = toxic, both
        rate = self.root
        for f in features(word):
            rate = (float(self.toxic[f]) + PRIOR * rate) / (float(self.both[f]) + PRIOR)
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        out = min(MOST, max(-MOST, math.log(rate / (1 - rate)) - self.base))
        if len(self) >= CACHE:
            self.clear()
        self[word] = out
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Every candidate keeps the sums before its start and up to its end. A new
    candidate joins with the last one whose starting sum is below its own and whose
    ending sum isn't above its own, and takes in all between; links to the last
    candidate with a lower starting sum make the search linear in all.
    """
    upto = np.cumsum(scores)
    cand: list[list] = []  # start, end, sum before start, sum up to end, link
    for k in np.flatnonzero(scores > 0).tolist():
        right = float(upto[k])
        start, left = k, right - float(scores[k])
        while True:
            j = len(cand) - 1
            while j >= 0 and cand[j][2] >= left:
                j = cand[j][4]
            if j < 0 or cand[j][3] >= right:
                cand.append([start, k + 1, left, right, j])
                break
            start, left = cand[j][0], cand[j][2]
            del cand[j:]
    return [(a, b, r - l) for a, b, l, r, _ in cand]


@dataclass
class Model:
    odds: LogOdds
    decay: float = 1.0  # lambda of Karlin and Altschul
    log_k: float = 0.0
    weights: list[float] = field(default_factory=lambda: [0.0] * 5)

    def scores(self, text: str | None) -> np.ndarray:
        words = tokens(text or "")
        return np.fromiter(map(self.odds.__getitem__, words), np.float64, len(words)) - COST

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments (first token, end, bits above chance in nats)."""
        chance = self.log_k + math.log(max(len(scores), 1)) - math.log(EXPECTED)
        return [(a, b, s) for a, b, s in segments(scores) if self.decay * s > chance]

    def evidence(self, text: str | None) -> tuple[list[float], list[tuple[int, int, float]]]:
        """The features of a text, over all its passages, and the passages.

        The sums level off at SURE and SURE_WORDS, where a text is toxic beyond doubt,
        so that the weights follow the texts in doubt; passages are never cut.
        """
        scores = self.scores(text)
        found = self.passages(scores)
        total = sum(s for *_, s in found)
        best = max((s for *_, s in found), default=0.0)
        strong = float(sum((scores[a:b] > 2).sum() for a, b, _ in found))
        return [1.0, min(total, SURE), min(best, SURE), min(strong, SURE_WORDS), math.log1p(len(scores))], found

    def score(self, x: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, self.weights, strict=True))))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton's method; the first column is the intercept and isn't drawn to 0."""
    w, pull = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    x = x / scale
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull, x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return (w / scale).tolist()


def training_rows(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic): at most `rows` labelled ids, the same ones in every run.

    Ids whose CRC-32 is 2 modulo 4 are held out. Repeated labels of an id count
    once, toxic if any says so; null ids and labels are left out.
    """
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND pmod(crc32(encode(cast(doc_id as string), 'UTF-8')), 4) <> 2")
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits the log-odds and the calibration on at most `rows` labelled documents.

    The driver gets hashed counts (two folds of BUCKETS at most) and, for each
    fitted row, five numbers. Each fold is scored with the other's counts, so the
    calibration sees documents as new ones.
    """
    train = training_rows(labels, rows).select(F.col("doc_id").alias("_id"), "toxic")
    train = F.broadcast(train.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)).cast("int")))  # at most `rows` rows of 16 bytes
    sample = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(train, F.expr("doc_id = _id")).select("text", "toxic", "fold")
    # Written once, so that the passes below read the sample and not all documents.
    sample = written(sample.repartition(SAMPLE_TASKS), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for t, y, f in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = 2 * f + y
                for w in set(tokens(t.as_py() or "")):  # once a document: a word repeated there tells no more
                    n = seen.get(w)
                    if n is None:
                        n = seen[w] = [0, 0, 0, 0]
                    n[at] += 1
                if len(seen) > CACHE:
                    yield from flush(seen)
        yield from flush(seen)

    def flush(seen: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, 4), np.int64)
        tokens_ = np.zeros(4, np.int64)
        for w, n in seen.items():
            tokens_ += n
            for b in features(w):
                total[b] += n
        seen.clear()
        at = np.flatnonzero(total.any(axis=1))
        both = np.concatenate([[-1], at]), np.concatenate([[tokens_], total[at]])
        for k in range(0, len(both[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[0][k : k + 50_000])] + [pa.array(both[1][k : k + 50_000, c]) for c in range(4)], ["b", "c0", "t0", "c1", "t1"])

    counts = sample.mapInArrow(count, "b long, c0 long, t0 long, c1 long, t1 long")
    counts = counts.groupBy("b").agg(*[F.sum(c).cast("int").alias(c) for c in ("c0", "t0", "c1", "t1")])
    # One occurrence says nothing beyond its prior: buckets with fewer than two tokens stay out.
    got = counts.where("c0 + t0 + c1 + t1 >= 2 OR b = -1").select(F.col("b").cast("int").alias("b"), "c0", "t0", "c1", "t1").toArrow()
    got = {name: got.column(name).to_numpy() for name in got.column_names}
    sums, b = got["b"] == -1, got["b"][got["b"] >= 0]

    def odds(folds: tuple[int, ...]) -> LogOdds:
        toxic, clean = (sum(got[f"{k}{f}"] for f in folds) for k in "tc")
        root = (int(toxic[sums].sum()) + 0.5) / (int((toxic + clean)[sums].sum()) + 1)
        return LogOdds(b, toxic[~sums], (toxic + clean)[~sums], root)

    other, model = [odds((1,)), odds((0,))], Model(odds((0, 1)))
    del got, sums, b  # the driver keeps the three models' counts alone
    pa.default_memory_pool().release_unused()
    raw = _sample_segments(sample, other)
    clean = [(s, n) for s, n, y in zip(raw["best"], raw["n"], raw["toxic"], strict=True) if y == 0 and n]
    if clean:
        best, n = np.array(clean, dtype=np.float64).T
        # A clean text's best segment follows a Gumbel law with mode log(K n) / decay; robust moments.
        q25, q50, q75 = np.percentile(best, [25, 50, 75])
        spread = max((q75 - q25) / 1.5725, 0.25)
        model.decay = 1 / spread
        model.log_k = float(np.median(best * model.decay - np.log(n)) - 0.3665)
    x, y = _sample_evidence(sample, [Model(o, model.decay, model.log_k) for o in other])
    if len(y):
        model.weights = logistic(x, y)
    forget(sample)
    return model


def _sample_segments(sample: DataFrame, other: list[LogOdds]) -> pd.DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, y, f in zip(batch["text"], batch["toxic"], batch["fold"], strict=True):
                s = Model(other[f]).scores(t)
                out.append((y, len(s), max((x for *_, x in segments(s)), default=0.0)))
            yield pd.DataFrame(out, columns=["toxic", "n", "best"])

    return sample.mapInPandas(run, "toxic int, n long, best double").toPandas()


def _sample_evidence(sample: DataFrame, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [models[f].evidence(t)[0] for t, f in zip(batch["text"], batch["fold"], strict=True)], "y": batch["toxic"].astype("int64")})

    got = sample.mapInPandas(run, "x array<double>, y long").toPandas()
    return (np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, 5))), got["y"].to_numpy(np.float64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) for every whole text.

    docs: doc_id, text; other columns are ignored. One row per row of docs; passages
    are (first token, end, score) of all significant segments. Null and empty texts
    get the score of a text without passages. One pass without a shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # bounded by BUCKETS
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            out, spans = [], []
            for t in batch.column(1):
                x, found = m.evidence(t.as_py())
                out.append(m.score(x))
                spans.append([{"first": a, "end": b, "score": s} for a, b, s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return slim.mapInArrow(run, "doc_id long, score double, passages array<struct<first:int,end:int,score:double>>")


def op6_toxic_segments(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    held = F.expr("coalesce(pmod(crc32(encode(cast(doc_id as string), 'UTF-8')), 4) = 2, false)")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Pipeline stage: the documents whose score is below `least`, unchanged.

    Scores and texts stay together in one pass, so nothing is joined.
    """
    model = fit(docs, labels)
    columns = document_columns(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for batch in batches:
            keep = [m.score(m.evidence(t.as_py())[0]) < least for t in batch.column(columns.index("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = docs.select(*columns)
    return rows.mapInArrow(run, rows.schema)
