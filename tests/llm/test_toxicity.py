import random
import zlib

import numpy as np

from prismlake.llm import toxicity
from tests.llm.docs import none_of, odd_documents


def plain_segments(x):
    """Maximal scoring segments by their definition: split at the best segment, again and again."""
    out = []

    def best(a, b):
        top = None
        for i in range(a, b):
            s = 0
            for j in range(i, b):
                s += x[j]
                # Of equal sums the first, shortest one.
                if s > 0 and (top is None or s > top[0]):
                    top = (s, i, j + 1)
        if top:
            out.append((top[1], top[2], top[0]))
            best(a, top[1])
            best(top[2], b)

    best(0, len(x))
    return sorted(out)


def test_segments_are_all_maximal_ones():
    rnd = random.Random(1)
    for _ in range(300):
        # Irregular scores, so that no two sums are equal.
        x = [rnd.choice([-1, 1, -2, 3]) * (1 + rnd.random()) for _ in range(rnd.randint(0, 30))]
        got = toxicity.segments(np.array(x, dtype=float))
        want = plain_segments(x)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_are_fast_on_long_texts():
    x = np.where(np.arange(400_000) % 3 == 0, 1.0, -0.4)
    assert len(toxicity.segments(x)) == 1
    assert toxicity.segments(-np.ones(10)) == []


def corpus(spark, n=600):
    rnd = random.Random(2)
    calm = [a + b for a in ("ba", "ko", "ti", "ru", "lo") for b in ("na", "si", "do", "pe", "mi", "ta")]
    bad = ["vilely", "grottish", "scurbag"]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(calm) for _ in range(rnd.randint(20, 200))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randint(2, 6)):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        docs.append((i, " ".join(w), "en", "a", 1, "clash"))
        labels.append((i, int(toxic) if rnd.random() > 0.03 else 1 - int(toxic), None))
    labels += [(None, 1, 0), (3, None, 1), (5, labels[5][1], 0), (10**9, 1, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, toxic string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id < 600 AND toxic IS NOT NULL").collect()}
    rows = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id in truth]
    assert len(rows) > 100 and all(0 <= r.score <= 1 for r in rows)
    hits = sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in rows)
    assert hits / len(rows) > 0.92
    assert any(r.passages for r in rows)


def test_rows_fit_is_bounded_and_stable(spark):
    _, labels = corpus(spark, 300)
    a = [tuple(r) for r in toxicity.training_rows(labels, 50).collect()]
    assert a == [tuple(r) for r in toxicity.training_rows(labels.repartition(7), 50).collect()] and len(a) == 50
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in a)


def test_odd_and_empty(spark):
    docs, labels = corpus(spark, 200)
    model = toxicity.fit(docs, labels)
    odd = odd_documents(spark)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none_of(odd), model).collect() == []
    blank = toxicity.fit(none_of(docs), none_of(labels))
    assert len(toxicity.score(odd, blank).collect()) == odd.count()
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert len(toxicity.score(odd, one).collect()) == odd.count()


def test_stage_drops_toxic_documents(spark, tmp_path):
    docs, labels = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    bad = {r.doc_id for r in docs.where("text rlike 'vilely|grottish|scurbag'").collect()}
    assert len(ids & bad) < 0.1 * len(bad) and len(ids - bad) > 0.97 * (600 - len(bad))
