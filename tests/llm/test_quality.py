import random
import zlib

import numpy as np

from prismlake.llm import quality
from tests.llm.docs import none_of, odd_documents


def corpus(spark, n=700):
    rnd = random.Random(6)
    words = [a + b for a in ("ba", "ko", "ti", "ru", "lo", "mé") for b in ("na", "si", "do", "pe", "mi", "ta")]
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        w = [rnd.choice(words) for _ in range(rnd.randint(15, 120))]
        text = " ".join(w).capitalize() + "." if good else rnd.choice([" ".join(x + "&&&" for x in w), " ".join(x for x in w for _ in range(8)), " | ".join(w).upper()])
        source = rnd.choice(["good.org", "fine.org"] if good != (rnd.random() < 0.1) else ["bad.biz", "junk.biz"])
        docs.append((i, text, rnd.choice(["en", "fr"]), source, len(text), 1.5))
        if i % 3:
            labels.append((i, int(good), None))
    labels += [(None, 1, 0), (4, None, 1), (labels[0][0], labels[0][1], 0)]
    truth = {d[0]: int(d[3].endswith("org")) for d in docs}
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        truth,
    )


def test_held_out_accuracy_and_views(spark):
    docs, labels, _ = corpus(spark)
    model = quality.fit(docs, labels)
    assert sum(sum(a) for a in model.added) > 0
    truth = {r.doc_id: r.quality for r in labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").collect()}
    rows = [r for r in quality.score(docs, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) > 80
    right = lambda f: np.mean([(f(r) >= 0.5) == bool(truth[r.doc_id]) for r in rows])
    assert right(lambda r: r.score) > 0.95
    assert right(lambda r: r.text_score) > 0.9 and right(lambda r: r.meta_score) > 0.8


def test_co_training_labels_for_the_other_view():
    """With few labels, the view that knows teaches the one that doesn't."""
    rng = np.random.default_rng(3)
    n, pool = 60, 3000
    y, z = rng.integers(0, 2, n).astype(float), rng.integers(0, 2, pool).astype(float)
    strong = lambda t: np.c_[t * 6 - 3 + rng.normal(size=len(t)), rng.normal(size=len(t))]
    weak = lambda t: np.c_[t[:, None] * 0.7 + rng.normal(size=(len(t), 20))]
    x, free, new = [strong(y), weak(y)], [strong(z), weak(z)], rng.integers(0, 2, 2000).astype(float)
    fold = np.arange(n) % 5
    test = weak(new)
    alone = quality.co_train(x, y, fold, [f[:0] for f in free], 0)
    taught = quality.co_train(x, y, fold, free, 4)
    hits = [np.mean((m.views[1].probability(test) >= 0.5) == new) for m in (alone, taught)]
    assert hits[1] > hits[0]


def test_same_rows_every_time(spark):
    docs, labels, _ = corpus(spark, 200)
    a = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, 50, 40)).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs.repartition(5), labels.repartition(4), 50, 40)).collect()}
    assert a == b


def test_odd_and_empty(spark):
    docs, labels, _ = corpus(spark, 200)
    model = quality.fit(docs, labels)
    odd = odd_documents(spark)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none_of(odd), model).collect() == []
    for l_ in (none_of(labels), labels.where("quality = 1")):
        assert len(quality.score(odd, quality.fit(docs, l_)).collect()) == odd.count()
    kept = quality.good_documents(docs, labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 100 < kept.count() < 200
    assert quality.good_documents(none_of(docs), labels).collect() == []


def test_every_unlabelled_document_can_be_picked(spark, monkeypatch):
    """As with all unlabelled rows at hand, beyond what was once a fixed number of them."""
    monkeypatch.setattr(quality, "POOL_ROWS", 40, raising=False)
    monkeypatch.setattr(quality.fit, "__defaults__", (quality.FIT_ROWS, *[40 if d is not None else None for d in quality.fit.__defaults__[1:]]))
    docs, labels, _ = corpus(spark)
    few = labels.where("doc_id < 150")
    model = quality.fit(docs, few)
    known, y, rows = {r.doc_id for r in few.collect()}, {r.doc_id: r.quality for r in few.collect() if r.quality is not None}, sorted(docs.collect(), key=lambda r: r.doc_id)
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    see = lambda rs: [np.stack([quality.text_view(r.text) for r in rs]).astype(np.float32), np.stack([quality.meta_view(r.source, r.lang, r.n_chars) for r in rs]).astype(np.float32)]
    mine, free = [r for r in rows if r.doc_id in y], [r for r in rows if r.doc_id not in known]
    fold = np.array([zlib.crc32(f"fold {r.doc_id}".encode()) % 5 for r in mine])
    plain = quality.co_train(see(mine), np.array([float(y[r.doc_id]) for r in mine]), fold, see(free))
    assert sum(map(sum, model.added)) > 40 and model.added == plain.added
    assert np.allclose(model.both.weights, plain.both.weights, atol=1e-4)
