import random

import numpy as np
import pytest

from prismlake.llm import near_texts, simhash
from tests.llm.docs import none_of, odd_documents


def shingles(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_groups(texts, least=0.8):
    """Component of each text over all pairs."""
    texts = sorted(set(texts), key=str)
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and o / len(sets[i] | sets[j]) >= least:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {t: find(i) for i, t in enumerate(texts)}


def corpus(spark, seed=1):
    rnd = random.Random(seed)
    vocab = [a + b + c for a in ("ba", "ko", "ti", "ru", "mé", "lo") for b in ("na", "si", "do", "pe", "ü") for c in ("x", "y", "zz", "")]
    rows = [(r.doc_id, r.text) for r in odd_documents(spark, 40).collect()]
    at = 1000
    for size, edits in ((1, 0), (40, 2), (25, 6), (12, 12), (3, 25)) * 3:
        base = [rnd.choice(vocab) for _ in range(rnd.randint(120, 260))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((at, " ".join(w)))
            at += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_as_over_all_pairs(spark, monkeypatch, seed):
    """With small blocks, too, and with nearly all pairs left to them."""
    monkeypatch.setattr(simhash, "TILE", 32)
    if seed == 2:
        for name, value in (("LIGHT", 3), ("BLOCK_TEXTS", 7), ("COUNT", 50), ("TABLES", 1), ("NEAR_ALL", 2)):
            monkeypatch.setattr(near_texts, name, value)
    rows = corpus(spark, seed)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, node int, fp string, least int").repartition(4)
    label = plain_groups([t for _, t in rows])
    kept = sorted((str(r.doc_id), r.text or "") for r in near_texts.without_near_duplicates(docs).collect())
    groups = {}
    for i, t in rows:
        groups.setdefault(label[t], []).append((i, t))
    want = []
    for g in groups.values():
        ids = [i for i, _ in g if i is not None]
        want.append((str(min(ids)) if ids else "None", None))
    assert len(groups) < len(rows) - 50
    assert sorted(i for i, _ in want) == sorted(i for i, _ in kept)


def test_forests_are_minimal():
    rng = np.random.default_rng(1)
    for n in (2, 5, 40):
        i, j = rng.integers(0, n, 200), rng.integers(0, n, 200)
        far = rng.integers(0, 30, 200)
        got = near_texts.nearest_forest(n, i, j, far)
        root, total, count = list(range(n)), 0, 0

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for k in np.argsort(far, kind="stable"):
            a, b = find(i[k]), find(j[k])
            if a != b:
                root[a], total, count = b, total + far[k], count + 1
        assert len(got) == count and far[got].sum() == total


def test_stage_columns_and_empty(spark):
    docs = odd_documents(spark, 30)
    out = near_texts.without_near_duplicates(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    label = plain_groups([r.text for r in docs.collect()])
    assert out.count() == len(set(label.values()))
    assert near_texts.without_near_duplicates(none_of(docs)).collect() == []


def test_passages_and_short_texts_are_found(spark, monkeypatch):
    """Pairs that differ in one passage of new words, and pairs of 8 to 12 words."""
    monkeypatch.setattr(simhash, "TILE", 32)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    texts = []
    for n in (60, 100, 400):
        for _ in range(20):
            base = [word() for _ in range(n)]
            texts += [base, base + [word() for _ in range((n - 4) // 4)]]
            base, k = [word() for _ in range(n)], n // 2
            # About a ninth of the shingles is another's on either side.
            texts += [base, base[:k] + [word() for _ in range(max(1, (n - 4) // 9 - 4))] + base[k + max(1, (n - 4) // 9 - 4) :]]
    for n in (8, 9, 10, 11, 12):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts += [base, [*base, word()]]
    # A passage that many texts share must not join them.
    passage = [word() for _ in range(12)]
    texts += [[word() for _ in range(40)] + passage for _ in range(150)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    label, best = plain_groups([t for _, t in rows]), {}
    for i, t in rows:
        best[label[t]] = min(i, best.get(label[t], i))
    assert len(best) < len(rows) - 100
    assert {r.doc_id for r in near_texts.without_near_duplicates(docs).collect()} == set(best.values())


@pytest.mark.parametrize("parts", ["4", "24"])
def test_meetings_grow_with_a_group_and_not_with_its_square(spark, monkeypatch, parts):
    """Texts of one component meet the others' blocks only, in as many blocks for any number of partitions."""
    monkeypatch.setattr(near_texts, "BLOCK_TEXTS", 20)
    before, made = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for size in (240, 480):
            rnd = random.Random(size)
            # (node, shingles, component): one large component and twenty texts of their own, of all sizes.
            texts = [(k, 200 + rnd.randrange(20), 0 if k < size else k) for k in range(size + 20)]
            hits = spark.createDataFrame([(7, *t, 0, len(texts)) for t in texts], "s long, node long, n int, component long, at int, m long")
            work, tables = near_texts.block_work(hits, 0.8)
            blocks, _, met = tables
            assert blocks.select("block").distinct().count() == len(texts) // 20
            assert sorted(r.node for r in blocks.select("node").collect()) == list(range(len(texts)))
            made.append(met.count())
            units = {}
            for r in work.collect():
                units.setdefault(r.unit, set()).add(r.node)
            share = {frozenset((a, b)) for u in units.values() for a in u for b in u if b >= size}
            assert all(frozenset((a, b)) in share for a in range(size + 20) for b in range(size, size + 20))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] < 3 * 260 and made[1] < 2.2 * made[0]
