import random
import re

import numpy as np
import xxhash

from prismlake.llm import simhash
from tests.llm.docs import none_of, odd_documents


def plain_fingerprint(text, k=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    """Component number by position, over all pairs."""
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 70_000):
        t = " ".join(rnd.choice(["Ab", "É", "x", "yY", " ", "日本"]) for _ in range(n))
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n ")


def test_index_finds_all_pairs():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 9, 200, 700):
        base = rnd.integers(0, 1 << 63, size=max(1, n // 10), dtype=np.uint64)
        codes = np.unique(rnd.choice(base, n) ^ (np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64)))
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        index = simhash.GrayIndex(codes)
        for radius in (0, 2, 4):
            got = {(int(i), int(j)) for a, b in simhash.pairs_within(index, index, radius, True) for i, j in zip(a, b, strict=True)}
            apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
            assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= radius), strict=True) if i < j}
        half = len(codes) // 3
        if half:
            a, b = simhash.GrayIndex(codes[:half]), simhash.GrayIndex(codes[half:])
            got = sum(len(i) for i, _ in simhash.pairs_within(a, b, 3, False))
            assert got == (np.bitwise_count(codes[:half, None] ^ codes[None, half:]) <= 3).sum()


def test_documents(spark):
    docs = odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    label = plain_components(fps, 2)
    least = {}
    for r, k in zip(rows, label, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(least.get(k))) for r, f, k in zip(rows, fps, label, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_chains_and_large_blocks(spark, monkeypatch):
    """Many fingerprints in one block, over several tiles and partitions."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rnd = random.Random(4)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    x = rnd.getrandbits(64)
    for _ in range(150):  # a chain whose ends are far apart
        x ^= 1 << rnd.randrange(20)
        fps.add(x)
    fps |= {(7 << 40) | rnd.getrandbits(12) for _ in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long").repartition(3)
    label = plain_components(fps, 2)
    found = {r.node: r.component for r in simhash.components(simhash.links(df, 2)).collect()}
    groups, plain = {}, {}
    for f, k in zip(fps, label, strict=True):
        groups.setdefault(found.get(simhash.signed(f), simhash.signed(f)), set()).add(f)
        plain.setdefault(k, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_empty(spark):
    assert simhash.near_duplicates(none_of(odd_documents(spark, 5))).collect() == []
