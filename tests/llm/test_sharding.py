import itertools
import math
import zlib

import numpy as np

from prismlake.llm import sharding
from tests.llm.docs import none_of, odd_documents


def plain_index(cell, bits):
    """Skilling's transform, a cell at a time."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for d in range(n):
            if x[d] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[d]) & (q - 1)
                x[0] ^= swap
                x[d] ^= swap
        q >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            turn ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            out = out << 1 | (x[d] ^ turn) >> b & 1
    return out


def test_curve_visits_each_cell_once_and_steps_by_one(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2), (2, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        names = [f"c{d}" for d in range(dims)]
        df = spark.createDataFrame([tuple(map(int, c)) for c in cells], ", ".join(f"{c} int" for c in names))
        rows = df.select(*names, sharding.hilbert_index(names, bits).alias("at")).collect()
        assert all(r["at"] == plain_index(tuple(r)[:-1], bits) for r in rows)
        assert sorted(r["at"] for r in rows) == list(range(len(cells)))
        path = np.array([tuple(r)[:-1] for r in sorted(rows, key=lambda r: r["at"])])
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def plain_cells(values, key, cells=256):
    """Cell of each value: cells begin at the first value of each share of the rows."""
    values = sorted(values, key=key)
    bounds = {}
    for k, v in enumerate(values):
        first = values.index(v) if k == 0 or values[k - 1] != v else None
        if first is not None:
            bounds.setdefault(k * cells // len(values), v)
    bounds = sorted(bounds.values(), key=key)[1:]
    return lambda v: sum(key(b) <= key(v) for b in bounds)


def test_order_is_that_of_a_plain_sort(spark):
    """Long common beginnings don't hide the rest; groups of equal texts follow one another."""
    rng = np.random.default_rng(3)
    rows = [(int(k), f"text {rng.integers(0, 60)}" if k % 3 else f"own {k}", rng.choice(["en", "fr", "de"]), f"https://site{rng.integers(0, 40)}.example/") for k in range(500)]
    docs = spark.createDataFrame([(i, t, str(a), b) for i, t, a, b in rows], "doc_id long, text string, lang string, source string").repartition(5)
    got = sorted(sharding.hilbert_shards(docs, 10, "rows").collect(), key=lambda r: (r.shard, r.slot))
    source = plain_cells([r[3] for r in rows], str.encode)
    lang = plain_cells([r[2] for r in rows], str.encode)
    sizes = sorted(len(r[1]) + 16 for r in rows)
    cuts = sorted({sizes[max(0, math.ceil(k / 256 * len(sizes)) - 1)] for k in range(1, 256)})
    size = lambda t: sum(c <= len(t) + 16 for c in cuts)
    at = {i: plain_index((source(b), lang(a), size(t)), 8) for i, t, a, b in rows}
    group = {}
    for i, t, *_ in rows:
        group[t] = min(at[i], group.get(t, at[i]))
    text = {i: t for i, t, *_ in rows}
    assert [r.hilbert for r in got] == sorted(group[t] for _, t, *_ in rows)
    assert all(r.hilbert == group[text[r.doc_id]] for r in got)
    order = [text[r.doc_id] for r in got]
    assert sum(a != b for a, b in itertools.pairwise(order)) + 1 == len(set(order))
    assert len({source(r[3]) for r in rows}) == 40  # every source has a cell of its own


def check(rows, shards, law):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for k, mine in by.items():
        assert 0 <= k < shards
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    if law == "rows":
        counts = [len(by.get(k, [])) for k in range(shards)]
        assert max(counts) - min(counts) <= 1
    else:
        share = sum(r["size"] for r in rows) / shards
        biggest = max(r["size"] for r in rows)
        assert all(abs(sum(r["size"] for r in by.get(k, [])) - share) <= biggest for k in range(shards))
    # Shards are runs of the curve.
    ends = [(min(r.hilbert for r in by[k]), max(r.hilbert for r in by[k])) for k in sorted(by)]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(ends))


def test_laws(spark):
    docs = odd_documents(spark, 400)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    for law, shards in (("rows", 40), ("rows", 7), ("bytes", 5), ("rows", 1000)):
        rows = sharding.hilbert_shards(docs, shards, law).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r["size"], r.text_crc32) in [(len(t) + 16, zlib.crc32(t)) for t in texts[r.doc_id]]
            assert r.law == law and r.grown_shard is None
        check(rows, shards, law)


def test_stage_keeps_documents(spark):
    docs = odd_documents(spark)
    out = sharding.sharded_documents(docs, 4)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    key = lambda r: str(tuple(r))
    assert sorted(out.select(*names).collect(), key=key) == sorted(docs.select(*names).collect(), key=key)


def test_empty(spark):
    assert sharding.hilbert_shards(none_of(odd_documents(spark, 5))).collect() == []
    assert sharding.sharded_documents(none_of(odd_documents(spark, 5))).collect() == []
