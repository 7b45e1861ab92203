import math
import random

from prismlake.llm import embedding_dedup
from tests.llm.docs import none_of


def plain(rows, least):
    def usable(r):
        return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def cos(x, y):
        return sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))

    n, label, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]) and (a[1] == b[1] or cos(a[1], b[1]) >= least):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), links[i], str(ids.get(find(i))), r[0] is not None and r[0] == ids.get(find(i))) for i, r in enumerate(rows))


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(12)]
    rows = []
    for i in range(260):
        c = rnd.choice(centres)
        s = rnd.choice([0.05, 0.15, 0.3])
        rows.append((i, [round(x + rnd.gauss(0, s), 3) for x in c], rnd.choice([1, 1, 1, 2, 3])))
    rows += [(300 + i, rows[7][1], 1) for i in range(60)]
    rows += [(400, None, 1), (401, [0.0] * 12, 1), (402, [float("nan")] * 12, 1), (403, [1.0, None], 1), (404, rows[7][1], None), (405, [], 1)]
    rows += [(406, [1.0, 0.0], 1), (407, [2.0, 0.0], 1), (408, [-2.0, 0.0], 1), (409, [float("inf"), 1.0], 1), (None, rows[7][1], 1), (410, [3.0], 2)]
    rows += [rows[9], (411, [1e-30, 0.0], 2), (412, [1e30, 0.0], 2)]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, label int, n int, tile string, lead double").repartition(4)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.embedding_duplicates(df, 0.93).collect())
    assert got == plain(rows, 0.93)


def test_floats_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}
    assert embedding_dedup.embedding_duplicates(none_of(df)).collect() == []
