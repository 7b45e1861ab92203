import random
import re

import duckdb
import pytest

from prismlake.llm import mixing
from tests.llm.docs import none_of, odd_documents


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = mixing.mix(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    words = {}
    sizes = {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        words.setdefault(r.doc_id, []).append(n)
        sizes[r.source] = sizes.get(r.source, 0) + n
    target = filled(sizes)
    by_size = {}
    for r in got:
        assert r["size"] in words[r.doc_id]
        assert r.taken in (0, r["size"], 2 * r["size"])
        by_size.setdefault(r.source_size, []).append(r)
    for s, n in sizes.items():
        mine = by_size[n]
        assert mine[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r["size"] for r in mine)


def test_targets_of_many_sources(spark):
    rnd = random.Random(4)
    for n in (1, 2, 3, 7, 20, 50):
        for spread in (1, 100, 10_000):
            sizes = {f"s{i}": rnd.randint(0, spread) for i in range(n)} | {None: rnd.randint(1, spread)}
            df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
            got = {r.source: r.target for r in mixing.source_targets(df).collect()}
            want = filled(sizes)
            assert got == pytest.approx(want)
            assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_sql_agrees(spark):
    docs = odd_documents(spark).where("doc_id IS NULL OR doc_id < 128")
    documents = docs.select("doc_id", "text", "source").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = duckdb.sql(mixing.ORACLE_SQL).fetchall()
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: [(x is None, x or 0) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(set(map(tuple, want)) if len(got) != len(want) else want, key=key)


def test_budgets_nest(spark):
    docs = odd_documents(spark, 300)
    slim = mixing.written(docs.select("source", mixing.word_count("text").alias("size"), mixing.row_hash("doc_id", "text").alias("hash")), "t")
    total = slim.groupBy("source").sum("size").toDF("source", "n")
    budgets = total.selectExpr("source", "explode(array(1, 5, 9)) AS budget_id", "n").selectExpr("source", "budget_id", "n * budget_id / 10 AS budget")
    cut = {(r.source, r.budget_id): r.threshold for r in mixing.thresholds(slim, budgets, 4).collect()}
    assert len(cut) == 3 * total.count()
    for s, k in cut:
        if k > 1:
            assert cut[s, 1] <= cut[s, k]


def test_empty(spark):
    assert mixing.mix(none_of(odd_documents(spark, 5))).collect() == []
    assert mixing.mixed_documents(spark, none_of(odd_documents(spark, 5)), "").collect() == []


def test_mixed_documents_follow_taken(spark):
    docs = odd_documents(spark)
    docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken // r["size"] if r["size"] else 1 for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(spark, docs, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert times == {k: v for k, v in taken.items() if v}


def test_rows_without_ids_part_by_their_texts(spark):
    rows = [(None if k % 3 else 7, " ".join(f"w{k}" for _ in range(5)), "abcd"[k % 4]) for k in range(800)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.target, []).append(r)
    target = filled({s: 1000 for s in "abcd"})
    assert len(got) == 800 and sum(r.taken for r in got) == pytest.approx(sum(target.values()), abs=20)
    for t, mine in by.items():
        assert abs(sum(r.taken for r in mine) - t * len(mine) / 200) <= 5 * len(mine) / 200
