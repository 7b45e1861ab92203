from collections import Counter

import pytest

from prismlake.llm import line_dedup
from tests.llm.docs import none_of, odd_documents


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, least, shortest=1):
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < shortest or n[key(x)] < least]
        out.append((str(i), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def got(docs, *args, **more):
    out = line_dedup.without_repeated_lines(docs, *args, **more).collect()
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in out)


@pytest.mark.parametrize("batches", [1, 4])
def test_brute_force(spark, batches):
    odd = odd_documents(spark, 60).select("doc_id", "text", "n_chars", "tile", "hash")
    common = ["The same LINE", "  the same line\t", "ÉTÉ", "été", "x", "", " \r"]
    rows = [(1000 + i, "\n".join([common[i % 7], f"own {i}", common[(i * i) % 5], common[i % 7], "a"][: i % 6])) for i in range(70)]
    rows += [(2000, "\n".join(["x", "y"] * 5000 + [f"l{i}" for i in range(3000)]))]
    docs = odd.unionByName(spark.createDataFrame([(*r, 1, "t", 2) for r in rows], odd.schema))
    every = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, 10, batches=batches) == plain(every, 10)
    if batches == 4:
        assert got(docs, 3, 2, batches) == plain(every, 3, 2)


def test_runs_hold_each_hash_once_and_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    want = Counter()
    for b in range(5):
        rows = {(i * 7919 + 13, i): 1 + i % 3 for i in range(b * 20, b * 20 + 60)}
        want.update(rows)
        runs.add(spark.createDataFrame([(*k, n) for k, n in rows.items()], "k1 long, k2 long, docs long"))
    assert [len(level) for level in runs.runs] == [1, 0, 1]
    assert [len(level) for level in runs.repeats] == [0, 0, 1]
    stored = Counter()
    for level in runs.runs:
        for r in level:
            stored.update((k1, k2) for k1, k2, _ in runs.read(r).collect())
    assert set(stored) == set(want) and set(stored.values()) == {1}
    assert {tuple(r) for r in runs.frequent(5).collect()} == {k for k, n in want.items() if n >= 5}
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_later_batches_meet_the_runs_of_earlier_calls(spark, tmp_path):
    """A second call reads its own batch alone, and counts with what is in the folder."""
    home = f"file://{tmp_path}/runs"
    rows = [(i, f"line {i % 7}\nown {i}") for i in range(60)]
    first, then = rows[:30], rows[30:]
    schema = "doc_id long, text string"
    line_dedup.without_repeated_lines(spark.createDataFrame(first, schema), 5, batches=2, home=home).collect()
    again = got(spark.createDataFrame(then, schema), 5, batches=1, home=home)
    assert again == [r for r in plain(rows, 5) if int(r[0]) >= 30]
    runs = line_dedup.LineRuns(spark, home)
    assert sum(runs.read(r).count() for level in runs.runs for r in level) == 67
    runs.close()


def test_batch_and_compaction_need_no_shuffle(spark):
    runs = line_dedup.LineRuns(spark)
    rows = spark.range(1000).selectExpr("id k1", "id * 3 k2", "1L docs").repartition(runs.buckets, "k1", "k2")
    a, b = runs.read(runs.store(rows)), runs.read(runs.store(rows)).withColumnRenamed("docs", "more")
    for how in ("left_anti", "full_outer", "left"):
        plan = a.join(b.hint("merge"), ["k1", "k2"], how)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    for t in spark.catalog.listTables():
        if t.name.startswith("line_run_"):
            spark.sql(f"DROP TABLE {t.name}")


def test_many_positions_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    rows = [(i, f"line {i % 7}\nown {i}\nline {i % 3}") for i in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 5) == plain(rows, 5)


def test_empty_and_null(spark):
    assert line_dedup.without_repeated_lines(none_of(odd_documents(spark, 5))).collect() == []
    docs = spark.createDataFrame([(None, None)] * 12 + [(1, "")], "doc_id long, text string")
    out = line_dedup.without_repeated_lines(docs).collect()
    assert all(r.n_lines == 1 and r.n_dropped == 0 for r in out) and sum(r.text is None for r in out) == 12
