import random

from prismlake.llm import common


def plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_paths_stars_and_random_links(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(501, 560)] + [(k, k) for k in (700, 701)]
    links += [(rnd.randint(1000, 1200), rnd.randint(1000, 1200)) for _ in range(120)] + [(5, 4), (-9, 3)]
    rnd.shuffle(links)
    got = common.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()
    want = plain([x for x in links if x[0] != x[1]])
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert common.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_a_hub_is_split(spark, monkeypatch):
    """The joins with the minima may deal the rows of one node to several tasks."""
    held = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in held}
    plans, write = [], common.written_slim

    def seen(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    # The hub is the least node of most tasks' links, and other nodes lead on from it.
    links = [(0, i) for i in range(1, 60_000)] + [(i, 100_000 + i) for i in range(1, 60_000, 7)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(links, "u long, v long").repartition(6).cache()
        df.count()
        monkeypatch.setattr(common, "written_slim", seen)
        got = common.components(df)
        assert any("skew=true" in p for p in plans)
        assert got.where("component <> 0").count() == 0 and got.count() == 60_000 + len(range(1, 60_000, 7))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
