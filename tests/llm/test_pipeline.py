import os
from collections import Counter

import pytest

import corpus_pipeline
from prismlake.llm import mixing, toxicity
from prismlake.llm.common import table
from tests.llm.test_decontamination import WORD, plain
from tests.llm.test_near_texts import plain_groups

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_in_turn(spark):
    """Every stage against a plain version of itself on what its predecessor kept."""
    docs, kept = table(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, DATA), f"test-{name}")
        assert name == "sharding" or out.columns == COLUMNS
        kept[name] = [(r.doc_id, r.text) for r in out.collect()]
        docs = out
    before = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    model = toxicity.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    assert sorted(kept["toxicity"]) == sorted(x for x in before if model.score(model.evidence(x[1])[0]) < 0.3)
    label = plain_groups([t for _, t in kept["toxicity"]])
    least = {}
    for i, t in kept["toxicity"]:
        least[label[t]] = min(i, least.get(label[t], i))
    assert sorted(i for i, _ in kept["near_duplicates"]) == sorted(least.values())
    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    first = {x for t in items for x in zip(*[WORD.findall(t.lower())[k:] for k in range(5)], strict=False)}
    near = [(i, t) for i, t in kept["near_duplicates"] if first & set(zip(*[WORD.findall(t.lower())[k:] for k in range(5)], strict=False))]
    bad = {int(i) for i, *_ in plain(near, items)}
    assert sorted(i for i, _ in kept["decontamination"]) == sorted(i for i, _ in kept["near_duplicates"] if i not in bad)
    docs = spark.createDataFrame([(r.doc_id, r.text, r.source) for r in table(spark, DATA, "documents").collect() if r.doc_id in {i for i, _ in kept["decontamination"]}], "doc_id long, text string, source string")
    times = {r.doc_id: r.taken // r["size"] if r["size"] else 1 for r in mixing.mix(docs).collect()}
    assert Counter(i for i, _ in kept["mixing"]) == Counter({k: v for k, v in times.items() if v})
    assert sorted(kept["sharding"]) == sorted(kept["mixing"])


def test_no_stage_is_left_out():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
