import random
import re
from collections import Counter

import pytest

from prismlake.llm import decontamination
from tests.llm.docs import none_of, odd_documents

WORD = re.compile(r"[^\W_]+")


def plain(docs, items, least=0.8, k=5):
    """Best window of each text for each item, over all windows."""
    out = {}
    items = {tuple(WORD.findall((t or "").lower())) for t in items} - {()}
    for doc_id, text in set(docs):
        w = WORD.findall((text or "").lower())
        for item in items:
            m, n = len(item), min(k, len(item))
            ci = Counter(item[i : i + n] for i in range(m - n + 1))
            for start in range(max(1, len(w) - m + 1)):
                win = w[start : start + m]
                cw = Counter(tuple(win[i : i + n]) for i in range(len(win) - n + 1))
                o = sum((cw & ci).values())
                s = o / (sum(cw.values()) + sum(ci.values()) - o)
                if s >= least and s > out.get((doc_id, text, item), (0, 0))[0]:
                    out[doc_id, text, item] = (s, start)
    return sorted((str(d), len(i), start, round(s, 9)) for (d, _, i), (s, start) in out.items())


def cases(spark, seed=3):
    rnd = random.Random(seed)
    vocab = [a + b for a in ("ba", "ko", "ti", "ru", "mé", "lo", "sha") for b in ("na", "si", "do", "pe", "ü", "mi")]
    items = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 4, 5, 6, 12, 20, 30, 60]))) for _ in range(40)]
    items += ["repeat me " * 9, "a b c d e f g " * 4, "", None, " ,.- ", items[5]]
    docs = [(r.doc_id, r.text) for r in odd_documents(spark, 40).collect() if len(r.text or "") < 50_000]
    for i in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(1, 3)):
            own = (rnd.choice(items) or "x").split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if own:
                    k = rnd.randrange(len(own))
                    own[k : k + 1] = rnd.choice([[], ["zz"], [own[k], own[k]]])
            at = rnd.randint(0, len(w))
            w[at:at] = [x.upper() + rnd.choice([",", "", "!"]) for x in own]
        docs.append((1000 + i, " ".join(w)))
    docs += [docs[-1], (None, items[7]), (2000, " ".join(items[8].split()[:-1])), (2001, items[8] * 1 + " " + items[8])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, m int, word string, start int").repartition(3)
    b = spark.createDataFrame([(i, t, 5) for i, t in enumerate(items)], "item_id long, text string, item int")
    return d, b


@pytest.mark.parametrize("block", [200_000, 90])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "CHOSEN_ROWS", block)
    if block == 90:  # nothing but the chosen shingles of a block is broadcast
        monkeypatch.setattr(decontamination, "bounded", lambda df: df)
    docs, items = cases(spark)
    got = decontamination.contaminated(*frames(spark, docs, items)).collect()
    want = plain(docs, items)
    assert len(want) > 100 and any(s < 1 for *_, s in want)
    assert sorted((str(r.doc_id), r.words, r.start, round(r.similarity, 9)) for r in got) == want


def test_index_holds_all_within_radius(spark):
    rnd = random.Random(9)
    x = rnd.getrandbits(63)
    rows = spark.createDataFrame([(x,)], "fp long").select(decontamination.block_values(decontamination.RADIUS).alias("v")).first().v
    filed = {(r.block, r.value) for r in rows}
    for _ in range(300):
        y = x
        for b in rnd.sample(range(64), decontamination.RADIUS):
            y ^= 1 << b
        assert any((b, y >> (8 * b) & 255) in filed for b in range(8))


@pytest.mark.parametrize("lanes", [8, 16, 32])
def test_simhash(spark, lanes):
    rnd = random.Random(lanes)
    rows = [([rnd.getrandbits(64) - (1 << 63) for _ in range(rnd.randint(1, 200))],) for _ in range(40)]
    df = spark.createDataFrame(rows, "h array<long>")
    for r in df.select("h", decontamination.simhash("h", lanes).alias("fp")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h))
        assert r.fp % (1 << 64) == want


def test_item_ids_and_stage(spark):
    docs, items = cases(spark, 8)
    d, b = frames(spark, docs, items)
    found = decontamination.with_item_ids(decontamination.contaminated(d, b), b).collect()
    for r in found:
        assert WORD.findall((items[r.item_id] or "").lower())
    assert {r.item_id for r in found} >= {5, len(items) - 1} or not any(r.item_id == 5 for r in found)
    docs_ = d.selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars", "m")
    kept = decontamination.without_contaminated(docs_, b)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    bad = {str(r.doc_id) for r in found}
    key = lambda r: (str(r.doc_id), r.text or "")
    left = sorted(key(r) for r in kept.collect())
    pairs = {(x, w) for x, w, *_ in plain(docs, items)}
    assert {x for x, _ in pairs} == bad
    assert {x for x, _ in left} | bad >= {str(i) for i, _ in docs}


def test_empty(spark):
    docs, items = cases(spark)
    d, b = frames(spark, docs[:20], items)
    assert decontamination.contaminated(none_of(d), b).collect() == []
    assert decontamination.contaminated(d, none_of(b)).collect() == []
