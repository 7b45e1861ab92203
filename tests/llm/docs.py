"""Small documents with the odd cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hash int, fp string, tile string, shard int, score string"


def odd_documents(spark, n=120, seed=5):
    rnd = random.Random(seed)
    words = [a + b for a in ("ba", "ko", "ti", "ru", "mé", "lo") for b in ("na", "si", "do", "pe", "ü")]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(1, 6)))
        rows.append((i, text, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "ç", None, ""]), len(text)))
    base = rows[0][1] + " " + rows[1][1] + " " + rows[2][1]
    rows += [
        (n, None, "en", "a", None),
        (n + 1, "", None, None, 0),
        (None, rows[3][1], "en", "a", 3),
        (None, None, None, None, None),
        (n + 2, " \t\n\x0b\r ", "en", "b", 6),
        (n + 3, rows[4][1], "fr", "a", 1),
        (4, rows[4][1], "fr", "a", 1),
        (n + 4, base, "en", "a", 1),
        (n + 5, base.upper(), "en", "a", 1),
        (n + 6, base + " zz", "en", "a", 1),
        (n + 7, "x" * 70_000 + " " + base * 400, "en", "a", 1),
        (n + 8, "x" * 70_000 + " " + base * 400, "en", "a", 1),
        (n + 9, "💥   ÄÖ x\x00y", "en", "a", 1),
    ]
    rows = [(*r, "clash", 7, "clash", "clash", 3, "clash") for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def none_of(df):
    return df.limit(0)
