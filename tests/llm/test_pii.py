import random
import re

import pytest
import regex

from prismlake.llm import pii
from tests.llm.docs import none_of, odd_documents


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def run(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in pii.pseudonymised(docs, key).collect()}
    return [out[i] for i in range(len(texts))]


def pieces(text):
    """Entities by the same pattern, in another engine, and what lies between."""
    pattern = pii.ENTITY.replace(r"\p{Is", r"\p{")
    found = [m[0] for m in regex.finditer(pattern, text)]
    return found, regex.split(pattern, text)


FIXED = [
    ("Mr. John Smith met Mrs. Mary Smith.", ["name", "name"]),
    ("ANNA.b@x.org wrote to anna.B@X.org", ["email", "email"]),
    ("+1 (504) 555-2652, +1-504-555-2652 or (504) 555-2652", ["phone"] * 3),
    ("4539 1488 0343 6467, 4539148803436467, 4539148803436468", ["card", "card"]),
    ("10.1.2.3 192.168.7.9 8.8.8.8 300.1.1.1 1.2.3 1.2.3.4.5", ["ip"] * 3),
    ("ssn 123-45-6789 on 2024-01-15", ["ssn"]),
    ("DE89 3704 0044 0532 0130 00 or DE89370400440532013000, DE88 3704 0044 0532 0130 00", ["iban", "iban"]),
    ("Frau Müller, г-н Иванов, 王小明先生, Herr MÜLLER", ["name"] * 4),
    ("nothing 12 3.14 here", []), ("", []), (None, []),
]


def test_kinds_formats_and_coreference(spark):
    rows = run(spark, [t for t, _ in FIXED])
    for (text, kinds), r in zip(FIXED, rows, strict=True):
        assert r.kinds == kinds and r.n_entities == len(kinds)
        if not kinds:
            assert r.text == text
    new = [r.text for r in rows]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. ([\w-]+) (\w+)\.", new[0])
    assert m[1] in pii.MALE_NAMES and m[3].split("-")[0] in pii.FEMALE_NAMES and m[2] == m[4] != "Smith"
    a, b = new[1].split(" wrote to ")
    assert a == b != "anna.b@x.org" and a.endswith(".example.org")
    a, b, c = re.split(r", | or ", new[2])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and re.fullmatch(r"\+1-\d{3}-\d{3}-\d{4}", b)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "15045552652" and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", c)
    a, b, c = new[3].split(", ")
    assert a.replace(" ", "") == b and luhn(b) and b[0] == "4" and c == "4539148803436468"
    assert re.fullmatch(r"10\.\d+\.\d+\.\d+ 192\.168\.\d+\.\d+ \d+\.\d+\.\d+\.\d+ 300\.1\.1\.1 1\.2\.3 1\.2\.3\.4\.5", new[4])
    assert all(int(x) < 256 for x in re.findall(r"\d+", new[4].split(" 300")[0]))
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} on 2024-01-15", new[5]) and "123-45" not in new[5]
    a, b, c = re.split(r" or |, ", new[6])
    assert a.replace(" ", "") == b and b[:2] == "DE" and c == "DE88 3704 0044 0532 0130 00"
    assert int("".join(str(int(x, 36)) for x in b[4:] + b[:4])) % 97 == 1
    m = re.fullmatch(r"Frau (\w+), г-н ([а-яА-Я]+), (\w+)先生, Herr ([A-Z]+)", new[7])
    assert m[1].upper() == m[4] != "MÜLLER" and m[2] != "Иванов" and regex.fullmatch(r"\p{Han}{3}", m[3])


def test_rest_of_the_text_stays_and_entities_go(spark):
    rnd = random.Random(5)
    words = ["lorem", "ipsum", "Dolor.", "été\n", "💥", "12", "x\x00y"]
    emails = [f"user{i}.{i % 7}@mail{i % 3}.example.net" for i in range(60)]
    ips = [f"{rnd.randint(1, 255)}.{rnd.randint(0, 255)}.0.{i}" for i in range(60)]
    texts = [" ".join(rnd.choice([rnd.choice(words)] * 4 + [rnd.choice(emails), rnd.choice(ips)]) for _ in range(rnd.randint(0, 200))) for _ in range(80)]
    given = {}
    for old, r in zip(texts, run(spark, texts), strict=True):
        found, between = pieces(old)
        again, between2 = pieces(r.text)
        assert between == between2 and len(found) == len(again) == r.n_entities
        for a, b in zip(found, again, strict=True):
            assert given.setdefault(a, b) == b
    assert len(given) > 80 and len(set(given.values())) == len(given)
    assert not set(given) & set(given.values())


def test_collisions_are_drawn_again(spark):
    """More entities than a kind's first draw can tell apart."""
    units = [("given_m", f"name{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(400)] + [("given_m", n.lower()) for n in pii.MALE_NAMES]
    units += [("email", f"{a}{b}@x.org") for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    got = pii.surrogates(spark.createDataFrame(units, "kind string, main string"), "k").collect()
    assert sorted((r.kind, r.main) for r in got) == sorted(set(units))
    assert len({(r.kind, r.s.lower()) for r in got}) == len(set(units))
    real = {n for k, n in units if k == "given_m"}
    assert not real & {r.s.lower() for r in got if r.kind == "given_m"}


NAMES = [
    "Dr. Anna Maria Schmidt saw John F. Kennedy, ANNA KRAUS (as listed names are spelt, she stays) and Anna Schmidt.", "Mary Ann Smith wrote to mary@x.org",
    "Frau Ursula von der Leyen; Mr. J. R. Smith", "hi, my name is Xanthe Q. Quibble and that's it", "Full name: Only", "signed by Yolanda Smith Mrs. Smith",
    "Sr. José María O'Neill-García", "г-жа Ольга В. Петрова", "Mr. " + "Ab " * 20 + "Mrs. Smith", "Professor Xanthe Quibble stays", "Mr. john",
]


def test_names_against_plain_python(spark):
    """Every part of a name by its own surrogate, put together in plain Python."""
    titles = sorted(pii.MALE_TITLES + pii.FEMALE_TITLES + pii.OTHER_TITLES, key=len, reverse=True)
    men, women = pii.MALE_NAMES + pii.MALE_CYRILLIC, pii.FEMALE_NAMES + pii.FEMALE_CYRILLIC

    def units(value):
        """[(literal, None) or (part, kind)] of one entity."""
        if "@" in value:
            return [(value, "email"), ("@", None), (value.split("@")[1], "domain")]
        title = next((t for t in titles if regex.match(rf"{t}\.? ", value)), "")
        words, out = value.split(" "), []
        names = [w for k, w in enumerate(words) if not (k == 0 and title) and w not in pii.PARTICLES and not regex.fullmatch(r"\p{Lu}\.", w)]
        first = names[0] if len(names) > 1 else None
        gender = "m" if title in pii.MALE_TITLES or first in men else "f" if title in pii.FEMALE_TITLES or first in women else "x"
        for k, w in enumerate(words):
            out.append((" ", None) if k else ("", None))
            if w in names and not (k == 0 and title):
                last = k == len(words) - 1
                out.append((w, "name" if last else f"given_{gender}"))
            else:
                out.append((w if w in pii.PARTICLES or k == 0 and title else "*" + w, None))
        return out

    found = [[units(v) for v in pieces(t)[0]] for t in NAMES]
    wanted = sorted({(k, p.lower()) for t in found for e in t for p, k in e if k})
    given = {(r.kind, r.main): r.s for r in pii.surrogates(spark.createDataFrame(wanted, "kind string, main string"), "k").collect()}

    def cased(like, s):
        return s.upper() if like.isupper() and len(like) > 1 else s if like.islower() else s[0].upper() + s[1:]

    for text, entities, r in zip(NAMES, found, run(spark, NAMES), strict=True):
        want, between = "", pieces(text)[1]
        for k, e in enumerate(entities):
            new = "".join(p if kind is None else given[kind, p.lower()] if kind in ("email", "domain") else cased(p, given[kind, p.lower()]) for p, kind in e)
            want += regex.escape(between[k]) + regex.sub(r"\\\*(.)\\\.", r"(?!\1)\\p{Lu}\.", regex.escape(new))
        assert regex.fullmatch(want + regex.escape(between[-1]), r.text), (text, r.text, want)
        assert r.n_entities == len(entities)
    new = [r.text for r in run(spark, NAMES)]
    assert not any(w in " ".join(new[:4] + new[5:8]).split() for w in ("Schmidt", "Kennedy", "Maria", "Ann", "Leyen;", "Quibble"))
    assert [len(e) for e in found] == [3, 2, 2, 1, 0, 2, 1, 1, 2, 0, 0]
    assert new[9:] == NAMES[9:]


def test_draws_are_spread(spark):
    units = spark.createDataFrame([("email", f"a{i}@x.org") for i in range(50)], "kind string, main string")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = pii.drawn(units.withColumn("attempt", pii.F.lit(0)).repartition(spread, "kind", "main"), "k")
    assert plan.rdd.getNumPartitions() == spread


def test_key_decides(spark):
    text = ["write to a@b.org or 8.8.8.8"]
    assert run(spark, text, "k")[0].text == run(spark, text, "k")[0].text != run(spark, text, "other")[0].text


@pytest.mark.parametrize("n", [60])
def test_odd_and_empty(spark, n):
    docs = odd_documents(spark, n)
    out = pii.pseudonymised(docs, "k")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_entities", "kinds"]
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    assert pii.pseudonymised(none_of(docs), "k").collect() == []
