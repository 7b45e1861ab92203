"""Personal data replaced by surrogates of the same kind.

Addresses, numbers and names are found by one pattern and replaced by values that
a key and the entity alone determine, so that the same entity gets the same
surrogate in every document. Surrogates keep the kind, format, script and gender
of what they stand for. The distinct entities of the corpus are checked for
collisions: no two entities may share a surrogate, and no surrogate may be an
entity that occurs; the entities that collide are drawn again until none does.

A name is found by its title ("Dr. Anna Maria Schmidt"), by a given name that is
listed below ("John F. Kennedy") or by a phrase before it ("my name is ..."), and
reaches over all capitalised parts, initials and particles that follow, up to
`MORE_PARTS` after the first. Its last part is the family name, the others are given names;
each part has its own surrogate, initials change by a keyed alphabet, and
particles stay. Names without any of the three signs are out of reach and stay, and a
capitalised word right behind a name is taken as a part of it.

Built from DataFrame operations only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_columns, forget, table, written

# Titles and common given names, by gender.
MALE_TITLES = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "г-н", "господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Madame", "Mme", "Mademoiselle", "Mlle", "г-жа", "госпожа"]
OTHER_TITLES = ["Dr", "Prof", "Doktor", "Doctor", "Docteur", "доктор"]
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Paul", "Hans", "Klaus", "Wolfgang", "Jürgen", "Pierre", "Jean", "Michel", "Jacques", "José", "Juan", "Carlos", "Miguel", "Pedro", "Luis"]
FEMALE_NAMES = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Emma", "Ursula", "Monika", "Petra", "Sabine", "Marie", "Nathalie", "Isabelle", "Sylvie", "Claire", "María", "Carmen", "Ana", "Isabel", "Lucía", "Elena"]
MALE_CYRILLIC = ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"]
FEMALE_CYRILLIC = ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"]
#: Words that stand before a part of a name and belong to it.
PARTICLES = ["von", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "ter", "ten", "bin", "ibn", "al", "y"]
#: Phrases that announce a name of at least two parts.
PHRASES = ["my name is ", "My name is ", "full name: ", "Full name: ", "signed by ", "Signed by "]
SYLLABLES = ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ka", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "wa"]
SYLLABLES_CYRILLIC = ["ба", "бе", "бо", "ва", "ве", "го", "да", "де", "до", "за", "ка", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "со", "та", "те", "то", "ша", "ше"]
#: First and last code point of the letters that stand in for a letter of a script.
SCRIPTS = {"Han": (0x4E00, 0x9FA5), "Hangul": (0xAC00, 0xD7A3), "Hiragana": (0x3042, 0x3093), "Katakana": (0x30A2, 0x30F3), "Greek": (0x03B1, 0x03C9), "Arabic": (0x0628, 0x063A), "Hebrew": (0x05D0, 0x05EA), "Devanagari": (0x0915, 0x0939), "Thai": (0x0E01, 0x0E2E)}

# Patterns. The quantifier of an address's first part is possessive and bounded, so that long words cost linear time.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+"
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_NAMES = "|".join(MALE_NAMES + FEMALE_NAMES + MALE_CYRILLIC + FEMALE_CYRILLIC)
MORE_PARTS = 6  # of a name after its first; the pattern's engine recurses for each
_PART = rf"(?!(?:{_TITLES})(?![\p{{L}}'’-]))\p{{Lu}}[\p{{L}}'’-]{{1,40}}"
_BEFORE = rf"(?:(?:\p{{Lu}}\.|{'|'.join(PARTICLES)})\x20){{0,3}}"
_LINK = _BEFORE + _PART
_CJK = r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]{2,4}(?=先生|女士|さん|様|씨)(?:先生|女士|さん|様|씨)"
_MORE = rf"(?:\x20{_LINK})"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLES})\.?\x20{_LINK}{_MORE}{{0,{MORE_PARTS}}}|(?:{_NAMES}){_MORE}{{1,{MORE_PARTS}}}|(?<=(?:{'|'.join(PHRASES)})){_LINK}{_MORE}{{1,{MORE_PARTS}}})|{_CJK}"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
NUMBER = rf"(?<![\p{{L}}\p{{N}}.+])(?:{SSN}|{IP}|{PHONE}|{CARD})(?![\p{{L}}\p{{N}}]|\.[0-9])"
ENTITY = f"{EMAIL}|{IBAN}|{NAME}|{NUMBER}"


def _text(s: str) -> str:
    """A SQL literal."""
    return "r'" + s + "'" if "'" not in s else "r\"" + s + "\""


def _list(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


DIGITS = "regexp_replace(value, '[^0-9]', '')"
LUHN = "aggregate(sequence(1, length({0})), 0, (s, i) -> s + if((length({0}) - i) % 2 = 1, 2 * cast(substr({0}, i, 1) as int) - if(substr({0}, i, 1) > '4', 9, 0), cast(substr({0}, i, 1) as int))) % 10"
MOD97 = "aggregate(sequence(1, length({0})), 0, (s, i) -> if(substr({0}, i, 1) between '0' and '9', s * 10 + cast(substr({0}, i, 1) as int), s * 100 + ascii(substr({0}, i, 1)) - 55) % 97)"


def _kind() -> tuple[F.Column, F.Column]:
    """The kind of `value`, null if its check fails, and the account number as its check reads it."""
    full = lambda p: F.col("value").rlike(f"^(?:{p})$")
    octets = F.expr("forall(split(value, '[.]'), o -> cast(o as int) < 256)")
    moved = F.expr("concat(substr(regexp_replace(value, ' ', ''), 5), substr(regexp_replace(value, ' ', ''), 1, 4))")
    kind = (
        F.when(F.col("value").contains("@"), "email")
        .when(full(IBAN.replace(r"(?<![\p{L}\p{N}])", "").replace(r"(?![\p{L}\p{N}])", "")), F.when(F.expr(MOD97.format("moved")) == 1, "iban"))
        .when(full(SSN), "ssn")
        .when(full(IP), F.when(octets, "ip"))
        .when(full(PHONE), "phone")
        .when(full(CARD), F.when(F.expr(LUHN.format("digits")) == 0, "card"))
        .otherwise("name")
    )
    return kind, moved


def _seen(text: str) -> F.Column:
    return F.expr(f"regexp_extract_all({text}, {_text(ENTITY)}, 0)")


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, at, value, kind, piece, before, unit, main, like, after): the pieces of every entity of every whole text.

    at counts the matches of the pattern in the text. A piece is a part of a name, the
    local part or the domain of an address, or the whole of another entity: unit and main
    say whose surrogate it gets, `like` what it looks like, before and after what stands around it. Card numbers and account
    numbers need right check digits and network addresses right octets; other
    matches have a null kind and stay.
    """
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.posexplode(_seen("text")).alias("at", "value"))
    each = each.distinct()  # repeated rows have the same entities
    kind, moved = _kind()
    each = each.withColumn("digits", F.expr(DIGITS)).withColumn("moved", moved).withColumn("kind", kind).where("kind IS NOT NULL").drop("moved")
    # Names: title, parts and what stands before each; the suffix of names that have their title behind.
    each = each.withColumn("title", F.when(F.col("kind") == "name", F.expr(f"coalesce(regexp_extract(value, {_text('^((?:' + _TITLES + ')[.]? )')}, 1), '')")).otherwise(""))
    each = each.withColumn("suffix", F.when(F.col("kind") == "name", F.expr("regexp_extract(value, '(先生|女士|さん|様|씨)$', 1)")).otherwise(""))
    body = "substr(value, length(title) + 1, length(value) - length(title) - length(suffix))"
    each = each.withColumn("body", F.when((F.col("kind") == "name") & (F.col("suffix") == ""), F.expr(body)))
    pieces = lambda group: F.expr(f"regexp_extract_all(body, {_text(f'({_BEFORE})({_PART})')}, {group})")
    each = each.withColumn("before", F.when(F.col("body").isNotNull(), pieces(1)).otherwise(F.array(F.lit(""))))
    each = each.withColumn("parts", F.when(F.col("body").isNotNull(), pieces(2)).otherwise(F.array(F.expr(body))))
    plain = F.expr("trim('. ' FROM title)")
    first = F.expr("if(size(parts) > 1, parts[0], null)")
    gender = F.when(plain.isin(MALE_TITLES) | first.isin(MALE_NAMES + MALE_CYRILLIC), "m").when(plain.isin(FEMALE_TITLES) | first.isin(FEMALE_NAMES + FEMALE_CYRILLIC), "f").otherwise("x")
    each = each.withColumn("gender", gender)
    main = (
        "CASE kind WHEN 'ip' THEN value WHEN 'iban' THEN regexp_replace(value, ' ', '')"
        " WHEN 'phone' THEN concat(if(value LIKE '+%', '+', ''), digits) ELSE digits END"
    )
    whole = f"array(struct('' AS before, kind AS unit, {main} AS main, value AS like, '' AS after))"
    email = "array(struct('' AS before, 'email' AS unit, lower(value) AS main, value AS like, '@' AS after), struct('' AS before, 'domain' AS unit, substring_index(lower(value), '@', -1) AS main, '' AS like, '' AS after))"
    name = (
        "transform(parts, (p, i) -> struct(concat(if(i = 0, title, ' '), before[i]) AS before,"
        " if(i = size(parts) - 1, 'name', concat('given_', gender)) AS unit, lower(p) AS main, p AS like, if(i = size(parts) - 1, suffix, '') AS after))"
    )
    units = F.expr(f"CASE kind WHEN 'email' THEN {email} WHEN 'name' THEN {name} ELSE {whole} END")
    return each.select("doc_id", "h1", "h2", "at", "value", "kind", F.posexplode(units).alias("piece", "u")).select("doc_id", "h1", "h2", "at", "value", "kind", "piece", "u.*")


def _drawn(key: str) -> tuple[F.Column, F.Column]:
    """The seed of (kind, main, attempt) and the surrogate that it gives, in canonical form."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "main", F.col("attempt").cast("string")), 256)
    h = "cast(conv(substr(sha2(concat(seed, ':', cast({} as string)), 256), 1, 8), 16, 10) as bigint)"
    pick = lambda words, i: f"element_at({_list(words)}, cast({h.format(i)} % {len(words)} as int) + 1)"
    digit = lambda i: f"cast({h.format(i)} % 10 as string)"
    char = "substr({}, i, 1)"

    def letters(of: str) -> str:
        """Every letter and digit by another of its script and case."""
        ranges = " ".join(
            rf"WHEN {char.format(of)} rlike '\\p{{Is{s}}}' THEN decode(unhex(lpad(hex({a} + {h.format('i')} % {b - a + 1}), 4, '0')), 'UTF-16BE')" for s, (a, b) in SCRIPTS.items()
        )
        return (
            f"array_join(transform(sequence(1, length({of})), i -> CASE WHEN {char.format(of)} between '0' and '9' THEN {digit('i')}"
            rf" WHEN {char.format(of)} rlike '\\p{{IsCyrillic}}' THEN substr('абвгдежзиклмнопрстуфхцчшэюя', cast({h.format('i')} % 27 as int) + 1, 1)"
            rf" WHEN {char.format(of)} rlike '[\\p{{IsLatin}}]' THEN char(97 + cast({h.format('i')} % 26 as int)) {ranges} ELSE {char.format(of)} END), '')"
        )

    middle = lambda first, last: f"array_join(transform(sequence({first}, length(main) - {last}), i -> {digit('i')}), '')"
    card = f"concat(substr(main, 1, 1), {middle(2, 1)})"
    check = "cast((10 - " + LUHN.format(f"concat({card}, '0')") + ") % 10 as string)"
    bban = f"array_join(transform(sequence(5, length(main)), i -> if(substr(main, i, 1) between '0' and '9', {digit('i')}, char(65 + cast({h.format('i')} % 26 as int)))), '')"
    account = f"concat(substr(main, 1, 2), lpad(cast(98 - {MOD97.format(f'concat({bban}, substr(main, 1, 2), 0, 0)')} as string), 2, '0'), {bban})"
    octet = lambda i: f"cast(1 + {h.format(i)} % 254 as string)"
    address = (
        "concat_ws('.', " + ", ".join(
            f"if({'main LIKE ' + repr('10.%') if i == 0 else 'false'} OR ({i} < 2 AND (main LIKE '192.168.%' OR main rlike '^172[.](1[6-9]|2[0-9]|3[01])[.]')), split(main, '[.]')[{i}], {octet(i)})" for i in range(4)
        ) + ")"
    )
    syllables = lambda words: f"array_join(transform(sequence(1, 3 + attempt), i -> {pick(words, 'i')}), '')"

    def given(latin: list[str], cyrillic: list[str]) -> str:
        one = lambda words, syl: f"CASE attempt WHEN 0 THEN {pick(words, 0)} WHEN 1 THEN concat({pick(words, 0)}, '-', {pick(words, 1)}) ELSE {syllables(syl)} END"
        return rf"CASE WHEN main rlike '\\p{{IsCyrillic}}' THEN {one(cyrillic, SYLLABLES_CYRILLIC)} WHEN main rlike '^\\p{{IsLatin}}' THEN {one(latin, SYLLABLES)} ELSE {letters('main')} END"

    surname = rf"CASE WHEN main rlike '\\p{{IsCyrillic}}' THEN {syllables(SYLLABLES_CYRILLIC)} WHEN main rlike '^\\p{{IsLatin}}' THEN {syllables(SYLLABLES)} ELSE {letters('main')} END"
    local = "substring_index(main, '@', 1)"
    host = "substring_index(main, '.', 1)"
    tail = "if(substring_index(main, '.', -1) IN ('com', 'org', 'net'), substring_index(main, '.', -1), 'com')"
    more = "if(attempt < 3, '', array_join(transform(sequence(3, attempt), i -> " + digit("1000 + i") + "), ''))"
    draw = f"""CASE kind
        WHEN 'email' THEN concat({letters(local)}, {more})
        WHEN 'domain' THEN concat({letters(host)}, {more}, '.example.', {tail})
        WHEN 'phone' THEN concat(if(main LIKE '+%', substr(main, 1, 2), {digit(1)}), {middle("if(main LIKE '+%', 3, 2)", 0)})
        WHEN 'ssn' THEN concat(cast(1 + {h.format(0)} % 5 as string), {middle(2, 0)})
        WHEN 'card' THEN concat({card}, {check})
        WHEN 'iban' THEN {account}
        WHEN 'ip' THEN {address}
        WHEN 'given_m' THEN {given(MALE_NAMES, MALE_CYRILLIC)}
        WHEN 'given_f' THEN {given(FEMALE_NAMES, FEMALE_CYRILLIC)}
        WHEN 'given_x' THEN {given(MALE_NAMES + FEMALE_NAMES, MALE_CYRILLIC + FEMALE_CYRILLIC)}
        ELSE {surname} END"""
    return seed, F.expr(draw)


def drawn(units: DataFrame, key: str) -> DataFrame:
    seed, draw = _drawn(key)
    return units.withColumn("seed", seed).withColumn("s", draw).drop("seed")


def surrogates(units: DataFrame, key: str, most_rounds: int = 100) -> DataFrame:
    """(kind, main, s): a surrogate for each distinct (kind, main), without collisions.

    In every round the open units draw; of those that draw the same the least
    keeps it, unless an earlier round gave it away or it occurs as an entity of
    the kind. All steps are equi-joins and grouped minima on distinct units.
    """
    spread = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = units.select("kind", F.lower("main").alias("low"))
    units = units.withColumn("attempt", F.lit(0))
    done = None
    for _ in range(most_rounds):
        # A draw is long work on a short row: a stated number of tasks, which adaptive execution leaves alone.
        tried = written(drawn(units.repartition(spread, "kind", "main"), key).withColumn("low", F.lower("s")), "surrogates-drawn")
        least = tried.groupBy("kind", "low").agg(F.min("main").alias("least"))
        least = least.join(real, ["kind", "low"], "left_anti")
        if done is not None:
            least = least.join(done.select("kind", F.lower("s").alias("low")), ["kind", "low"], "left_anti")
        won = F.coalesce(F.col("least") == F.col("main"), F.lit(False))
        settled = written(tried.join(least, ["kind", "low"], "left").select("kind", "main", "attempt", "s", won.alias("won")), "surrogates")
        forget(tried)
        given = settled.where("won").select("kind", "main", "s")
        done = given if done is None else done.unionByName(given)
        units = settled.where("NOT won").select("kind", "main", (F.col("attempt") + 1).alias("attempt"))
        if units.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {most_rounds} rounds")


#: Puts the letters or digits of `s` in the places of those in `value`.
LAID = "aggregate(split(value, ''), struct('' AS t, 1 AS k), (a, c) -> if(c rlike '[A-Za-z0-9]', struct(concat(a.t, substr({0}, a.k, 1)) AS t, a.k + 1 AS k), struct(concat(a.t, c) AS t, a.k AS k)), a -> a.t)"


_REST = f"regexp_replace(before, {_text('^(?:' + _TITLES + ')[.]? ')}, '')"


def _cased(like: str, s: str) -> str:
    cap = f"concat(upper(substr({s}, 1, 1)), substr({s}, 2))"
    return f"CASE WHEN {like} = upper({like}) AND {like} <> lower({like}) AND length({like}) > 1 THEN upper({s}) WHEN {like} = lower({like}) THEN {s} ELSE {cap} END"


def _initials(text: str, key: str) -> str:
    """Capitals before a dot by others: a keyed turn of the alphabet, so that different letters stay different."""
    out = text
    for first, n in (("A", 26), ("А", 32)):
        turn = 1 + int.from_bytes(hashlib.sha256(f"{key}|initial".encode()).digest()[:4]) % (n - 1)
        letters = "".join(chr(ord(first) + i) for i in range(n))
        out = f"translate({out}, '{letters}', '{letters[turn:] + letters[:turn]}')"
    return out


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """Documents with surrogates for personal data.

    docs: doc_id, text and any other columns. Returns the columns of documents that
    docs has, with the new text, and n_entities and kinds (of the entities, in their
    order), one row per row of docs. Null and empty texts have no entities and stay.
    The same entity, in whatever format, gets the same surrogate in all documents
    for one key; other entities get others. Rows with the same id and text have the
    same result. No rows give no rows.

    Entities are joined with their surrogates by value, so a value that a third of
    all documents have is a skewed join key that adaptive execution splits. Texts
    are shuffled once, to meet their surrogates.
    """
    found = written(entities(docs), "pii-entities")
    units = written(found.select(F.col("unit").alias("kind"), "main").distinct(), "pii-units")
    given = surrogates(units, key)
    each = found.join(given.select(F.col("kind").alias("unit"), "main", "s"), ["unit", "main"])
    before = f"if(piece = 0, concat(regexp_extract(before, {_text('^((?:' + _TITLES + ')[.]? )?')}, 0), {_initials(_REST, key)}), {_initials('before', key)})"
    new = F.expr(
        f"""concat({before}, CASE WHEN kind = 'email' OR kind = 'ip' THEN s WHEN kind = 'name' THEN {_cased('like', 's')}
        WHEN kind = 'phone' THEN {LAID.format("ltrim('+', s)").replace('(value,', '(like,')} ELSE {LAID.format('s').replace('(value,', '(like,')} END, after)"""
    )
    each = each.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_g1"), F.col("h2").alias("_g2"), "at", "kind", F.struct("piece", new.alias("new")).alias("e"))
    each = each.repartition("_id", "_g1", "_g2")  # serves both groupings
    each = each.groupBy("_id", "_g1", "_g2", "at", "kind").agg(F.sort_array(F.collect_list("e")).alias("e"))
    each = each.withColumn("e", F.struct("at", F.expr("array_join(e.new, '')").alias("new"), "kind"))
    each = each.groupBy("_id", "_g1", "_g2").agg(F.sort_array(F.collect_list("e")).alias("_e"))
    columns = document_columns(docs)
    whole = docs.select(*columns, F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    out = whole.join(each, same, "left")
    # Matches without a kind stay; the others have their place in the sorted entities.
    out = out.withColumn("_old", F.when(F.col("_e").isNotNull(), _seen("text"))).withColumn("_rest", F.when(F.col("_e").isNotNull(), F.expr(f"split(text, {_text(ENTITY)}, -1)")))
    out = out.withColumn("_at", F.expr("map_from_arrays(transform(_e, x -> x.at), transform(_e, x -> x.new))"))
    text = F.expr("array_join(flatten(transform(sequence(0, size(_rest) - 1), i -> array(_rest[i], if(i < size(_old), coalesce(_at[i], _old[i]), '')))), '')")
    out = out.withColumn("_new", text)
    return out.select(
        *[F.when(F.col("_e").isNull(), F.col("text")).otherwise(F.col("_new")).alias("text") if c == "text" else F.col(c) for c in columns],
        F.coalesce(F.size("_e"), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.expr("transform(_e, x -> x.kind)"), F.array().cast("array<string>")).alias("kinds"),
    )


#: Key of the query; a real run passes a secret one.
DEMO_KEY = "prismlake-demo-key"


def op3_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    out = pseudonymised(table(spark, sf_dir, "documents"), DEMO_KEY)
    return out.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
