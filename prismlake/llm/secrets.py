"""Secret scans with multipart credential linking.

Strong patterns report a secret wherever they match. Weak candidates say little
by themselves: a user name, a short password, a random-looking string, a host.
They are parts of a credential, and are reported only when complementary parts
co-occur. The parts of a document are joined as intervals: two parts meet if
they lie in one scope (a block of lines without an empty one between) and at
most `reach` code points apart.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: The strong patterns, and the least length of a match (of group 2 where there is one).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "part_id", "part_secret", "part_endpoint")

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
# A run is maximal, so asking for its least length at once finds the same matches.
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")

# Parts. Groups named x are the span that counts.
_ID = re.compile(r"""(?:access_?key_?id|client_?id|user_?name|user_?id|user|login|account)["']?\x20*[:=]\x20*["']?(?P<x>[A-Za-z0-9._@-]{3,})""", re.I | re.A)
_SHORT = re.compile(r"""(?:password|passwd|pass|pwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<x>[A-Za-z0-9+/_.=!@#$%^&*-]{4,})""", re.I | re.A)
# A run may start behind "=", as values do; as padding it only ends one.
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])(?P<x>[A-Za-z0-9+/_-]{20,}={0,2})", re.A)
_ENDPOINT = re.compile(r"(?P<x>(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s\"'<>]+|(?<![\w.-])(?:host|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::\d+)?|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?![\d.]))", re.I | re.A)
_BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[str, int, int]


def strong(text: str) -> list[Span]:
    """Matches of the strong patterns, leftmost and non-overlapping for each kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _random_looking(s: str) -> bool:
    kinds = (any(c.isdigit() for c in s)) + any(c.islower() for c in s) + any(c.isupper() for c in s)
    return kinds == 3 and len(set(s)) >= 12


def parts(text: str, found: list[Span]) -> dict[str, list[tuple[int, int, bool]]]:
    """Identifiers, secrets and endpoints as (start, end, weak), by start; strong matches count as parts."""
    ids = [(a, b, False) for k, a, b in found if k == "access"]
    secrets = [(a, b, False) for k, a, b in found if k != "access"]
    if ":" in text or "=" in text:
        ids += [(*m.span("x"), True) for m in _ID.finditer(text)]
        secrets += [(*m.span("x"), True) for m in _SHORT.finditer(text)]
    secrets += [(*m.span("x"), True) for m in _RANDOM.finditer(text) if _random_looking(m["x"])]
    ends = [(*m.span("x"), True) for m in _ENDPOINT.finditer(text)] if ids and secrets else []
    # A weak part that overlaps a strong match of its role is that match.
    out = {}
    for role, spans in (("id", ids), ("secret", secrets), ("endpoint", ends)):
        kept: list[tuple[int, int, bool]] = []
        for s in sorted(set(spans), key=lambda s: (s[0], s[2], -s[1])):
            if kept and s[0] < kept[-1][1]:
                if kept[-1][2] and not s[2]:
                    kept[-1] = s
                continue
            kept.append(s)
        out[role] = kept
    return out


class Role:
    """The parts of one role by their places; they don't overlap one another."""

    def __init__(self, spans: list[tuple[int, int, bool]], scopes: list[int]):
        self.spans, self.scopes = spans, scopes
        self.starts, self.ends = [s[0] for s in spans], [s[1] for s in spans]

    def near(self, a: tuple[int, int, bool], reach: int) -> tuple[int, int, bool] | None:
        """The nearest part that meets `a` and doesn't overlap it: the last that ends before it or the first that starts behind it."""
        best = None
        for k in (bisect_right(self.ends, a[0]) - 1, bisect_left(self.starts, a[1])):
            if 0 <= k < len(self.spans):
                b = self.spans[k]
                gap = max(b[0] - a[1], a[0] - b[1])
                same = bisect_right(self.scopes, a[0]) == bisect_right(self.scopes, b[0])
                if same and gap <= reach and (best is None or gap < best[0]):
                    best = gap, b
        return best and best[1]


def linked(text: str, found: list[Span], reach: int = 200) -> tuple[list[Span], list[dict]]:
    """Weak parts that complementary parts complete, and the credentials they make up.

    A secret needs an identifier within reach and an identifier a secret; an
    endpoint needs both. Parts that overlap don't complete each other, so a string
    that could be either role needs another one beside it. Each secret makes one
    credential, with the nearest identifier and the nearest endpoint, so the links
    are as many as the secrets.
    """
    p = parts(text, found)
    if not p["id"] or not p["secret"]:
        return [], []
    scopes = [m.end() for m in _BLANK.finditer(text)]
    role = {name: Role(spans, scopes) for name, spans in p.items()}
    out: list[Span] = []
    for s in p["id"]:
        if s[2] and role["secret"].near(s, reach):
            out.append(("part_id", s[0], s[1]))
    links = []
    for s in p["secret"]:
        i = role["id"].near(s, reach)
        if i is None:
            continue
        if s[2]:
            out.append(("part_secret", s[0], s[1]))
        e = role["endpoint"].near(s, reach)
        links.append({"id": list(i[:2]), "secret": list(s[:2]), "endpoint": e and list(e[:2])})
    for s in p["endpoint"]:
        if role["id"].near(s, reach) and role["secret"].near(s, reach):
            out.append(("part_endpoint", s[0], s[1]))
    return out, links


SCAN_SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>, links array<struct<id:array<int>,secret:array<int>,endpoint:array<int>>>"


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Spans of secrets in every whole text, and the credentials linked from parts.

    docs: doc_id, text; other columns are ignored. Returns (doc_id, spans, links),
    one row per row of docs, with spans by start and kind, in code points, end
    exclusive. Null texts count as empty and have none. One pass without a shuffle;
    a task holds one batch of documents, and a long text costs n log n in its parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        ints = pa.list_(pa.int32())
        link = pa.list_(pa.struct([("id", ints), ("secret", ints), ("endpoint", ints)]))
        for batch in batches:
            spans, links = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                found = strong(text)
                more, l_ = linked(text, found, reach)
                every = sorted(found + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in every])
                links.append(l_)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(links, link)], ["doc_id", "spans", "links"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCAN_SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the strong spans and the text of all spans."""
    text = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind IN ('assign', 'access', 'hex'))"
    count = "cast(size(filter(spans, s -> s.kind = '{}')) as long) AS n_{}"
    return found.selectExpr(
        "doc_id", *[count.format(k, k) for k in ("assign", "access", "hex")],
        f"sha2({text.format(base)}, 256) AS base_sha256", f"{text.format('spans')} AS spans", "cast(size(links) as long) AS n_links",
    )


def op4_secret_links(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))
