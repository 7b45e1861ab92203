"""Near-duplicate texts: wide SimHash fingerprints, Gray-order tiles, exact verification.

Texts count as near duplicates if the Jaccard similarity of their sets of word
shingles is high enough. Candidates come from SimHash fingerprints of 256 bits of
the texts' distinct words, which change in few bits when few words do. A
fingerprint is filed in several tables; a table leads with bits of its own choice
and is otherwise the Gray-order hierarchical index of `simhash.py`: rows sorted by
Gray rank, cut into tiles under one value of the leading bits, compared by
descending nodes with accumulated differences. The nearest candidates that span a
tile are verified on the shingles themselves, and those that hold make groups.

A pair whose fingerprints differ in a share p of the bits meets in one of t
tables with b leading bits with probability 1 - (1 - (1 - p)^b)^t. At a Jaccard
similarity of 0.8 of five-word shingles p is about 0.055 if the difference is
single words scattered over the text, and about 0.15 if it is one passage of new
words. So the index finds most groups but not all links. An exact prefix filter
on the shingles then takes every pair between the groups: shingles that few texts
share give pairs of texts; texts that share common ones are cut into blocks, and
pairs of blocks are compared shingle by shingle in a task of their own, which
returns the links that span what it finds. No pair is missed, and a group of n
near copies costs n links, however many of its pairs aren't similar enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, components, document_columns, forest_from, forget, release, written, written_slim
from .simhash import TILE_SCHEMA, GrayIndex, _tiles, gray_rank, pairs_within, tile_pairs

LANES, TABLES, LEAD = 4, 8, 16
#: Bits in which a table's code and the whole fingerprint of early candidates may differ; the prefix filter takes the rest.
NEAR_CODE, NEAR_ALL = 16, 36
#: Shingles in this many of one text in COMMON_OF count as common, at most so many; they only order the prefixes.
COMMON_IN, COMMON_OF, COMMON_MOST = 8, 16, 100_000
#: Texts that share a shingle meet in pairs if they are so few, and else in blocks of so many texts or shingles.
LIGHT, BLOCK_TEXTS, BLOCK_SHINGLES = 32, 256, 1 << 18
#: Shingles of a pair of blocks that are counted at once.
COUNT = 1 << 13
ROW = np.dtype([("code", "<u8"), ("node", "<i8"), ("fp", "<u8", (LANES,))])


# -- hashes --------------------------------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words(dict):
    """word -> its 64-bit hash; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of a text's words in turn; A-Z count as a-z."""
        words = (text or "").encode("utf-8").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the shingles of k words, sorted; fewer words are one shingle."""
    if not len(words):
        return np.empty(0, np.int64)
    k = min(k, len(words))
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * factors[j]
    return np.unique(mixed(total).view(np.int64))


def word_fingerprint(words: np.ndarray) -> bytes:
    """SimHash of distinct words in LANES independent words of 64 bits."""
    words, out = np.unique(words), []
    for lane in range(LANES):
        bits = np.zeros(64, np.int64)
        h = mixed(words + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))
        for k in range(0, len(h), 1 << 16):
            bits += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(bits * 2 > len(h), bitorder="little").tobytes())
    return b"".join(out)


# -- texts ---------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, text): h1 and h2 are 128 bits that stand for the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of the texts, sorted, and each one's rank by its count.

    Tasks count each batch and pass on what occurs twice. The sample, its bound and
    the counts decide on nothing but which shingles a prefix takes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            sets = [shingles(known.of(t.as_py()), words) for t in b.column("text")]
            s, n = np.unique(np.concatenate(sets) if sets else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s[n > 1]), pa.array(n[n > 1])], ["s", "n"])

    some = docs.select("text").where(F.pmod(F.xxhash64(F.lit("common"), "text"), F.lit(COMMON_OF)) == 0)
    most = some.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    most = most.where(F.col("n") >= COMMON_IN).orderBy(F.desc("n"), "s").limit(COMMON_MOST).select("s").toArrow()
    s = most.column("s").to_numpy()  # the commonest first
    order = np.argsort(s)
    return s[order], (len(s) - order).astype(np.int32)


def rarest_first(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sorted shingles in the order of prefixes: common ones last, the commonest at the end."""
    s, rank = common
    if not len(s):
        return h
    at = np.minimum(np.searchsorted(s, h), len(s) - 1)
    late = np.where(s[at] == h, rank[at], 0)
    return h[np.argsort(late, kind="stable")]


def text_nodes(docs: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h1, h2) of all documents, and a node for each distinct text.

    Nodes are (node, h1, h2, least, n, fp, counts, prefix): the smallest doc_id that
    has the text, its number of shingles, its fingerprint (null without words), its
    shingles by bucket, and the first of them, the rarest first. Two texts
    with at least `least` similarity share `least` of either's shingles, so the
    first one that they share is among the first n - ceil(least * n) + 1 of both.
    """
    common = common_shingles(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            fps, sizes, firsts, counts = [], [], [], []
            for t in b.column("text"):
                w = known.of(t.as_py())
                h = rarest_first(shingles(w, words), common)
                sizes.append(len(h))
                firsts.append(h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1])
                fps.append(word_fingerprint(w) if len(w) else None)
                counts.append(bucket_counts(h))
            more = [pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), b.column("h2"), *more], ["doc_id", "h1", "h2", "n", "fp", "prefix", "counts"])

    each = written(keyed(docs).mapInArrow(run, "doc_id long, h1 long, h2 long, n int, fp binary, prefix array<long>, counts binary"), "text-features")
    nodes = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "prefix", "counts")])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "text-nodes")
    rows = written_slim(each.select("doc_id", "h1", "h2"), "text-rows")
    forget(each)
    return rows, nodes


# -- exact comparison ------------------------------------------------------------


def bucket_counts(h: np.ndarray) -> bytes | None:
    """How many shingles fall in each of some buckets, a byte each; null if a byte is too small.

    Buckets are a power of two, with two to four shingles each; they go by the low
    bits, so that adding the halves up gives the counts of half as many.
    """
    buckets = 1 << max(5, len(h).bit_length() - 2)
    out = np.bincount(h & (buckets - 1), minlength=buckets)
    return out.astype(np.uint8).tobytes() if out.max(initial=0) < 256 else None


def may_be_similar(n: np.ndarray, component: np.ndarray, counts: list[bytes | None], least: float) -> np.ndarray:
    """Which texts may have at least `least` similarity with one of another component.

    Two texts share at most the smaller of their counts in each bucket, summed up.
    """
    out = np.zeros(len(n), bool)
    i, j = np.triu_indices(len(n), 1)
    ok = (component[i] != component[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
    i, j = i[ok], j[ok]
    buckets = np.array([len(c or b"") for c in counts])
    fewest = np.minimum(buckets[i], buckets[j])
    out[i[fewest == 0]] = out[j[fewest == 0]] = True  # without counts all is possible
    for b in np.unique(fewest[fewest > 0]).tolist():
        some = np.flatnonzero(buckets >= b)
        at = np.zeros(len(n), np.int64)
        at[some] = np.arange(len(some))
        # Counts of more buckets are added up; sums stay below 2^16.
        folded = np.stack([np.frombuffer(counts[k], np.uint8).reshape(-1, b).sum(axis=0, dtype=np.uint16) for k in some])
        x, y = i[fewest == b], j[fewest == b]
        step = max(1, (1 << 22) // b)
        for k in range(0, len(x), step):
            u, v = x[k : k + step], y[k : k + step]
            o = np.minimum(folded[at[u]], folded[at[v]]).sum(axis=1, dtype=np.int64)
            near = o >= least * (n[u] + n[v] - o) - 1e-9
            out[u[near]] = out[v[near]] = True
    return out


def open_work(nodes: DataFrame, work: DataFrame, least: float) -> DataFrame:
    """The rows of work (unit, node, component) whose text may be similar to another's in its unit."""
    full = work.join(nodes.select("node", "n", "counts"), "node").select("unit", "node", "component", "n", "counts")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> list[tuple]:
            unit, node, component, n, counts = zip(*held, strict=True)
            stays = may_be_similar(np.array(n), np.array(component), list(counts), least)
            return [(unit[k], node[k], component[k]) for k in np.flatnonzero(stays)]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["unit", "node", "component"])

        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and row[0] != held[0][0]:
                    out += close()
                    held = []
                held.append(row)
            if out:
                yield rows(out)
        if held and (out := close()):
            yield rows(out)

    return full.repartition(parts, "unit").sortWithinPartitions("unit", "node").mapInArrow(run, "unit long, node long, component long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """(i, j): how many shingles two sets share."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    found, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(at, minlength=len(found)) > 1
    place = np.cumsum(often) - 1
    row, at = row[often[at]], place[at[often[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    cuts = np.searchsorted(at, np.arange(0, (at[-1] + 1 if len(at) else 0) + COUNT, COUNT))
    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if y > x:
            some = np.zeros((len(sets), min(COUNT, at[-1] + 1)), np.float32)
            some[row[x:y], at[x:y] - k * COUNT] = 1
            out += some @ some.T
    return out


def similar(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): links that span what is similar between components, the most similar first."""
    _, group = np.unique(component, return_inverse=True)
    n = np.array([len(s) for s in sets], dtype=np.float64)
    i, j = np.triu_indices(len(sets), 1)
    apart = group[i] != group[j]
    i, j = i[apart], j[apart]
    if len(i) <= 3:
        o = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.float64)
    else:
        o = overlaps(sets)[i, j].astype(np.float64)  # counts below 2^24 are exact in 32 bits
    ok = o >= least * (n[i] + n[j] - o) - 1e-9
    i, j, o = i[ok], j[ok], o[ok]
    k = nearest_forest(len(sets), group[i], group[j], -o / (n[i] + n[j]))
    return node[i[k]], node[j[k]]


def unit_links(docs: DataFrame, nodes: DataFrame, work: DataFrame, words: int, least: float) -> DataFrame:
    """(u, v): links of at least `least` Jaccard similarity between the components in each unit.

    work: (unit, node, component), units of bounded size. Texts that counts by bucket
    rule out go no further. The others are read once, from the document that stands
    for them, and their shingles go to their units alone; there all pairs are
    compared, and the links that span the similar ones are returned.
    """
    work = written_slim(open_work(nodes, work, least), "open-work")
    wanted = work.groupBy("node", "component").agg(F.collect_list("unit").alias("units"))
    wanted = wanted.join(nodes.select("node", "h1", "h2", "least"), "node")
    wanted = written_slim(wanted.select("node", "component", "units", *[F.col(c).alias(f"_{c}") for c in ("h1", "h2", "least")]), "wanted-texts")
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("doc_id").eqNullSafe(F.col("_least"))
    texts = keyed(docs).join(bounded(wanted), same).select("node", "component", "units", "text")
    kinds = pa.list_(pa.int64())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            out, held = [], 0
            for node, component, units, t in zip(*b.columns, strict=True):
                s = shingles(known.of(t.as_py()), words)
                for unit in units.as_py():
                    out.append((unit, node.as_py(), component.as_py(), s))
                    held += len(s)
                    if held > 4 * BLOCK_SHINGLES:
                        yield rows(out)
                        out, held = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        unit, node, component, sets = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(node, pa.int64()), pa.array(component, pa.int64()), pa.array(sets, kinds)], ["unit", "node", "component", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}

        def close() -> tuple[np.ndarray, np.ndarray]:
            node = np.array(list(held))  # a repeated row gives its text again; it counts once
            return similar(node, np.array([c for c, _ in held.values()]), [s for _, s in held.values()], least)

        for b in batches:
            found = []
            for unit, node, component, s in zip(*[b.column(k).to_pylist() for k in range(3)], b.column(3), strict=True):
                if unit != last:
                    if len(held) > 1:
                        found.append(close())
                    last, held = unit, {}
                held[node] = component, s.values.to_numpy()
            if found:
                u, v = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in close()], ["u", "v"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = texts.mapInArrow(spread, "unit long, node long, component long, shingles array<long>")
    sets = sets.repartition(parts, "unit").sortWithinPartitions("unit", "node")
    links = written_slim(sets.mapInArrow(compare, "u long, v long").distinct(), "unit-links")
    forget(wanted)
    forget(work)
    return links


# -- the Gray-order index --------------------------------------------------------


def chosen_bits(table: int) -> np.ndarray:
    """The 64 bits of the fingerprint that make a table's code, the leading ones first."""
    return np.random.default_rng(1000 + table).permutation(64 * LANES)[:64]


def table_codes(fp: np.ndarray, tables: int) -> np.ndarray:
    """(tables, rows): every table's codes of fingerprints given as bytes, 8 * LANES a row."""
    bits = np.unpackbits(fp.reshape(-1, 8 * LANES), axis=1, bitorder="little")
    out = [np.ascontiguousarray(np.packbits(bits[:, chosen_bits(t)], axis=1)).view(">u8").ravel() for t in range(tables)]
    return np.array(out, dtype=np.uint64).reshape(tables, len(bits))


def _file(tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, code in enumerate(table_codes(np.frombuffer(b"".join(b["fp"]), np.uint8), tables)):
                rank = gray_rank(code) ^ np.uint64(1 << 63)
                yield pd.DataFrame({"rotation": np.int32(t), "rank": rank.view(np.int64), "code": code.view(np.int64), "node": b["node"].to_numpy(), "fp": b["fp"].to_numpy()})

    return run


def nearest_forest(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Indexes of a minimum spanning forest's pairs (Boruvka's rounds over whole arrays)."""
    root = np.arange(n)
    order = np.lexsort((j, i, far))  # ties broken the same way everywhere
    i, j, kept = i[order], j[order], []
    place = np.arange(len(i))
    while len(place):
        a, b = root[i[place]], root[j[place]]
        off = a != b
        place, a, b = place[off], a[off], b[off]
        if not len(place):
            break
        best = np.full(n, len(i))
        np.minimum.at(best, a, place)
        np.minimum.at(best, b, place)
        new = np.unique(best[best < len(i)])
        kept.append(new)
        root = forest_from(root, i[new], j[new])
    return order[np.concatenate(kept)] if kept else np.empty(0, np.int64)


def _compare(near_code: int, near_all: int):
    """(unit, node, component): texts to compare, along links that span the candidates within each row's tiles, nearest first.

    A pair that met in an earlier table is left to that one. A unit is some of the
    links of one tree; every text is a component of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, x, y in zip(batch["rotation"], batch["codes"], batch["codes2"], strict=True):
                a = np.frombuffer(x, ROW)
                if y is None:
                    both, shift = a, 0
                    index = GrayIndex(np.ascontiguousarray(a["code"]))
                    pairs = pairs_within(index, index, near_code, True)
                else:
                    b = np.frombuffer(y, ROW)
                    both, shift = np.concatenate([a, b]), len(a)
                    pairs = pairs_within(GrayIndex(np.ascontiguousarray(a["code"])), GrayIndex(np.ascontiguousarray(b["code"])), near_code, False)
                found = []
                for i, j in pairs:
                    j = j + shift
                    far = np.bitwise_count(both["fp"][i] ^ both["fp"][j]).sum(axis=1, dtype=np.int64)
                    ok = far <= near_all
                    found.append((i[ok], j[ok], far[ok]))
                if not found:
                    continue
                i, j, far = (np.concatenate(c) for c in zip(*found, strict=True))
                if t and len(i):
                    for code in table_codes(np.ascontiguousarray(both["fp"]).view(np.uint8), int(t)):
                        apart = code[i] ^ code[j]
                        new = (apart >> np.uint64(64 - LEAD) != 0) | (np.bitwise_count(apart) > near_code)
                        i, j, far = i[new], j[new], far[new]
                k = nearest_forest(len(both), i, j, far)
                if len(k):
                    i, j = i[k], j[k]
                    tree = forest_from(np.arange(len(both)), i, j)[i]
                    order = np.lexsort((j, i, tree))
                    i, j, tree = i[order], j[order], tree[order]
                    at = np.arange(len(tree)) - np.searchsorted(tree, tree)
                    # The tree's first text, the table and the piece name the unit.
                    unit = both["node"][tree].view(np.uint64) * np.uint64(1 << 20) + (at // (BLOCK_TEXTS // 2) * TABLES + t).astype(np.uint64)
                    unit = np.concatenate([mixed(unit), mixed(unit)]).view(np.int64)
                    node = both["node"][np.concatenate([i, j])]
                    yield pd.DataFrame({"unit": unit, "node": node, "component": node}).drop_duplicates()

    return run


def index_candidates(nodes: DataFrame) -> DataFrame:
    """(unit, node, component): texts with near fingerprints, to be compared."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = nodes.where("fp IS NOT NULL").select("node", "fp").mapInPandas(_file(TABLES), "rotation int, rank long, code long, node long, fp binary")
    filed = filed.repartitionByRange(parts, "rotation", "rank", "node").sortWithinPartitions("rotation", "rank", "node")
    tiles = written(filed.select("rotation", "code", "node", "fp").mapInPandas(_tiles([LEAD] * TABLES, ROW), TILE_SCHEMA), "text-tiles")
    found = tile_pairs(tiles, NEAR_CODE, parts).mapInPandas(_compare(NEAR_CODE, NEAR_ALL), "unit long, node long, component long")
    found = written_slim(found, "index-candidates")
    forget(tiles)
    return found


# -- the exact prefix filter -----------------------------------------------------


def shared_prefixes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(s, node, n, component, at, m): prefix shingles that texts of more than one component have; m texts have s.

    nodes: (node, n, prefix); groups: (node, component) of those that have links.
    """
    nodes = _grouped(nodes.select("node", "n", "prefix"), groups)
    spread = nodes.select("node", "component", F.posexplode("prefix").alias("at", "s"))
    shared = spread.groupBy("s").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("s")
    hits = written_slim(spread.select("s", "node", "at").join(shared, "s"), "shared-shingles")
    often = hits.groupBy("s").agg(F.count("*").alias("m"))
    out = hits.join(often, "s").join(nodes.select("node", "n", "component"), "node")
    out = written_slim(out.select("s", "node", "n", "component", "at", "m"), "prefix-hits")
    forget(hits)
    return out


def light_work(hits: DataFrame, least: float) -> DataFrame:
    """(unit, node, component): pairs of two components that share only shingles of few texts and may be similar enough.

    They share enough of their prefixes for what lies behind these to make up the
    rest. A unit is a text with some of its partners.
    """
    few = hits.where(F.col("m") <= LIGHT)
    u, v = (few.select("s", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "at")]) for x in "uv")
    met = u.join(v, "s").where(f"node_u < node_v AND component_u <> component_v AND least(n_u, n_v) >= {least} * greatest(n_u, n_v) - 1e-9")
    met = met.groupBy("node_u", "node_v").agg(
        *[F.first(c).alias(c) for c in ("n_u", "n_v", "component_u", "component_v")], F.count("*").alias("o"), F.max(F.expr("least(n_u - at_u, n_v - at_v)")).alias("most")
    )
    # All that two texts share comes at or behind the first that they share; and what isn't in both prefixes is behind the prefix that ends first.
    need = f"({least} * (n_u + n_v) / {1 + least} - 1e-6)"
    behind = f"ceil({least} * greatest(n_u, n_v) - 1e-9) - 1"
    met = written_slim(met.where(f"most >= {need} AND o + {behind} >= {need}").select("node_u", "node_v", "component_u", "component_v"), "light-pairs")
    # Partners enough for more than one unit are dealt out by hash.
    often = met.groupBy("node_u").agg(F.count("*").alias("_n"))
    met = met.join(often, "node_u").withColumn("unit", F.xxhash64("node_u", F.expr(f"pmod(xxhash64(node_v), 1 + _n div {BLOCK_TEXTS // 2})")))
    return met.select("unit", F.col("node_u").alias("node"), F.col("component_u").alias("component")).union(met.select("unit", "node_v", "component_v")).distinct()


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted texts (node, n, component) with their task, and how many texts and shingles lie before each of them in it."""
    from pyspark import TaskContext

    part, at, size = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b["n"].to_numpy(np.int64)
        ends = size + np.cumsum(n)
        yield pd.DataFrame({"node": b["node"], "n": b["n"], "component": b["component"], "part": part, "at": at + np.arange(len(n)), "size": ends - n})
        at, size = at + len(n), int(ends[-1]) if len(n) else size


def blocks(texts: DataFrame, order: list[str]) -> DataFrame:
    """(node, component, block): texts in the given order in blocks of BLOCK_TEXTS texts, or of BLOCK_SHINGLES shingles and one text more.

    Places count over all tasks, so the number of blocks doesn't go by that of partitions.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("node", "n", "component")
    run = written(run.mapInPandas(_places, "node long, n int, component long, part int, at long, size long"), "places")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = run.groupBy("part").agg(F.count("*").alias("_at"), F.sum("n").alias("_size"))
    ends = ends.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_at", "_size")])  # a row a partition
    # Neither quotient ever falls, so their sum tells when one of them rises.
    block = F.expr(f"(_at + at) div {BLOCK_TEXTS} + (_size + size) div {BLOCK_SHINGLES}")
    out = written_slim(run.join(F.broadcast(ends), "part").select("node", "component", block.alias("block")), "blocks")
    forget(run)
    return out


def block_work(hits: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """(unit, node, component): the texts that each pair of blocks compares, and the tables that these come from.

    Texts with shingles of many texts lie in one block with those that have the same
    commonest shingle and about as many shingles; components that fill blocks have
    blocks of their own, which needn't meet one another. If s, at place `at`, is the first
    shingle that a text of n shingles shares with a similar one, that one has at
    least least * n and at most (n - at) * (1 + least) / least - n shingles; a text
    meets a block only if some text there has s and a size in that range, and the
    other way round. A unit whose texts are of one component has nothing to find.
    """
    many = hits.where(F.col("m") > LIGHT)
    texts = many.groupBy("node", "n", "component").agg(F.max(F.struct("m", "s")).alias("lead"))
    texts = written_slim(texts.select("node", "n", "component", F.col("lead.m").alias("m"), F.col("lead.s").alias("s")), "leads")
    large = texts.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") >= BLOCK_TEXTS).select("component", F.col("component").alias("own"))
    large = written_slim(large, "large-components")
    leads, texts = texts, blocks(texts.join(bounded(large), "component", "left"), ["own", "m", "s", "n", "node"])
    for t in (leads, large):
        forget(t)
    at = many.select("s", "node", "n", "component", F.expr(f"{least} * n - 1e-6").alias("lo"), F.expr(f"(n - at) * {(1 + least) / least!r} - n + 1e-6").alias("hi"))
    at = written_slim(at.join(texts.select("node", "block"), "node"), "block-shingles")
    others = at.groupBy("s", F.col("block").alias("other")).agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("lo").alias("lo0"), F.max("hi").alias("hi1"), F.min("component").alias("c0"), F.max("component").alias("c1")
    )
    met = at.join(others, "s").where("n0 <= hi AND n1 >= lo AND n >= lo0 AND n <= hi1 AND (c0 <> component OR c1 <> component)")
    met = met.select("node", "component", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).distinct()
    met = written_slim(met, "block-meetings")
    open_ = met.groupBy("a", "b").agg(*[f(c).alias(f"{c}{k}") for c in ("block", "component") for k, f in enumerate((F.min, F.max))])
    open_ = open_.where("component0 < component1 AND (a = b OR block0 < block1)").select("a", "b")
    work = met.join(open_, ["a", "b"])
    return work.select(F.xxhash64(F.lit("blocks"), "a", "b").alias("unit"), "node", "component"), [texts, at, met]


# -- groups ----------------------------------------------------------------------


def near_duplicate_texts(docs: DataFrame, words: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h1, h2), and every distinct text's group: (node, h1, h2, least, component).

    docs: doc_id, text; other columns are ignored. Equal texts are one node (null
    is a text of its own; texts without words are equal only to themselves). A group
    is all texts that links of at least `least` similarity connect; `least` of a row
    is the smallest doc_id that has its text, null if it has none. No rows give no rows.
    """
    rows, nodes = text_nodes(docs, words, least)
    work = index_candidates(nodes)
    links = unit_links(docs, nodes, work, words, least)
    groups = written_slim(components(links), "text-groups")
    forget(work)
    forget(links)
    release(docs.sparkSession)

    hits = shared_prefixes(nodes.where("n > 0"), groups)
    work, tables = block_work(hits, least)
    work = written_slim(light_work(hits, least).unionByName(work), "prefix-work")
    release(docs.sparkSession)
    links = unit_links(docs, nodes, work, words, least)
    for t in (hits, *tables, work):
        forget(t)

    # The groups that the links connect are one.
    end = _grouped(nodes.select("node"), groups)
    wider = links.join(end.toDF("u", "cu"), "u").join(end.toDF("v", "cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    wider = components(wider).toDF("_c", "_wider")
    out = _grouped(nodes.select("node", "h1", "h2", "least"), groups).join(wider, F.col("component") == F.col("_c"), "left")
    out = written_slim(out.select("node", "h1", "h2", "least", F.coalesce("_wider", "component").alias("component")), "near-groups")
    for t in (nodes, groups, links):
        forget(t)
    return rows, out


def _grouped(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """The nodes with their component; a node without links is its own."""
    return nodes.join(bounded(groups), "node", "left").withColumn("component", F.coalesce("component", "node"))


def without_near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates, the one with the smallest id.

    Rows with that id and the same text repeat one another; one of them stays. In a
    group without any id one row stays. Texts of one id in one group keep the text
    with the smallest node. Only the rows that go are joined with the documents.
    """
    rows, groups = near_duplicate_texts(docs, words, least)
    key = ["doc_id", "h1", "h2"]
    # The smallest id, then the smallest node; ids come before null.
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("best"))
    stays = groups.join(best.select(F.col("best.node").alias("node")), "node", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in ("least", "h1", "h2")])
    same = F.col("doc_id").eqNullSafe(F.col("_least")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    every = rows.groupBy(*key).agg(F.count("*").alias("copies"))
    marked = every.join(stays, same, "left").select(*key, "copies", F.col("_h1").isNotNull().alias("stays"))
    marked = written(marked.where("NOT stays OR copies > 1").select(F.col("doc_id").alias("_id"), F.col("h1").alias("_g1"), F.col("h2").alias("_g2"), "stays"), "near-duplicates")
    forget(rows)
    forget(groups)

    columns = document_columns(docs)
    whole = docs.select(*columns, F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))
    out = whole.join(bounded(marked), same, "left_anti")
    repeated = marked.where("stays")
    if not repeated.isEmpty():
        again = whole.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_h1", "_h2"])
        out = out.unionByName(again)
    return out.select(*columns)
