"""Queries over look-ups, edit logs, metadata and bytes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismlake.functions import binary, metadata
from prismlake.operators import history, lookup
from prismlake.sources import rasters
from prismlake.sources.rasters import table

from .oracle import EDITS, TAGS, hex_parts

Q: dict = {}
SQL: dict[str, str] = {}
C = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("jon02_lut", "SELECT l_orderkey, l_linenumber, l_quantity::INT AS v, ((l_quantity::INT * 13) % 50)::INT AS out FROM lineitem")
def _(spark, d):
    lut = spark.range(0, 51).select(C("id").cast("int").alias("v"), (C("id") * 13 % 50).cast("int").alias("out"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C("l_quantity").cast("int").alias("v"))
    return lookup.by_value(items, "v", lut)


@query("jon03_first_contains", "WITH m AS (SELECT DISTINCT substr(p_brand, 1, 7) AS t FROM part), f AS (SELECT t, arg_min({'k': p_partkey, 'n': p_brand}, p_partkey) AS m FROM m JOIN part ON contains(p_brand, t) GROUP BY t) SELECT p_partkey AS part, f.m.k AS camera, f.m.n AS name FROM part LEFT JOIN f ON f.t = substr(p_brand, 1, 7)")
def _(spark, d):
    part = table(spark, d, "part")
    dim = part.select(C("p_partkey").alias("camera"), C("p_brand").alias("name"))
    images = part.select(C("p_partkey").alias("part"), F.substring("p_brand", 1, 7).alias("t"))
    return lookup.first_containing(images, "t", dim, "name", "camera", ["camera", "name"]).drop("t")


@query("jon04_geometry", "WITH g AS (SELECT p_size AS w, p_partkey % 7 AS h, min(p_retailprice) AS crop FROM part GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, l_quantity::INT AS w, l_partkey % 7 AS h, g.crop FROM lineitem LEFT JOIN g ON g.w = l_quantity::INT AND g.h = l_partkey % 7")
def _(spark, d):
    g = table(spark, d, "part").groupBy(C("p_size").alias("w"), (C("p_partkey") % 7).alias("h")).agg(F.min("p_retailprice").alias("crop"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C("l_quantity").cast("int").alias("w"), (C("l_partkey") % 7).alias("h"))
    return items.join(lookup.small(g), ["w", "h"], "left")


_CAM = "SELECT p_brand AS make, p_type AS model, CASE WHEN p_size % 3 = 0 THEN '' ELSE (p_size % 5)::VARCHAR END AS mode, p_partkey AS ord FROM part"


@query("jon05_camera_mode", f"WITH c AS ({_CAM}), e AS (SELECT make, model, mode, min(ord) AS o FROM c GROUP BY 1, 2, 3), a AS (SELECT make, model, min(ord) AS o FROM c GROUP BY 1, 2) SELECT i.p_partkey AS image_id, coalesce(e.o, a.o) AS ord FROM (SELECT *, (p_partkey % 6)::VARCHAR AS mode FROM part) i LEFT JOIN e ON e.make = p_brand AND e.model = p_type AND e.mode = i.mode LEFT JOIN a ON a.make = p_brand AND a.model = p_type")
def _(spark, d):
    p = table(spark, d, "part")
    mode = F.when(C("p_size") % 3 == 0, "").otherwise((C("p_size") % 5).cast("string"))
    dim = p.select(C("p_brand").alias("make"), C("p_type").alias("model"), mode.alias("mode"), C("p_partkey").alias("ord"))
    images = p.select(C("p_partkey").alias("image_id"), C("p_brand").alias("make"), C("p_type").alias("model"), (C("p_partkey") % 6).cast("string").alias("mode"))
    return lookup.by_mode(images, dim, ["ord"]).select("image_id", "ord")


_RANGES = "SELECT s_nationkey AS camera, s_suppkey AS ord, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE (s_suppkey % 10) * 5 END AS lo, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 4 = 1 THEN 0 ELSE (s_suppkey % 10) * 5 + 20 END AS hi, (s_suppkey * 3)::BIGINT AS black FROM supplier"


@query(
    "jon06_iso_range",
    f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY camera) = 1 AS one FROM ({_RANGES})),
    i AS (SELECT c_custkey AS image_id, c_nationkey AS camera, c_custkey % 60 AS iso FROM customer),
    m AS (SELECT i.*, r.black, row_number() OVER (PARTITION BY image_id ORDER BY (lo = 0 AND hi = 0), ord) AS k FROM i LEFT JOIN r ON r.camera = i.camera AND (one OR (iso >= lo AND (iso <= hi OR hi = 0))))
    SELECT image_id, camera, iso, black FROM m WHERE k = 1""",
)
def _(spark, d):
    k = C("s_suppkey")
    lo = F.when(k % 4 == 0, 0).otherwise(k % 10 * 5)
    hi = F.when((k % 4).isin(0, 1), 0).otherwise(k % 10 * 5 + 20)
    dim = table(spark, d, "supplier").select(C("s_nationkey").alias("camera"), k.alias("ord"), lo.alias("lo"), hi.alias("hi"), (k * 3).alias("black"))
    images = table(spark, d, "customer").select(C("c_custkey").alias("image_id"), C("c_nationkey").alias("camera"), (C("c_custkey") % 60).alias("iso"))
    return lookup.by_range(images, "camera", "iso", dim, ["black"])


@query("jon07_by_size", "WITH c AS (SELECT DISTINCT p_size AS size, p_size * 2 AS camera FROM part) SELECT l_orderkey, l_linenumber, c.camera FROM lineitem LEFT JOIN c ON c.size = l_quantity::INT")
def _(spark, d):
    c = table(spark, d, "part").select(C("p_size").alias("size"), (C("p_size") * 2).alias("camera")).distinct()
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C("l_quantity").cast("int").alias("size")).join(lookup.small(c), "size", "left").drop("size")


@query("jon11_range_overlap", "WITH r AS (SELECT user_id AS owner, event_id AS id, (event_id * 7919 % 100000)::BIGINT AS lo, (event_id * 7919 % 100000 + event_id % 997)::BIGINT AS hi FROM events) SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.owner = a.owner AND b.id < a.id AND a.lo < b.hi AND b.lo < a.hi)")
def _(spark, d):
    lo = C("event_id") * 7919 % 100000
    r = table(spark, d, "events").select(C("user_id").alias("owner"), C("event_id").alias("id"), lo.alias("lo"), (lo + C("event_id") % 997).alias("hi"))
    return lookup.without_overlap(r)


@query(
    "jon12_recursive_tag",
    """WITH RECURSIVE n AS (SELECT 1000000000::BIGINT + r_regionkey AS id, NULL::BIGINT AS parent FROM region UNION ALL SELECT 2000000000::BIGINT + n_nationkey, 1000000000::BIGINT + n_regionkey FROM nation UNION ALL SELECT 3000000000::BIGINT + c_custkey, 2000000000::BIGINT + c_nationkey FROM customer),
    t AS (SELECT id, id AS root, 0 AS level FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.root, t.level + 1 FROM n JOIN t ON n.parent = t.id) SELECT id, root, level FROM t""",
)
def _(spark, d):
    base = lambda c, k: (C(c) + k).cast("long")
    n = table(spark, d, "region").select(base("r_regionkey", 1000000000).alias("id"), F.lit(None).cast("long").alias("parent"))
    n = n.unionByName(table(spark, d, "nation").select((F.lit(2000000000).cast("long") + C("n_nationkey")).alias("id"), base("n_regionkey", 1000000000).alias("parent")))
    n = n.unionByName(table(spark, d, "customer").select((F.lit(3000000000) + C("c_custkey")).alias("id"), (F.lit(2000000000).cast("long") + C("c_nationkey")).alias("parent")))
    return lookup.tree_paths(n, 3).select("id", "root", "level")


@query("jon12_first_tag", f"WITH {TAGS} SELECT image_id, arg_min(num, preorder) AS num, arg_min(text, preorder) AS text FROM tags WHERE tag = 3 GROUP BY 1")
def _(spark, d):
    return lookup.first_tag(rasters.tags(spark, d), 3)


@query("jon13_alias", "SELECT s_suppkey, coalesce(map_extract(map {0: 'zero', 1: 'one', 2: 'two'}, (s_suppkey % 4)::INT)[1], s_name) AS alias FROM supplier")
def _(spark, d):
    alias = F.create_map(*[F.lit(x) for kv in {0: "zero", 1: "one", 2: "two"}.items() for x in kv])
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.try_element_at(alias, (C("s_suppkey") % 4).cast("int")), C("s_name")).alias("alias"))


@query("flt09_semi_tag", f"WITH {TAGS}, i AS (SELECT DISTINCT image_id, ifd_id FROM tags) SELECT image_id, ifd_id FROM i WHERE EXISTS (SELECT 1 FROM tags t WHERE t.image_id = i.image_id AND t.ifd_id = i.ifd_id AND t.tag = 5)")
def _(spark, d):
    t = rasters.tags(spark, d)
    return lookup.directories_with_tag(t.select("image_id", "ifd_id").distinct(), t, 5)


@query("flt10_semi_tag_value", f"WITH {TAGS}, i AS (SELECT DISTINCT image_id, ifd_id FROM tags) SELECT image_id, ifd_id FROM i WHERE EXISTS (SELECT 1 FROM tags t WHERE t.image_id = i.image_id AND t.ifd_id = i.ifd_id AND t.tag = 5 AND t.text = 'click')")
def _(spark, d):
    t = rasters.tags(spark, d)
    return lookup.directories_with_tag(t.select("image_id", "ifd_id").distinct(), t.where("text = 'click'"), 5)


@query("flt08_raw_directories", f"WITH {TAGS} SELECT image_id, preorder FROM tags WHERE tag IN (1, 7) AND (preorder & 1) = 0")
def _(spark, d):
    return rasters.tags(spark, d).where(C("tag").isin(1, 7) & (C("preorder").bitwiseAND(1) == 0)).select("image_id", "preorder")


@query("flt07_valid_ranges", "SELECT doc_id, (doc_id * 37 % 3000 + 500 <= strlen(text)) AS valid FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (C("doc_id") * 37 % 3000 + 500 <= F.octet_length("text")).alias("valid"))


@query("flt13_every_16th", "SELECT doc_id, len(list_filter(generate_series(16, strlen(text)::BIGINT, 16), lambda i: hex(encode(text))[2 * i - 1:2 * i] = '20')) > 0 AS found FROM documents")
def _(spark, d):
    hit = F.expr("exists(filter(sequence(16, greatest(octet_length(text), 16), 16), i -> i <= octet_length(text)), i -> hex(substring(encode(text, 'UTF-8'), i, 1)) = '20')")
    return table(spark, d, "documents").select("doc_id", hit.alias("found"))


@query("set02_first_tags", f"WITH {TAGS}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id, ifd_id, tag ORDER BY preorder) AS k FROM tags) SELECT image_id, ifd_id, tag, num, text FROM n WHERE k = 1")
def _(spark, d):
    return lookup.first_of_each(rasters.tags(spark, d)).select("image_id", "ifd_id", "tag", "num", "text")


@query("set01_merge_tags", f"WITH {TAGS} SELECT image_id, tag, num FROM tags WHERE ifd_id = 1 UNION ALL SELECT image_id, tag, num FROM tags WHERE ifd_id = 2")
def _(spark, d):
    t = rasters.tags(spark, d).select("image_id", "ifd_id", "tag", "num")
    return t.where("ifd_id = 1").unionByName(t.where("ifd_id = 2")).drop("ifd_id")


@query("srt03_widest", f"WITH {TAGS} SELECT image_id, arg_max(ifd_id, [num, -preorder]) AS ifd_id FROM tags GROUP BY 1")
def _(spark, d):
    return rasters.tags(spark, d).groupBy("image_id").agg(F.max_by("ifd_id", F.struct("num", -C("preorder"))).alias("ifd_id"))


@query("srt04_code_order", f"WITH {TAGS} SELECT preorder, row_number() OVER (PARTITION BY image_id ORDER BY tag, preorder DESC) AS code FROM tags")
def _(spark, d):
    w = Window.partitionBy("image_id").orderBy("tag", F.desc("preorder"))
    return rasters.tags(spark, d).select("preorder", F.row_number().over(w).alias("code"))


@query("srt06_first_preview", f"WITH {TAGS} SELECT image_id, min(preorder) AS preorder FROM tags WHERE tag = 1 AND ifd_id > 0 GROUP BY 1")
def _(spark, d):
    return rasters.tags(spark, d).where("tag = 1 AND ifd_id > 0").groupBy("image_id").agg(F.min("preorder").alias("preorder"))


@query("agg12_exif_groups", f"WITH {TAGS} SELECT image_id, text AS grp, string_agg(tag::VARCHAR, ',' ORDER BY preorder) AS fields FROM tags GROUP BY 1, 2")
def _(spark, d):
    t = rasters.tags(spark, d).groupBy("image_id", C("text").alias("grp"))
    return t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("preorder", "tag"))), lambda x: x["tag"].cast("string")), ",").alias("fields"))


@query("agg13_strip_total", "SELECT doc_id % 50 AS image_id, sum(strlen(text))::BIGINT AS total FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy((C("doc_id") % 50).alias("image_id")).agg(F.sum(F.octet_length("text")).alias("total"))


@query("agg14_error_threshold", f"WITH {TAGS} SELECT image_id, count(*) FILTER (WHERE num < 10) AS errors, count(*) FILTER (WHERE num < 10) > count(*) // 4 AS too_many FROM tags GROUP BY 1")
def _(spark, d):
    t = rasters.tags(spark, d).groupBy("image_id").agg(F.count(F.when(C("num") < 10, 1)).alias("errors"), F.count("*").alias("n"))
    return t.select("image_id", "errors", (C("errors") > F.floor(C("n") / 4)).alias("too_many"))


@query("agg16_code_lengths", "SELECT length(c_name) % 17 AS len, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy((F.length("c_name") % 17).cast("long").alias("len")).agg(F.count("*").alias("n"))


@query(
    "win18_undo_redo",
    f"""WITH RECURSIVE {EDITS}, e AS (SELECT image_id, effect, row_number() OVER (PARTITION BY image_id ORDER BY seq) AS k FROM edits),
    s AS (SELECT image_id, 0::BIGINT AS k, -1 AS pos, 0 AS size FROM (SELECT DISTINCT image_id FROM edits) UNION ALL
      SELECT s.image_id, e.k, CASE WHEN effect = 'error' THEN greatest(pos - 1, -1) WHEN effect = 'view' THEN least(pos + 1, size - 1) ELSE pos + 1 END, CASE WHEN effect IN ('error', 'view') THEN size ELSE size + 1 END FROM s JOIN e ON e.image_id = s.image_id AND e.k = s.k + 1)
    SELECT image_id, arg_max(pos, k) AS position, arg_max(size, k) AS size FROM s GROUP BY 1""",
)
def _(spark, d):
    return history.folded(rasters.edits(spark, d), "error", "view")


@query(
    "win18_cursor",
    f"""WITH RECURSIVE {EDITS}, e AS (SELECT image_id, seq, effect, row_number() OVER (PARTITION BY image_id ORDER BY seq) AS k FROM edits),
    s AS (SELECT image_id, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS effect, -1 AS pos, 0 AS size FROM (SELECT DISTINCT image_id FROM edits) UNION ALL
      SELECT s.image_id, e.k, e.seq, e.effect, CASE WHEN e.effect = 'error' THEN greatest(pos - 1, -1) WHEN e.effect = 'view' THEN least(pos + 1, size - 1) ELSE pos + 1 END, CASE WHEN e.effect = 'error' OR e.effect = 'view' THEN size ELSE pos + 2 END FROM s JOIN e ON e.image_id = s.image_id AND e.k = s.k + 1)
    SELECT image_id, seq, effect, pos AS position FROM s WHERE k > 0""",
)
def _(spark, d):
    return history.cursor(rasters.edits(spark, d), "error", "view", True)


@query(
    "win19_first_diff",
    f"""WITH {EDITS}, s AS (SELECT image_id, seq, floor(value / 50)::INT AS exposure, (seq % 3)::INT AS contrast, length(effect)::INT AS shadow FROM edits),
    b AS (SELECT *, lag(exposure) OVER w AS e0, lag(contrast) OVER w AS c0, lag(shadow) OVER w AS s0, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY image_id ORDER BY seq))
    SELECT image_id, seq, CASE WHEN exposure IS DISTINCT FROM e0 THEN 'exposure' WHEN contrast IS DISTINCT FROM c0 THEN 'contrast' WHEN shadow IS DISTINCT FROM s0 THEN 'shadow' END AS target,
    (CASE WHEN exposure IS DISTINCT FROM e0 THEN e0 WHEN contrast IS DISTINCT FROM c0 THEN c0 WHEN shadow IS DISTINCT FROM s0 THEN s0 END)::DOUBLE AS old,
    (CASE WHEN exposure IS DISTINCT FROM e0 THEN exposure WHEN contrast IS DISTINCT FROM c0 THEN contrast WHEN shadow IS DISTINCT FROM s0 THEN shadow END)::DOUBLE AS new FROM b WHERE k > 1""",
)
def _(spark, d):
    s = rasters.edits(spark, d).select("image_id", "seq", F.floor(C("value") / 50).cast("int").alias("exposure"), (C("seq") % 3).cast("int").alias("contrast"), F.length("effect").alias("shadow"))
    return history.first_difference(s, ["exposure", "contrast", "shadow"])


@query("str10_edit_text", f"WITH {EDITS} SELECT seq, effect || ' from ' || seq::VARCHAR || ' to ' || (seq + 1)::VARCHAR AS text FROM edits")
def _(spark, d):
    return rasters.edits(spark, d).select("seq", history.edit_text(C("effect"), C("seq").cast("string"), (C("seq") + 1).cast("string")).alias("text"))


@query("win14_prefix_decode", "WITH b AS (SELECT user_id AS y, event_id AS x, (floor(value)::INT % 32) - 16 AS diff FROM events) SELECT y, x, (sum(diff) OVER (PARTITION BY y ORDER BY x) & 65535)::INT AS v FROM b")
def _(spark, d):
    w = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    b = table(spark, d, "events").select(C("user_id").alias("y"), C("event_id").alias("x"), (F.floor("value").cast("int") % 32 - 16).alias("diff"))
    return b.select("y", "x", F.sum("diff").over(w).bitwiseAND(65535).cast("int").alias("v"))


@query("win15_strip_offsets", "SELECT doc_id % 50 AS image_id, doc_id, (sum(strlen(text)) OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) - strlen(text))::BIGINT AS off FROM documents")
def _(spark, d):
    w = Window.partitionBy("image_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    s = table(spark, d, "documents").select((C("doc_id") % 50).alias("image_id"), "doc_id", F.octet_length("text").alias("n"))
    return s.select("image_id", "doc_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("off"))


@query("str01_until_nul", "SELECT doc_id, text AS head FROM documents")
def _(spark, d):
    text = F.concat("text", F.lit("\0"), F.lit("rest"))
    return table(spark, d, "documents").select("doc_id", metadata.until_nul(text).alias("head"))


@query("str02_prefix", "SELECT p_partkey, starts_with(p_type, 'STANDARD') AS standard, contains(p_name, 'a') AS has_a, CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS brand FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", C("p_type").startswith("STANDARD").alias("standard"), C("p_name").contains("a").alias("has_a"), metadata.without_prefix(C("p_brand"), "Brand#").alias("brand"))


@query("str05_tag_text", "SELECT event_id, event_id::VARCHAR || ' ' || (event_id * 3)::VARCHAR || ' ' || user_id::VARCHAR AS text FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", metadata.tag_text(F.array(C("event_id"), C("event_id") * 3, C("user_id"))).alias("text"))


@query("str06_cfa_string", "SELECT s_suppkey, array_to_string([['Red', 'Green', 'Blue'][(s_suppkey % 3 + 1)::INT][1], 'G', ['Red', 'Green', 'Blue'][(s_suppkey % 2 + 2)::INT][1]], '') AS cfa FROM supplier")
def _(spark, d):
    names = F.array(F.lit("Red"), F.lit("Green"), F.lit("Blue"))
    pick = lambda k: F.element_at(names, k.cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", metadata.cfa_text(F.array(pick(C("s_suppkey") % 3 + 1), F.lit("Green"), pick(C("s_suppkey") % 2 + 2))).alias("cfa"))


@query("str07_exposure", "SELECT event_id, CASE WHEN event_id % 9 >= 1 THEN (event_id % 9)::VARCHAR || 's' ELSE '1/' || round(1.0::DOUBLE / (1.0::DOUBLE / (event_id % 500 + 2)))::BIGINT::VARCHAR || 's' END AS text FROM events")
def _(spark, d):
    whole = F.concat((C("event_id") % 9).cast("string"), F.lit("s"))
    return table(spark, d, "events").select("event_id", F.when(C("event_id") % 9 >= 1, whole).otherwise(metadata.exposure_text(F.lit(1.0) / (C("event_id") % 500 + 2))).alias("text"))


@query("str08_gps", "SELECT event_id, (event_id % 180)::VARCHAR || '°' || (event_id % 60)::VARCHAR || '''' || (event_id % 59)::VARCHAR || '\"N' AS place, CASE WHEN event_id % 2 = 1 THEN -value ELSE value END AS altitude FROM events")
def _(spark, d):
    degrees = F.array(C("event_id") % 180, C("event_id") % 60, C("event_id") % 59)
    return table(spark, d, "events").select("event_id", metadata.gps_text(degrees, F.lit("N")).alias("place"), metadata.altitude(C("value"), C("event_id") % 2).alias("altitude"))


@query("str09_elapsed", "SELECT event_id, (event_id * 37 // 1000)::VARCHAR || 's ' || (event_id * 37 % 1000)::VARCHAR || 'ms' AS text FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", metadata.elapsed_text(C("event_id") * 37).alias("text"))


@query("str11_serial", "SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: CASE WHEN ascii(c) BETWEEN 48 AND 57 THEN ascii(c) - 48 ELSE ascii(c) % 10 END::BIGINT)), lambda a, c: (a * 10 + c) & 4294967295) AS serial FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", metadata.digit_fold(C("c_name")).alias("serial"))


_IMG = "SELECT p_partkey AS image_id, p_name AS file, p_size * 100 AS width, p_size * 75 AS height, 14 AS depth, p_brand AS make, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS model, (p_partkey % 4 * 100)::INT AS iso, (p_partkey % 35)::INT AS focal FROM part"


@query(
    "str12_exif_rows",
    f"""WITH i AS ({_IMG}), f AS (SELECT image_id, 'Parser' AS grp, 'File' AS name, file AS data, 0 AS ord FROM i UNION ALL SELECT image_id, 'Camera', 'Dimension', width::VARCHAR || ' x ' || height::VARCHAR, 1 FROM i UNION ALL SELECT image_id, 'Image', 'Color depth', '14 bits', 2 FROM i
    UNION ALL SELECT image_id, 'Camera', 'Maker', make, 3 FROM i UNION ALL SELECT image_id, 'Camera', 'Model', model, 4 FROM i UNION ALL SELECT image_id, 'Shot', 'ISO', iso::VARCHAR, 5 FROM i WHERE iso > 0 UNION ALL SELECT image_id, 'Lens', 'Focal', focal::VARCHAR || ' mm', 8 FROM i WHERE focal > 0)
    SELECT * FROM f WHERE data IS NOT NULL AND data <> ''""",
)
def _(spark, d):
    k = C("p_partkey")
    images = table(spark, d, "part").select(
        k.alias("image_id"), C("p_name").alias("file"), (C("p_size") * 100).alias("width"), (C("p_size") * 75).alias("height"), F.lit(14).alias("depth"), C("p_brand").alias("make"), F.when(k % 5 == 0, "").otherwise(C("p_type")).alias("model"),
        (k % 4 * 100).cast("int").alias("iso"), F.lit(None).cast("double").alias("exposure"), F.lit("").alias("lens"), (k % 35).cast("int").alias("focal"), F.lit(None).cast("string").alias("time_take"),
    )
    return metadata.exif_rows(images)


@query("dat01_capture_time", "SELECT event_id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS text, date_trunc('second', ts) AS at FROM events")
def _(spark, d):
    text = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    return table(spark, d, "events").select("event_id", text.alias("text"), F.to_timestamp(text, "yyyy:MM:dd HH:mm:ss").alias("at"))


def _be(a: str, n: int, little: bool) -> str:
    part = lambda k: f"('0x' || substr(h, {2 * (int(a) + k) + 1}, 2))::BIGINT"
    return " + ".join(f"{part(k)} * {256 ** (k if little else n - 1 - k)}" for k in range(n))


@query("arr03_byte_compose", f"WITH {hex_parts(8)} SELECT doc_id, p::INT AS i, {_be('0', 2, True)} AS le2, {_be('0', 2, False)} AS be2, {_be('1', 4, True)} AS le4, {_be('1', 4, False)} AS be4, {_be('0', 7, False)} AS be7 FROM d")
def _(spark, d):
    """Numbers in each eight bytes of a text, the last filled up with zeros."""
    u = metadata.unsigned

    def numbers(b):
        return F.struct(u(b, 0, 2, True).alias("le2"), u(b, 0, 2, False).alias("be2"), u(b, 1, 4, True).alias("le4"), u(b, 1, 4, False).alias("be4"), u(b, 0, 7, False).alias("be7"))

    parts = rasters.byte_rows(spark, d).select("doc_id", F.posexplode(F.transform(binary.parts(C("bytes"), 8), numbers)).alias("i", "n"))
    return parts.select("doc_id", "i", "n.*")


@query("arr04_slice_concat", "WITH t AS (SELECT *, list_concat(embedding[3:6], embedding[1:2]) AS t FROM embeddings) SELECT vec_id, len(t) AS n, t[1]::DOUBLE AS a, t[5]::DOUBLE AS b, embedding[64]::DOUBLE AS last FROM t")
def _(spark, d):
    e = C("embedding").cast("array<double>")
    t = F.concat(F.slice(e, 3, 4), F.slice(e, 1, 2))
    return table(spark, d, "embeddings").select("vec_id", F.size(t).cast("long").alias("n"), t[0].alias("a"), t[4].alias("b"), F.element_at(e, 64).alias("last"))


@query("map01_tag_map", f"WITH {TAGS}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id, tag ORDER BY preorder) AS k FROM tags) SELECT image_id, max(num) FILTER (WHERE tag = 2) AS t2, max(num) FILTER (WHERE tag = 9) AS t9 FROM n WHERE k = 1 GROUP BY 1")
def _(spark, d):
    w = Window.partitionBy("image_id", "tag").orderBy("preorder")
    first = rasters.tags(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1")
    m = first.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "num"))).alias("m"))
    return m.select("image_id", F.try_element_at("m", F.lit(2)).alias("t2"), F.try_element_at("m", F.lit(9)).alias("t9"))


@query("map02_orientation", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 10 IN (2, 3) THEN 2 WHEN event_id % 10 IN (5, 6) THEN 1 WHEN event_id % 10 IN (7, 8) THEN 3 ELSE 0 END ELSE CASE WHEN event_id % 9 IN (2, 3) THEN 2 WHEN event_id % 9 IN (4, 6) THEN 1 WHEN event_id % 9 IN (5, 7) THEN 3 ELSE 0 END END AS turns FROM events")
def _(spark, d):
    main = F.when(C("event_id") % 3 != 0, C("event_id") % 10)
    return table(spark, d, "events").select("event_id", metadata.rotation(main, C("event_id") % 9).alias("turns"))


@query("map03_coalesce", f"WITH {TAGS} SELECT image_id, coalesce(arg_min(num, preorder) FILTER (WHERE tag = 1), arg_min(num, preorder) FILTER (WHERE tag = 4), 0) AS iso, coalesce(arg_min(text, preorder) FILTER (WHERE tag = 6), 'none') AS make FROM tags GROUP BY 1")
def _(spark, d):
    first = lambda c, t: F.min_by(c, F.when(C("tag") == t, C("preorder")))
    t = rasters.tags(spark, d).groupBy("image_id")
    return t.agg(F.coalesce(first("num", 1), first("num", 4), F.lit(0.0)).alias("iso"), F.coalesce(first("text", 6), F.lit("none")).alias("make"))


@query("map05_wb_gains", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE (event_id % 5) / 4.0::DOUBLE END AS r, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE 1.0::DOUBLE END AS g, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE (event_id % 7) / 4.0::DOUBLE END AS b FROM events")
def _(spark, d):
    gains = metadata.normalised_gains(C("event_id") % 5, F.lit(4), C("event_id") % 7)
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in zip("rgb", gains, strict=True)])


@query("src01_dispatch", "SELECT doc_id, ['TIFF', 'NEF', 'DNG', 'bitmap', NULL][(doc_id % 5 + 1)::INT] AS decoder FROM documents")
def _(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("TIF", "Nef", "dng", "png", "txt")]), (C("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", metadata.decoder(F.concat(F.lit("a.b/img."), ext)).alias("decoder"))


@query("src02_magic", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'TIFF little' WHEN 1 THEN 'TIFF big' WHEN 2 THEN 'JPEG' ELSE CASE WHEN starts_with(text, 'BM') THEN 'BMP' ELSE 'unknown' END END AS kind FROM documents")
def _(spark, d):
    head = F.element_at(F.array(F.unhex(F.lit("49492A00")), F.unhex(F.lit("4D4D002A")), F.unhex(F.lit("FFD8FFE0")), F.unhex(F.lit(""))), (C("doc_id") % 4 + 1).cast("int"))
    return rasters.byte_rows(spark, d).select("doc_id", metadata.magic(F.concat(head, C("bytes"))).alias("kind"))


@query("src23_thumbnail", "SELECT doc_id, hex(encode(text))[2 * (doc_id % 20) + 1:2 * (doc_id % 20) + 60] AS bytes FROM documents")
def _(spark, d):
    return rasters.byte_rows(spark, d).select("doc_id", F.hex(F.substring(C("bytes"), (C("doc_id") % 20 + 1).cast("int"), F.lit(30))).alias("bytes"))


@query("snk04_ppm_text", "SELECT vec_id, array_to_string(list_transform(embedding, lambda e: (greatest(0, least(65535, floor((e::DOUBLE + 0.5) * 65536)))::INT >> 8)::VARCHAR), ' ') AS line FROM embeddings")
def _(spark, d):
    v = F.transform("embedding", lambda e: F.shiftright(F.greatest(F.lit(0), F.least(F.lit(65535), F.floor((e.cast("double") + 0.5) * 65536))).cast("int"), 8).cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(v, " ").alias("line"))
