"""SQL twins of the derived tables, as common table expressions for DuckDB."""

from __future__ import annotations

from prismlake.sources.rasters import HEIGHT, MAX, WIDTH

MOSAIC = f"""mosaic AS (
  SELECT vec_id // {HEIGHT} AS image_id, (vec_id % {HEIGHT})::INT AS y, (i - 1)::INT AS x,
         greatest(0, least({MAX}, floor((embedding[i]::DOUBLE + 0.5) * 65536)))::INT AS v
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, {WIDTH})) AS i FROM embeddings))"""

PIXELS = f"""{MOSAIC},
pixels AS (SELECT image_id, y, x, v AS r, (v * 3 + x * 101) & {MAX} AS g, (v * 5 + y * 57) & {MAX} AS b FROM mosaic)"""

SCATTER = f"""scatter AS (
  SELECT l_orderkey AS id, (floor(l_quantity * 1310)::BIGINT & {MAX})::INT AS r,
         (floor(l_extendedprice * 0.5::DOUBLE)::BIGINT & {MAX})::INT AS g, (floor(l_discount * 655350)::BIGINT & {MAX})::INT AS b
  FROM lineitem)"""

TAGS = """tags AS (
  SELECT user_id AS image_id, (event_id % 7)::INT AS ifd_id, CASE WHEN event_id % 7 > 0 THEN ((event_id % 7 - 1) // 2)::INT END AS parent_id,
         event_id AS preorder, (event_id % 11)::INT AS tag, value AS num, event_type AS text FROM events)"""

EDITS = "edits AS (SELECT user_id AS image_id, event_id AS seq, event_type AS effect, value FROM events)"


def grid(source: str, columns: list[str], radius: int, name: str = "grid") -> str:
    """Each column's neighbours as c_dy_dx (m for minus), null outside the image."""
    tag = lambda k: f"m{-k}" if k < 0 else str(k)
    shift = lambda c, k: c if k == 0 else f"{'lag' if k < 0 else 'lead'}({c}, {abs(k)})"
    steps = range(-radius, radius + 1)
    over = lambda e, w: f"{e} OVER {w}" if "(" in e else e
    row = ", ".join(f"{over(shift(c, k), 'w')} AS {c}__{tag(k)}" for c in columns for k in steps)
    col = ", ".join(f"{over(shift(f'{c}__{tag(k)}', j), 'w')} AS {c}_{tag(j)}_{tag(k)}" for c in columns for j in steps for k in steps)
    return f"""{name}_row AS (SELECT *, {row} FROM {source} WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
{name} AS (SELECT *, {col} FROM {name}_row WINDOW w AS (PARTITION BY image_id, x ORDER BY y))"""


def at(c: str, dy: int, dx: int, mirror: bool = False) -> str:
    tag = lambda k: f"m{-k}" if k < 0 else str(k)
    one = lambda a, b: f"{c}_{tag(a)}_{tag(b)}"
    if not mirror:
        return one(dy, dx)
    return "coalesce(" + ", ".join(dict.fromkeys([one(dy, dx), one(-dy, dx), one(dy, -dx), one(-dy, -dx)])) + ", 0)"


def hex_parts(size: int) -> str:
    """Each text's bytes as hex in parts of `size` bytes, the last filled up with zeros: doc_id, n (bytes), p (part), h."""
    padded = f"rpad(hex(encode(text)), (2 * {size} * ceil(octet_length(encode(text)) / {size}::DOUBLE))::INT, '0')"
    return f"l AS (SELECT doc_id, octet_length(encode(text)) AS n, regexp_extract_all({padded}, '.{{{2 * size}}}') AS l FROM documents), d AS (SELECT doc_id, n, unnest(generate_series(0, len(l) - 1)) AS p, unnest(l) AS h FROM l)"
