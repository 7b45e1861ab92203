"""Edit logs: undo, redo, first difference."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cursor(log: DataFrame, undo: str, redo: str, truncate: bool = False) -> DataFrame:
    """(image_id, seq, effect, position): where undo and redo leave the cursor after each event.

    An edit is inserted after the cursor, which moves on to it; undo moves back by
    one and redo on by one; the cursor stays between -1 and the last edit. With
    truncate a new edit forgets what was undone. An image's log is what one user
    did by hand, and is walked in one task.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        at, size, out = -1, 0, []
        for e in rows["effect"]:
            if e == undo:
                at = max(at - 1, -1)
            elif e == redo:
                at = min(at + 1, size - 1)
            else:
                at += 1
                size = at + 1 if truncate else size + 1
            out.append(at)
        return pd.DataFrame({"image_id": rows["image_id"], "seq": rows["seq"], "effect": rows["effect"], "position": out})

    return log.select("image_id", "seq", "effect").groupBy("image_id").applyInPandas(walk, "image_id long, seq long, effect string, position int")


def folded(log: DataFrame, undo: str, redo: str) -> DataFrame:
    """(image_id, position, size) after the whole log: one fold an image."""
    w = F.sort_array(F.collect_list(F.struct("seq", "effect")))
    step = (
        f"CASE WHEN e.effect = '{undo}' THEN named_struct('at', greatest(s.at - 1, -1), 'size', s.size)"
        f" WHEN e.effect = '{redo}' THEN named_struct('at', least(s.at + 1, s.size - 1), 'size', s.size)"
        f" ELSE named_struct('at', s.at + 1, 'size', s.size + 1) END"
    )
    out = log.groupBy("image_id").agg(w.alias("_log"))
    out = out.withColumn("_s", F.expr(f"aggregate(_log, named_struct('at', -1, 'size', 0), (s, e) -> {step})"))
    return out.select("image_id", F.col("_s.at").alias("position"), F.col("_s.size").alias("size"))


def first_difference(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(image_id, seq, target, old, new): the first parameter, in a fixed order, that differs from the state before."""
    w = Window.partitionBy("image_id").orderBy("seq")
    before = states.select("*", *[F.lag(c).over(w).alias(f"_{c}") for c in columns], F.row_number().over(w).alias("_n"))
    changed = {c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns}

    def pick(value) -> F.Column:
        return F.coalesce(*[F.when(changed[c], value(c)) for c in columns])

    rows = before.where("_n > 1")
    return rows.select("image_id", "seq", pick(lambda c: F.lit(c)).alias("target"), pick(lambda c: F.col(f"_{c}").cast("double")).alias("old"), pick(lambda c: F.col(c).cast("double")).alias("new"))


def edit_text(effect, old, new):
    return F.concat(effect, F.lit(" from "), old, F.lit(" to "), new)
