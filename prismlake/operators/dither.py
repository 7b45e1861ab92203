"""Look-up tables with dither."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def widened(table: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each entry its lowest output and the width of the step to its neighbours' middle."""
    t = np.asarray(table, np.int64)
    low, high = np.concatenate([t[:1], t[:-1]]), np.concatenate([t[1:], t[-1:]])
    step = np.maximum((high - low + 2) // 4, 0)
    return t - step, 4 * step


def dithered(df: DataFrame, table: Sequence[int], seed: int = 0x2545F) -> DataFrame:
    """Samples (image_id, y, x, v) through a table, spread over each entry's step.

    The noise is a chain through a row: 15700 times the low half plus the high half,
    from a seed of the row's number. So rows are independent and reruns agree; a
    row is walked in one task.
    """
    base, width = widened(table)

    def row(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        state, out = (seed + 0x9E3779B1 * (int(part["y"].iloc[0]) + 1)) & 0xFFFFFFFF, []
        for v in part["v"].clip(0, len(base) - 1):
            state = (15700 * (state & 0xFFFF) + (state >> 16)) & 0xFFFFFFFF
            out.append(min(65535, max(0, int(base[v] + ((int(width[v]) * (state & 2047) + 1024) >> 12)))))
        return part.assign(v=out)[["image_id", "y", "x", "v"]]

    return df.select("image_id", "y", "x", "v").groupBy("image_id", "y").applyInPandas(row, "image_id long, y int, x int, v int")
