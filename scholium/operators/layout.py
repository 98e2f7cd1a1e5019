"""Reading order of recognised boxes on a page of vertical text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A page is read in vertical columns if this share of its boxes is taller than wide.
VERTICAL_SHARE = 0.55


def columns(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The column of each box, from right to left: boxes with close centres, or overlapping ones nearly so, belong together.

    Boxes are swept by their centres, so only neighbours in that order are compared.
    """
    n = len(x1)
    if not n:
        return np.zeros(0, np.int64)
    width, centre = np.maximum(x2 - x1, 1.0), (x1 + x2) / 2
    span, middle = centre.max() - centre.min(), float(np.median(width))
    near, overlapping = max(middle * 0.80, span * 0.008, 12.0), max(middle * 0.90, span * 0.010, 16.0)
    order = np.argsort(centre, kind="stable")
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach = max(near, overlapping)
    for a in range(n):
        for b in range(a + 1, n):
            i, j = order[a], order[b]
            gap = centre[j] - centre[i]
            if gap > reach:
                break
            common = min(x2[i], x2[j]) - max(x1[i], x1[j])
            if gap <= near or (gap <= overlapping and common / min(width[i], width[j]) >= 0.25):
                root[find(j)] = find(i)
    own = np.array([find(i) for i in range(n)])
    middles = {r: np.median(centre[own == r]) for r in set(own.tolist())}
    rank = {r: k for k, r in enumerate(sorted(middles, key=lambda r: (-middles[r], r)))}
    return np.array([rank[r] for r in own])


def ordered(boxes: pd.DataFrame) -> pd.DataFrame:
    """Boxes of one page (``x1, y1, x2, y2``) with ``col`` and ``place``; text lying flat is read line by line."""
    tall = (boxes["y2"] - boxes["y1"]) > (boxes["x2"] - boxes["x1"])
    out = boxes.copy()
    if len(out) and tall.mean() >= VERTICAL_SHARE:
        out["col"] = columns(out["x1"].to_numpy(float), out["x2"].to_numpy(float))
        by = out.sort_values(["col", "y1", "x1"], kind="stable")
    else:
        out["col"] = 0
        by = out.sort_values(["y1", "x1"], kind="stable")
    out.loc[by.index, "place"] = np.arange(1, len(by) + 1)
    return out


def reading_order(boxes: DataFrame, page: str) -> DataFrame:
    """Adds ``col`` and ``place`` to the boxes of every page; a page's boxes are few, so a page is one group."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema)

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        out = ordered(rows)
        return out.astype({"col": "int32", "place": "int32"})

    return boxes.groupBy(page).applyInPandas(go, f"{schema}, col int, place int")
