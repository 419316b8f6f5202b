"""Suppression of contained and overlapping boxes, page by page. All functions keep other columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.functions.geometry import area, box, intersection


def drop_contained(boxes: DataFrame, page: str = "page", key: str = "box_id") -> DataFrame:
    """Boxes without area go, and those of which a strictly larger box of the same page covers 70 % or more (kept itself or not)."""
    big = boxes.select(F.col(page).alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    a, b = box(), box("_")
    covered = (F.col(page) == F.col("_p")) & (area(b) > area(a)) & (10 * intersection(a, b) >= 7 * area(a))
    return boxes.where(area(box()) > 0).join(big, covered, "left_anti")


def _greedy(x1, y1, x2, y2, order) -> np.ndarray:
    size = np.maximum(0, x2 - x1) * np.maximum(0, y2 - y1)
    c = np.stack([x1, y1, x2, y2, size]).astype(np.float64)
    kept, n = np.empty_like(c), 0  # the boxes kept so far, in the first n columns
    keep = np.zeros(len(x1), bool)
    for i in order.tolist():
        k, b = kept[:, :n], c[:, i]
        w = np.minimum(b[2], k[2]) - np.maximum(b[0], k[0])
        h = np.minimum(b[3], k[3]) - np.maximum(b[1], k[1])
        common = np.maximum(0, w) * np.maximum(0, h)
        union = b[4] + k[4] - common
        if not ((union > 0) & (2 * common >= union)).any():
            keep[i] = True
            kept[:, n] = b
            n += 1
    return keep


def greedy(boxes: DataFrame, page: str = "page", key: str = "box_id") -> DataFrame:
    """By falling score (ties by key), a box goes if it overlaps a box kept before by half of their union or more. A fold over one page, so Arrow batches of a page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf[key].to_numpy(), -pdf["score"].to_numpy()))
        c = [pdf[x].to_numpy() for x in ("x1", "y1", "x2", "y2")]
        return pdf[_greedy(*c, order)]

    return boxes.groupBy(page).applyInPandas(run, boxes.schema)


def suppress(boxes: DataFrame, page: str = "page", key: str = "box_id") -> DataFrame:
    return greedy(drop_contained(boxes, page, key), page, key)
