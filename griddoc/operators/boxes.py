"""Boxes on drawings: overlap, suppression of doubles, tiles. A box is x, y, w, h."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Overlap above which the less certain of two boxes is dropped; edge of a tile and its overlap with the next.
OVERLAP, TILE, SHARED = 0.4, 1400, 250


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes with prefixes a and b; 0 for boxes without area."""
    g = lambda p, c: F.col(f"{p}{c}")
    w = F.greatest(F.least(g(a, "x") + g(a, "w"), g(b, "x") + g(b, "w")) - F.greatest(g(a, "x"), g(b, "x")), F.lit(0.0))
    h = F.greatest(F.least(g(a, "y") + g(a, "h"), g(b, "y") + g(b, "h")) - F.greatest(g(a, "y"), g(b, "y")), F.lit(0.0))
    union = g(a, "w") * g(a, "h") + g(b, "w") * g(b, "h") - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def suppress(boxes: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Greedy suppression within each image and type: from the most certain box down, a box stays unless it overlaps a kept one.

    boxes: image_id, type, box_id, x, y, w, h, confidence; equally certain ones in the order of box_id. The rule depends on
    the order, so Spark sorts the rows within partitions and one pass keeps only the boxes kept so far of the present group,
    in arrays with which a box is compared at once.
    """
    cols = ["image_id", "type", "box_id", "x", "y", "w", "h", "confidence"]
    ordered = boxes.select(*cols).repartition("image_id", "type").sortWithinPartitions("image_id", "type", F.col("confidence").desc(), "box_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, kept, n = None, np.empty((5, 64)), 0
        for batch in batches:
            stays = np.ones(len(batch), bool)
            x, y, w, h = (batch[c].to_numpy(float) for c in ("x", "y", "w", "h"))
            sides = np.stack((x, y, x + w, y + h, w * h))
            for k, key in enumerate(zip(batch["image_id"].tolist(), batch["type"].tolist())):
                if key != group:
                    group, n = key, 0
                a, b = sides[:, k, None], kept[:, :n]
                iw, ih = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
                shared = iw * ih
                if ((iw > 0) & (ih > 0) & (shared > overlap * (a[4] + b[4] - shared))).any():
                    stays[k] = False
                    continue
                if n == kept.shape[1]:
                    kept = np.concatenate((kept, np.empty_like(kept)), 1)
                kept[:, n] = sides[:, k]
                n += 1
            yield batch[stays]

    return ordered.mapInPandas(run, ordered.schema)


def tiles(images: DataFrame, tile: int = TILE, shared: int = SHARED) -> DataFrame:
    """(image_id, x, y, w, h): overlapping tiles over each image (image_id, width, height)."""
    step = tile - shared
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n) - shared - 1, F.lit(0)), F.lit(step))
    xs = images.select("*", F.explode(starts("width")).alias("x"))
    both = xs.select("*", F.explode(starts("height")).alias("y"))
    return both.select("image_id", "x", "y", F.least(F.lit(tile), F.col("width") - F.col("x")).alias("w"), F.least(F.lit(tile), F.col("height") - F.col("y")).alias("h"))


def shifted(boxes: DataFrame, dx: str, dy: str) -> DataFrame:
    """Boxes found on a tile, in the coordinates of the image."""
    return boxes.withColumns({"x": F.col("x") + F.col(dx), "y": F.col("y") + F.col(dy)})
