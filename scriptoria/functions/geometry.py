"""Boxes, letterboxing and label lines as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, most: Column) -> Column:
    return F.greatest(F.lit(0), F.least(most, value))


def letterbox(w: Column, h: Column, size: int) -> Column:
    """struct(scale, w, h, dx, dy): the page scaled into a square and centred with whole offsets."""
    scale = F.least(F.lit(float(size)) / F.greatest(w, F.lit(1)), F.lit(float(size)) / F.greatest(h, F.lit(1)))
    inner_w, inner_h = (F.greatest(F.lit(1), F.rint(x * scale).cast("int")) for x in (w, h))
    return F.struct(scale.alias("scale"), inner_w.alias("w"), inner_h.alias("h"), F.floor((F.lit(size) - inner_w) / 2).cast("int").alias("dx"), F.floor((F.lit(size) - inner_h) / 2).cast("int").alias("dy"))


def unletterbox(p: Column, offset: Column, scale: Column, length: Column) -> Column:
    """A coordinate back on the page, clipped to it."""
    return F.greatest(F.lit(0.0), F.least((length - 1).cast("double"), (p - offset) / scale))


def centre_to_corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct((x - w / 2).alias("x0"), (y - h / 2).alias("y0"), (x + w / 2).alias("x1"), (y + h / 2).alias("y1"))


def iou(a: Column, b: Column) -> Column:
    """Of two boxes with x0, y0, x1, y1; 0 where either has no area."""
    w = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    both = w * h
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def padded(x0: Column, y0: Column, x1: Column, y1: Column, pad: int, w: Column, h: Column) -> Column:
    return F.struct(clamp(x0 - pad, w).alias("x0"), clamp(y0 - pad, h).alias("y0"), clamp(x1 + pad, w).alias("x1"), clamp(y1 + pad, h).alias("y1"))


def label_line(cls: Column, x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """`cls cx cy w h` in shares of the page with 6 decimals; empty for a box without area on the page."""
    x0, x1, y0, y1 = clamp(x0, w), clamp(x1, w), clamp(y0, h), clamp(y1, h)
    # half to even at the sixth decimal, as C and Python print; Java's formatter would round half up
    even = lambda c: F.rint(c * 1e6) / 1e6
    line = F.format_string("%d %.6f %.6f %.6f %.6f", cls, even((x0 + x1) / 2 / w), even((y0 + y1) / 2 / h), even((x1 - x0) / w), even((y1 - y0) / h))
    return F.when((x1 <= x0) | (y1 <= y0), F.lit("")).otherwise(line)


def quad_size(quad: Column) -> Column:
    """struct(w, h) of a quadrilateral's longer edges, at least 4 each; points have x and y."""
    edge = lambda i, j: F.hypot(quad[i]["x"] - quad[j]["x"], quad[i]["y"] - quad[j]["y"])
    size = lambda a, b: F.greatest(F.lit(4), F.floor(F.greatest(a, b)).cast("int"))
    return F.struct(size(edge(0, 1), edge(2, 3)).alias("w"), size(edge(0, 3), edge(1, 2)).alias("h"))


def is_bubble(x: Column, y: Column, w: Column, h: Column, area: Column, page_w: Column, page_h: Column) -> Column:
    """A large, filled, wide region clear of the page's borders."""
    shape = w / F.greatest(h, F.lit(1))
    return (
        (area >= 15000) & (w >= 100) & (h >= 60) & (x > 10) & (y > 10) & (x + w < page_w - 10) & (y + h < page_h - 10)
        & shape.between(1.15, 5.5) & (area / F.greatest(F.lit(1.0), (w * h).cast("double")) >= 0.60)
    )


def split_of(index: Column) -> Column:
    return F.when(F.pmod(index, F.lit(5)) == 0, "val").otherwise("train")


def python_round(value: Column, digits: int) -> Column:
    """Rounding as Python's round: half to even on the exact binary value, which no JVM function does.

    Whole batches at once; only values next to a tie take Python's own rounding.
    """

    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        scale = 10.0**digits
        v = x.to_numpy(dtype=float, na_value=np.nan)
        scaled = v * scale
        out = np.round(scaled) / scale
        odd = ~np.isfinite(scaled) | (np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-6) | (np.abs(scaled) > 2.0**50)
        for k in np.flatnonzero(odd & np.isfinite(v)).tolist():
            out[k] = round(float(v[k]), digits)
        out[~np.isfinite(v)] = v[~np.isfinite(v)]
        return pd.Series(out).where(x.notna().to_numpy(), None)

    return rounded(value.cast("double"))
