"""Detector output to boxes on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.geometry import centre_to_corners, letterbox, unletterbox
from scriptoria.operators import layout

#: The most rows of an output whose boxes are already suppressed, and the classes of text and bubbles.
MOST_SUPPRESSED, TEXT, BUBBLE = 100, 0, 1


def best_class(scores: Column) -> Column:
    """struct(score, cls) of the greatest of an array of class scores, the first of equal ones."""
    best = F.array_max(scores)
    return F.struct(best.cast("double").alias("score"), (F.array_position(scores, best) - 1).cast("int").alias("cls"))


def decoded(rows: DataFrame, pages: DataFrame, page: str = "page", seq: str = "seq", values: str = "v", size: int = 640) -> DataFrame:
    """page, seq, cls, score, x0, y0, x1, y1 (whole pixels) of each output row (page, seq, v).

    An output of more than MOST_SUPPRESSED rows holds centres, sizes and class scores; a shorter one corners, score
    and class. Coordinates go from the letterboxed square back to the page (page, width, height). Rows that are null
    or shorter than six numbers count to the output but give no box, nor do boxes without area on the page. The count
    is a window on the page, so that counting and suppressing share one shuffle.
    """
    counted = rows.select(page, F.col(seq).alias("seq"), F.col(values).alias("v"), (F.count(F.lit(1)).over(Window.partitionBy(page)) > MOST_SUPPRESSED).alias("raw"))
    sized = pages.select(page, "width", "height", letterbox(F.col("width"), F.col("height"), size).alias("fit"))
    n = [F.col("v")[k].cast("double") for k in range(6)]
    corners = F.struct(*(c.alias(name) for c, name in zip(n, ("x0", "y0", "x1", "y1"), strict=False)))
    scores = F.slice("v", 5, F.greatest(F.size("v") - 4, F.lit(1)))
    listed = F.struct(n[4].alias("score"), n[5].cast("int").alias("cls"))
    read = counted.where(F.size("v") >= 6).join(sized, page).select(
        page, "seq", "width", "height", "fit",
        F.when(F.col("raw"), centre_to_corners(*n[:4])).otherwise(corners).alias("b"),
        F.when(F.col("raw"), best_class(scores)).otherwise(listed).alias("s"),
    )

    def back(name: str, offset: str, length: str) -> Column:
        return unletterbox(F.col(f"b.{name}"), F.col(f"fit.{offset}"), F.col("fit.scale"), F.col(length)).cast("int").alias(name)

    placed = [back("x0", "dx", "width"), back("y0", "dy", "height"), back("x1", "dx", "width"), back("y1", "dy", "height")]
    return read.select(page, "seq", F.col("s.cls").alias("cls"), F.col("s.score").alias("score"), *placed).where("x1 > x0 AND y1 > y0")


def detections(rows: DataFrame, pages: DataFrame, page: str = "page", least: float = 0.25, threshold: float = 0.45, size: int = 640, only: int | None = None) -> DataFrame:
    """page, ord, cls, score, x0, y0, x1, y1 of the boxes above `least` that suppression keeps, in its order.

    Classes suppress each other; `only` then keeps one class.
    """
    boxes = decoded(rows, pages, page, size=size).where(F.col("score") > least)
    kept = layout.suppressed(boxes, page, "score", "seq", threshold, least, carry=("cls",))
    out = kept.select(page, "ord", "cls", "score", "x0", "y0", "x1", "y1")
    return out if only is None else out.where(F.col("cls") == only)


def with_fallback(first: DataFrame, second: DataFrame, page: str = "page") -> DataFrame:
    """The first detector's boxes, and the second's on pages where the first found none."""
    return first.unionByName(second.join(first.select(page).distinct(), page, "left_anti"))
