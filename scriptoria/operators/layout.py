"""Order, grouping, splitting and suppression of boxes on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.geometry import iou


def reading_order(boxes: DataFrame, page: str, y: str, x: str, tie: str, out: str = "ord") -> DataFrame:
    """Boxes numbered from 1 down each page, then from the left; equal places by `tie`."""
    return boxes.withColumn(out, F.row_number().over(Window.partitionBy(page).orderBy(y, x, tie)))


def suppressed(boxes: DataFrame, page: str, score: str, tie: str, threshold: float = 0.45, least: float = 0.25, per_class: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """page, ord and the box of the boxes that greedy non-maximum suppression keeps, in its order, with the columns of `carry`.

    Boxes have x0, y0, x1, y1; classes are ignored unless `per_class` names their column. One aggregate
    gathers the boxes of a page, and a fold inside the row keeps a box if none kept overlaps it by more
    than the threshold.
    """
    keys = [page] if per_class is None else [page, per_class]
    fields = ["x0", "y0", "x1", "y1", *(c for c in (tie, *carry) if c not in ("x0", "y0", "x1", "y1"))]
    item = F.struct((-F.col(score)).alias("rank"), F.col(tie).alias("_tie"), *fields)
    grouped = boxes.where((F.col(score) >= least) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.filter("items", lambda _: F.lit(False))
    kept = F.aggregate("items", none, lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > threshold), acc).otherwise(F.concat(acc, F.array(b))))
    out = grouped.select(*keys, F.posexplode(kept).alias("place", "b"))
    return out.select(*keys, (F.col("place") + 1).alias("ord"), (-F.col("b.rank")).alias(score), *(F.col(f"b.{c}") for c in fields))


def rows_of(items: DataFrame, page: str, cy: str, h: str, x: str, seq: str) -> DataFrame:
    """page, row, ord, seq: boxes in rows of text, rows from the top and boxes from the left.

    In the order of `seq` a box joins the first row whose mean centre is within 0.6 of the larger of its
    height and the row's mean height, else it opens one. Rows compare with means that grow, so this is a
    fold over the page's boxes, inside the row. Equal rows and places keep their first order.
    """
    item = F.struct(F.col(seq).cast("long").alias("seq"), F.col(cy).cast("double").alias("cy"), F.col(h).cast("double").alias("h"), F.col(x).cast("double").alias("x"))
    grouped = items.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.array().cast("array<struct<cy:double,h:double,n:int,top:double,members:array<struct<x:double,seq:bigint>>>>")

    def step(rows, b):
        near = F.transform(rows, lambda r: F.abs(b["cy"] - r["cy"] / r["n"]) <= F.greatest(b["h"], r["h"] / r["n"]) * 0.60)
        hit = F.array_position(near, F.lit(True))
        me = F.struct(b["x"].alias("x"), b["seq"].alias("seq"))

        def joined(r, i):
            grown = F.struct((r["cy"] + b["cy"]).alias("cy"), (r["h"] + b["h"]).alias("h"), (r["n"] + 1).alias("n"), F.least(r["top"], b["cy"]).alias("top"), F.concat(r["members"], F.array(me)).alias("members"))
            return F.when(i + 1 == hit, grown).otherwise(r)

        new = F.struct(b["cy"].alias("cy"), b["h"].alias("h"), F.lit(1).alias("n"), b["cy"].alias("top"), F.array(me).alias("members"))
        return F.when(hit > 0, F.transform(rows, joined)).otherwise(F.concat(rows, F.array(new)))

    folded = grouped.select(page, F.aggregate("items", none, step).alias("rows"))
    ordered = F.array_sort(F.transform("rows", lambda r, i: F.struct(r["top"].alias("top"), i.alias("i"), r["members"].alias("members"))))
    out = folded.select(page, F.posexplode(ordered).alias("row", "r")).select(page, (F.col("row") + 1).alias("row"), F.posexplode(F.array_sort("r.members")).alias("ord", "m"))
    return out.select(page, "row", (F.col("ord") + 1).alias("ord"), F.col("m.seq").alias("seq"))


def runs(columns: DataFrame, crop: str, x: str) -> DataFrame:
    """crop, run, left, right, gap: maximal runs of consecutive x, and the empty columns before the next run."""
    islands = columns.select(crop, F.col(x).alias("x")).distinct().withColumn("x", F.col("x").cast("long")).withColumn("island", F.col("x") - F.row_number().over(Window.partitionBy(crop).orderBy("x")))
    spans = islands.groupBy(crop, "island").agg(F.min("x").alias("left"), F.max("x").alias("right"))
    by_left = Window.partitionBy(crop).orderBy("left")
    return spans.select(crop, F.row_number().over(by_left).alias("run"), "left", "right", (F.lead("left").over(by_left) - F.col("right") - 1).alias("gap"))


def word_spans(columns: DataFrame, crop: str, x: str, width: str | None = None, least_gap: int = 5, factor: float = 1.7, pad_left: int = 4, pad_right: int = 5, least_width: int = 32) -> DataFrame:
    """crop, piece, left, right (exclusive): words cut at gaps of max(least_gap, factor * median gap) or more.

    `columns` has a row for each inked x, and the crop's width in `width`; a crop narrower than
    least_width, or without a cut, stays whole. Without `width` the spans are inked, unpadded columns with
    an inclusive right end.
    """
    found = runs(columns, crop, x)
    limits = found.groupBy(crop).agg(F.greatest(F.lit(float(least_gap)), F.rint(F.coalesce(F.expr("median(CASE WHEN gap > 0 THEN gap END)"), F.lit(1.0)) * factor)).alias("limit"))
    by_run = Window.partitionBy(crop).orderBy("run")
    cut = F.coalesce((F.lag("gap").over(by_run) >= F.col("limit")).cast("int"), F.lit(0))
    pieces = found.join(limits, crop).withColumn("cut", cut).withColumn("piece", F.sum("cut").over(by_run.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    spans = pieces.groupBy(crop, "piece").agg(F.min("left").alias("left"), F.max("right").alias("right"))
    if width is None:
        return spans
    sizes = columns.groupBy(crop).agg(F.max(width).cast("long").alias("w"))
    cuts = spans.groupBy(crop).agg(F.max("piece").alias("pieces"))
    whole = sizes.join(cuts, crop).withColumn("whole", (F.col("w") < least_width) | (F.col("pieces") == 1))
    spread = spans.join(whole, crop).where(~F.col("whole") | (F.col("piece") == 1))
    return spread.select(
        crop, "piece",
        F.when(F.col("whole"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("left") - pad_left)).cast("long").alias("left"),
        F.when(F.col("whole"), F.col("w")).otherwise(F.least("w", F.col("right") + pad_right)).cast("long").alias("right"),
    )


def inside(text: DataFrame, bubbles: DataFrame, page: str, size: int = 256) -> DataFrame:
    """Texts (x, y) with the id of each bubble (bubble_id, x0, y0, x1, y1; right and lower ends exclusive) that holds them.

    An equi-join on page and grid cell, then the exact test: no pairs beyond those of a cell.
    """
    cell = lambda c: F.floor(c / size).cast("long")
    spread = bubbles.withColumn("_cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1") - 1)))).withColumn("_cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1") - 1))))
    placed = text.withColumns({"_cx": cell(F.col("x")), "_cy": cell(F.col("y"))})
    hit = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return placed.join(spread, [page, "_cx", "_cy"]).where(hit).drop("_cx", "_cy")


def joined_text(df: DataFrame, by: list[str], order: list[str], text: str, glue: str, out: str = "text") -> DataFrame:
    """Non-empty texts of a group in order, with `glue` between them."""
    listed = F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct(*order, F.col(text).alias("_t")))))
    return df.groupBy(*by).agg(F.array_join(F.transform(listed, lambda s: s["_t"]), glue).alias(out))


def page_summary(confidence: Column, certain: Column, passes: Column) -> list[Column]:
    """Aggregates of a page's lines: least confidence (0 without lines), all certain and not empty, most passes."""
    return [
        F.coalesce(F.min(confidence), F.lit(0.0)).alias("confidence"),
        (F.coalesce(F.bool_and(certain), F.lit(False)) & (F.count(confidence) > 0)).alias("certain"),
        F.coalesce(F.max(passes), F.lit(0)).alias("passes"),
    ]
