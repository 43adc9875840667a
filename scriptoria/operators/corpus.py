"""Sentences for training sets, and the sets' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.functions.profile import CYRILLIC, JAVA_SPACE, AlphabetProfile
from scriptoria.functions.text import strip


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{JAVA_SPACE}]+", " "))


def first_of_each(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """One row for each value of `by`, the first in order: an aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c != by and c not in order]
    first = df.groupBy(by).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first"))
    return first.select(by, *(F.col(f"_first.{c}") for c in [*order, *rest])).select(*df.columns)


def sentences(df: DataFrame, text: str, order: list[str], least: int = 12, profile: AlphabetProfile = CYRILLIC, limit: int | None = None) -> DataFrame:
    """order columns and text of the distinct sentences of `least` characters with a letter of the alphabet, the first of each."""
    clean = df.select(*order, collapsed(F.col(text)).alias("text")).where((F.char_length("text") >= least) & F.col("text").rlike(f"[{profile.letter_class}]"))
    kept = first_of_each(clean, "text", order)
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def numbered(df: DataFrame, order: list[str], out: str = "index") -> DataFrame:
    """Rows numbered from 0 in order without gathering them: sorted ranges, then an offset for each range.

    The ranges are drawn from a sample, so the ranged rows are persisted: both steps see the same ranges,
    and a lost block is made again from the same shuffle.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).persist()
    first = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_lo"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = first.select("_part", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + local).cast("long")).drop("_part", "_before")


def dataset(samples: DataFrame) -> DataFrame:
    """Samples (index, layout, w, h, lines array<struct<text, x0, y0, x1, y1>>, bubbles array<struct<x0..y1>>) as manifest rows.

    image, split, layout, transcript, labels (text first, then bubbles), recognition_rows (crop path, tab,
    text). Lines without area on the page go.
    """
    name = F.format_string("page_%06d", F.col("index"))
    w, h = F.col("w"), F.col("h")
    lines = F.filter("lines", lambda s: (G.clamp(s["x1"], w) > G.clamp(s["x0"], w)) & (G.clamp(s["y1"], h) > G.clamp(s["y0"], h)))
    label = lambda cls: lambda s: G.label_line(F.lit(cls), s["x0"], s["y0"], s["x1"], s["y1"], w, h)
    out = samples.withColumn("lines", lines).withColumn("split", G.split_of(F.col("index")))
    path = lambda i: F.concat(F.lit("recognition/"), F.col("split"), F.lit("/"), name, F.format_string("_line_%02d.png", i))
    return out.select(
        "index", F.concat(F.lit("images/"), F.col("split"), F.lit("/"), name, F.lit(".jpg")).alias("image"), "split", "layout",
        F.array_join(F.transform("lines", lambda s: s["text"]), "\n").alias("transcript"), "lines", "bubbles",
        F.filter(F.concat(F.transform("lines", label(0)), F.transform("bubbles", label(1))), lambda x: x != "").alias("labels"),
        F.transform("lines", lambda s, i: F.concat(path(i), F.lit("\t"), s["text"])).alias("recognition_rows"),
    )


def split_counts(manifest: DataFrame) -> DataFrame:
    """split, pages, line_crops of manifest rows; a page without lines counts as a page."""
    return manifest.groupBy("split").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce(F.size("recognition_rows"), F.lit(0)).cast("long")).alias("line_crops"))


def phrase_index(page: Column, place: Column, phrases: int) -> Column:
    return F.pmod(page * 3 + place, F.lit(phrases))
