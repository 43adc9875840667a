"""From page images to text: plug-in inference inside, DataFrame operators around it.

A detector maps an image to boxes [(x0, y0, x1, y1)]; a recognizer maps a crop to (raw text, confidence).
Both are made once in each Python worker by a factory that is shipped with the job. Nothing is bundled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import kernels as K
from scriptoria.functions import text as T
from scriptoria.functions.geometry import python_round
from scriptoria.functions.profile import CYRILLIC, AlphabetProfile
from scriptoria.operators import layout, vote
from scriptoria.session import stored

Box = tuple[int, int, int, int]


class Detector(Protocol):
    def __call__(self, image: np.ndarray) -> list[Box]: ...


class Recognizer(Protocol):
    def __call__(self, crop: np.ndarray) -> tuple[str, float]: ...


#: A word crop: its text box, and the columns of the box's crop that hold the word.
CROP = ("page", "box", "piece", "x0", "y0", "x1", "y1", "left", "right")
READINGS = "page long, box long, piece long, x0 int, y0 int, x1 int, y1 int, left int, right int, variant string, seq int, extended boolean, raw string, confidence double"
IMAGE = ("page", "data", "height", "width", "channels")
#: Bubbles that a page needs for its bubble reading to count, and the most that a page can have.
LEAST_BUBBLES, MOST_BUBBLES = 3, 1 << 16


def to_image(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a


def _versions(part: np.ndarray, extended: bool) -> list[tuple[int, str, np.ndarray]]:
    """The versions of a crop of one kind, with their places among all."""
    every = list(enumerate(K.variants(part, extended)))
    return [(s, name, version) for s, (name, version) in every if (name in vote.EXTENDED_VARIANTS) == extended]


def readings(pages: DataFrame, make_detector: Callable[[], Detector], make_recognizer: Callable[[], Recognizer]) -> DataFrame:
    """The base readings of each word crop; `pages` has page, data, height, width, channels (BGR bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect, read = make_detector(), make_recognizer()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                image = to_image(row.data, row.height, row.width, row.channels)
                out = []
                for b, (x0, y0, x1, y1) in enumerate(detect(image)):
                    part = K.crop(image, x0, y0, x1, y1)
                    for p, (left, right) in enumerate(K.word_pieces(part)):
                        for s, name, version in _versions(part[:, left:right], False):
                            raw, confidence = read(version)
                            out.append((row.page, b, p, x0, y0, x1, y1, left, right, name, s, False, raw, float(confidence)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in READINGS.split(", ")])

    return pages.select(*IMAGE).mapInPandas(run, READINGS)


def readings_of(pages: DataFrame, crops: DataFrame, make_recognizer: Callable[[], Recognizer], base: bool, extended: bool) -> DataFrame:
    """The base or extended readings of given crops (the columns of CROP), those of a page in one row."""
    listed = crops.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(*CROP[1:]))).alias("crops"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make_recognizer()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                image = to_image(row.data, row.height, row.width, row.channels)
                out = []
                for c in row.crops:
                    place = [c[k] for k in CROP[1:]]
                    part = K.crop(image, *place[2:6])[:, place[6] : place[7]]
                    for kind in [k for k, wanted in ((False, base), (True, extended)) if wanted]:
                        for s, name, version in _versions(part, kind):
                            raw, confidence = read(version)
                            out.append((row.page, *place, name, s, kind, raw, float(confidence)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in READINGS.split(", ")])

    return pages.select(*IMAGE).join(listed, "page").mapInPandas(run, READINGS)


def _voted(found: DataFrame, target: float, passes: int, profile: AlphabetProfile) -> DataFrame:
    keyed = found.withColumn("key", T.normalize(F.col("raw"), profile)).withColumn("crop", F.struct(*CROP))
    return vote.bounded(keyed, "crop", passes=passes, target=target).withColumn("confidence", python_round(F.col("confidence"), 4))


def lines(
    pages: DataFrame, make_detector: Callable[[], Detector], make_recognizer: Callable[[], Recognizer], target: float = 0.90, passes: int = 4, profile: AlphabetProfile = CYRILLIC,
    make_second: Callable[[], Recognizer] | None = None,
) -> DataFrame:
    """The columns of CROP, text, confidence, certain, passes of every crop that is not noise.

    Base readings are made once and stored; extended ones only of crops that the first pass leaves uncertain,
    as the others' votes end there. A second recognizer reads the crops whose result is not certain at the target.
    """
    first = stored(readings(pages, make_detector, make_recognizer))
    if passes > 1:
        keyed = first.withColumn("key", T.normalize(F.col("raw"), profile)).withColumn("crop", F.struct(*CROP))
        unsure = vote.consensus(keyed, "crop", target=target).where(~F.col("certain")).select("crop.*")
        first = first.unionByName(stored(readings_of(pages, unsure, make_recognizer, False, True)))
    voted = _voted(first, target, passes, profile)
    if make_second is not None:
        voted = stored(voted)
        unstable = voted.where(~(F.col("certain") & (F.col("confidence") >= target))).select("crop.*")
        second = _voted(stored(readings_of(pages, unstable, make_second, True, passes > 1)), target, passes, profile)
        voted = vote.ensemble(voted, second, "crop", lambda c: T.normalize(c, profile), target).withColumn("confidence", python_round(F.col("confidence"), 4))
    out = voted.select("crop.*", "text", "confidence", "certain", "passes")
    return out.where(vote.not_noise(F.col("text"), F.col("confidence")))


def _placed(found: DataFrame) -> DataFrame:
    """The columns of `lines` with row and ord: rows from the top, words from the left."""
    order = found.select("*", (F.col("box") * 10_000 + F.col("piece")).alias("seq"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("y1") - F.col("y0")).alias("h"))
    return layout.rows_of(order, "page", "cy", "h", "x0", "seq").join(order, ["page", "seq"])


def line_rows(found: DataFrame) -> DataFrame:
    """page, row, confidence, certain, passes: the rows of text of each page from `lines`."""
    return _placed(found).groupBy("page", "row").agg(*layout.page_summary(F.col("confidence"), F.col("certain"), F.col("passes")))


def page_text(found: DataFrame, profile: AlphabetProfile = CYRILLIC) -> DataFrame:
    """page, text, confidence, certain, passes from `lines`: rows from the top, words from the left."""
    placed = _placed(found).select("page", "row", "ord", "text")
    rows = layout.joined_text(placed, ["page", "row"], ["ord"], "text", " ").withColumn("text", T.normalize(F.col("text"), profile))
    text = layout.joined_text(rows, ["page"], ["row"], "text", "\n")
    summary = found.groupBy("page").agg(*layout.page_summary(F.col("confidence"), F.col("certain"), F.col("passes")))
    return text.join(summary, "page")


def recognize(
    pages: DataFrame, make_detector: Callable[[], Detector], make_recognizer: Callable[[], Recognizer], target: float = 0.90, passes: int = 4, profile: AlphabetProfile = CYRILLIC,
    make_second: Callable[[], Recognizer] | None = None, bubble_mode: bool = False, make_bubble_detector: Callable[[], Detector] | None = None,
) -> DataFrame:
    """page, text, confidence, certain, passes of every page; a page without lines has empty text and is not certain.

    In bubble mode a page with LEAST_BUBBLES bubbles or more is read bubble by bubble as well, with the bubble detector
    if there is one, and the better of its two results stays; `source` names it.
    """
    found = page_text(stored(lines(pages, make_detector, make_recognizer, target, passes, profile, make_second)), profile)
    joined = pages.select("page").join(found, "page", "left")
    normal = joined.select("page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("certain", F.lit(False)).alias("certain"), F.coalesce("passes", F.lit(0)).alias("passes"))
    if not bubble_mode:
        return normal
    parts = recognize(bubble_pages(pages), make_bubble_detector or make_detector, make_recognizer, target, passes, profile, make_second)
    parts = parts.withColumn("ord", F.col("page") % MOST_BUBBLES).withColumn("page", F.floor(F.col("page") / MOST_BUBBLES).cast("long"))
    texts = layout.joined_text(parts, ["page"], ["ord"], "text", "\n").withColumn("text", T.normalize(F.col("text"), profile))
    summary = parts.groupBy("page").agg(*layout.page_summary(F.col("confidence"), F.col("certain"), F.col("passes")))
    return vote.choose(normal, texts.join(summary, "page").select(*normal.columns), "page")


def bubble_pages(pages: DataFrame) -> DataFrame:
    """The bubbles of pages that have enough of them as pages of their own, numbered page * MOST_BUBBLES + place."""
    found = bubbles(pages).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("boxes")).where(F.size("boxes") >= LEAST_BUBBLES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                image = to_image(row.data, row.height, row.width, row.channels)
                cut = [(row.page * MOST_BUBBLES + b["ord"], np.ascontiguousarray(image[b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]]).tobytes(), b["h"], b["w"], row.channels) for b in row.boxes]
                yield pd.DataFrame(cut, columns=list(IMAGE))

    return stored(pages.select(*IMAGE).join(found, "page").mapInPandas(run, "page long, data binary, height int, width int, channels int"))


def bubbles(pages: DataFrame) -> DataFrame:
    """page, x, y, w, h of the speech bubbles of each page, numbered down and then from the left."""
    from scriptoria.functions.geometry import is_bubble

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = K.regions(to_image(row.data, row.height, row.width, row.channels))
                yield pd.DataFrame([(row.page, row.width, row.height, *r) for r in found], columns=["page", "pw", "ph", "x", "y", "w", "h", "area"])

    c = F.col
    boxes = pages.select("page", "data", "height", "width", "channels").mapInPandas(run, "page long, pw int, ph int, x int, y int, w int, h int, area int")
    kept = boxes.where(is_bubble(c("x"), c("y"), c("w"), c("h"), c("area"), c("pw"), c("ph")))
    return layout.reading_order(kept, "page", "y", "x", "w").select("page", "ord", "x", "y", "w", "h")
