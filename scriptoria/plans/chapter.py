"""Whole jobs over folders of images: read one, scan a chapter, compare engines, score a chapter.

Detectors and recognizers are factories as in `pages`; an engine is a factory of a function from an image to its text,
or to (text, confidence).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators import evaluate
from scriptoria.plans.pages import IMAGE, Detector, Recognizer, recognize, to_image
from scriptoria.session import stored
from scriptoria.sources import readers, writers

Engine = Callable[[np.ndarray], "str | tuple[str, float]"]
ENGINE_ROWS = "engine string, page long, file string, text string, confidence double, latency_sec double, error string"


def cut_rows(pages: DataFrame, top: int = 0, bottom: int = 0) -> DataFrame:
    """Pages with the rows of pixels from top to bottom only (0: all); pages without data are left out.

    Rows lie one after the other in the data, so this is a substring. No row is left where bottom is not below top.
    """
    kept = readers.cropped_rows(F.col("height"), top, bottom)
    width = F.col("width") * F.col("channels")
    rows = F.greatest(F.lit(0), F.col("_kept.bottom") - F.col("_kept.top"))
    there = pages.where(F.col("data").isNotNull() & (F.col("height") > 0)).withColumn("_kept", kept)
    return there.withColumns({"data": F.substring("data", F.col("_kept.top") * width + 1, rows * width), "height": rows.cast("int")}).drop("_kept").where("height > 0")


def scan(pages: DataFrame, make_detector: Callable[[], Detector], make_recognizer: Callable[[], Recognizer], top: int = 0, bottom: int = 0, **options) -> DataFrame:
    """page, source (file name), text, confidence, certain, passes, mode of numbered images (page, name and those of IMAGE).

    Unreadable images keep their number and have no row. Pages with bubbles are read in bubble mode unless told otherwise.
    """
    cut = cut_rows(pages, top, bottom)
    read = recognize(cut.select(*IMAGE), make_detector, make_recognizer, **{"bubble_mode": True, **options})
    mode = F.col("source") if "source" in read.columns else F.lit("normal")
    found = read.select("page", "text", "confidence", "certain", "passes", mode.alias("mode"))
    return cut.select("page", F.col("name").alias("source")).join(found, "page")


def write_chapter(found: DataFrame, path: str) -> None:
    """The report, a text a page and the chapter's text, from one evaluation of the scan."""
    kept = stored(found)
    writers.report(kept, f"{path}/report")
    writers.page_texts(kept, f"{path}/pages")
    writers.chapter(kept.select("page", F.col("source").alias("name"), "text"), f"{path}/chapter")


def engine_rows(pages: DataFrame, engines: dict[str, Callable[[], Engine]]) -> DataFrame:
    """A row of ENGINE_ROWS for each engine and page; an engine that fails leaves its error and an empty text.

    Every image is read once for all engines; unreadable ones count as failed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = []
                for name, make in engines.items():
                    began, text, confidence, error = time.perf_counter(), "", None, None
                    try:
                        if name not in made:
                            made[name] = make()
                        if row.data is None:
                            raise ValueError("image could not be loaded")
                        got = made[name](to_image(row.data, int(row.height), int(row.width), int(row.channels)))
                        text, confidence = got if isinstance(got, tuple) else (str(got), None)
                    except Exception as e:  # the report has one row for every engine and page, failed or not
                        text, confidence, error = "", None, repr(e)
                    out.append((name, row.page, row.name, text, confidence, round(time.perf_counter() - began, 3), error))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ENGINE_ROWS.split(", ")]).astype({"confidence": float})

    return pages.select("page", "name", "data", "height", "width", "channels").mapInPandas(run, ENGINE_ROWS).withColumn("confidence", F.nanvl("confidence", F.lit(None).cast("double")))


def own_rows(found: DataFrame, name: str = "ours") -> DataFrame:
    """The page plan's own result as ENGINE_ROWS: it runs as one job, so each page is charged the job's mean."""
    began = time.perf_counter()
    kept = stored(found)
    each = round((time.perf_counter() - began) / max(1, kept.count()), 3)
    return kept.select(F.lit(name).alias("engine"), F.col("page").cast("long").alias("page"), F.col("source").alias("file"), "text", "confidence", F.lit(each).alias("latency_sec"), F.lit(None).cast("string").alias("error"))


def compare(rows: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored rows and the report of engines; pages without truth have no rate."""
    scored = evaluate.scored(rows, evaluate.truth_of(manifest))
    return scored, evaluate.engine_report(scored)


def score_chapter(spark: SparkSession, path: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and report of a scan against the folder's manifest, which must name scanned images only."""
    results = found.select(F.col("source").alias("image"), "text", "confidence", "certain", "passes")
    rows = evaluate.chapter_rows(results, readers.manifest(spark, f"{path}/manifest.json"))
    return rows, evaluate.chapter_report(rows)
