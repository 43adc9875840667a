"""Scores of recognized pages against their truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import text as T


def truth_of(manifest: DataFrame, order: str = "ord") -> DataFrame:
    """page (string), text: a page without a number takes its place from 1; of repeated pages the last counts."""
    page = F.coalesce(F.col("page").cast("string"), F.col(order).cast("string"))
    return manifest.select(page.alias("page"), F.coalesce("text", F.lit("")).alias("text"), order).groupBy("page").agg(F.max_by("text", order).alias("text"))


def scored(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results (page, text, ...) with cer, null where the page has no truth."""
    expected = truth.select(F.col("page").alias("_page"), F.col("text").alias("_truth"))
    joined = results.join(expected, F.col("page").cast("string") == F.col("_page"), "left")
    return joined.withColumn("cer", F.when(F.col("_truth").isNotNull(), T.cer(F.col("_truth"), F.col("text")))).drop("_page", "_truth")


def engine_report(rows: DataFrame, engine: str = "engine") -> DataFrame:
    """engine, pages, mean_cer (over rows with a rate and no error, else null), mean_latency_sec (over all rows)."""
    good = F.when(F.col("error").isNull(), F.col("cer"))
    return rows.groupBy(engine).agg(F.count(F.lit(1)).alias("pages"), F.avg(good).alias("mean_cer"), (F.sum("latency_sec") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_latency_sec"))


def chapter_rows(results: DataFrame, manifest: DataFrame, image: str = "image") -> DataFrame:
    """page, expected, actual, cer, exact and the result's columns; the manifest drives, and a missing image fails."""
    truth = manifest.select(F.col(image), F.col("page"), F.col("text").alias("expected"))
    joined = truth.join(results.withColumnRenamed("text", "actual").withColumn("_there", F.lit(True)), image, "left")
    checked = F.when(F.col("_there"), F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("no result for "), F.col(image))).cast("string"))
    e = T.comparable(F.col("expected"))
    return joined.withColumn("actual", checked).drop("_there").withColumns({"cer": T.cer(F.col("expected"), F.col("actual")), "exact": e == T.comparable(F.col("actual"))})


def chapter_report(rows: DataFrame) -> DataFrame:
    """pages, exact_pages, mean_cer, certain_pages."""
    return rows.agg(F.count(F.lit(1)).alias("pages"), F.count_if("exact").alias("exact_pages"), (F.coalesce(F.sum("cer"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_cer"), F.count_if("certain").alias("certain_pages"))
