"""Reports, chapters and data sets as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.text import page_header


def report(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept as fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def chapter(pages: DataFrame, path: str) -> None:
    """Page texts under their headers in page order, as text."""
    parts = pages.select("page", page_header(F.col("page"), F.col("name"), F.col("text")).alias("value"))
    parts.orderBy("page").select("value").write.mode("overwrite").text(path)


def page_texts(pages: DataFrame, path: str) -> None:
    """A folder for each page."""
    pages.select(F.format_string("page_%03d", F.col("page")).alias("page"), F.col("text").alias("value")).write.mode("overwrite").partitionBy("page").text(path)


#: Fixed value: the detector's classes in their order.
CLASSES = ("text", "bubble")


def dataset(manifest: DataFrame, path: str) -> None:
    """Manifest, label lines, recognition rows and the detector's settings; `manifest` as scriptoria.operators.corpus.dataset makes it."""
    manifest.write.mode("overwrite").partitionBy("split").json(f"{path}/manifest")
    manifest.select("split", F.col("image").alias("image"), F.explode("labels").alias("label")).write.mode("overwrite").partitionBy("split").option("sep", "\t").csv(f"{path}/labels")
    manifest.select("split", F.explode("recognition_rows").alias("value")).write.mode("overwrite").partitionBy("split").text(f"{path}/recognition")
    names = [f"  {k}: {name}" for k, name in enumerate(CLASSES)]
    settings = "\n".join([f"path: {path}", "train: images/train", "val: images/val", "names:", *names])
    spark = manifest.sparkSession
    spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/dataset.yaml")


def sentences(df: DataFrame, path: str) -> None:
    df.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def summary(report_: DataFrame) -> DataFrame:
    """A report without its rows."""
    return report_.drop("results")
