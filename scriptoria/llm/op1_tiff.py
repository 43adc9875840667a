"""Query op1: every document's text stored as TIFF and read back."""

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import tiff
from scriptoria.llm.common import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.texts_to_tiff(table(spark, sf_dir, "documents"))
    keys = [("doc_id", "long"), ("n_bytes", "long"), ("media_bytes", "long"), ("media_sha256", "string")]
    found = tiff.page_features(tiff.tiff_pages(media, "media", keys), keys)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
