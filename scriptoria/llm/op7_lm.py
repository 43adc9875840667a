"""Query op7: the language model's score of every document."""

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import interpolation
from scriptoria.llm.common import crc_mod, table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 7)
    return interpolation.score(table(spark, sf_dir, "documents"), fold == 2, fold == 3)
