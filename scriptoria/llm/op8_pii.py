"""Query op8: personal data in every document."""

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import pii
from scriptoria.llm.common import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))
