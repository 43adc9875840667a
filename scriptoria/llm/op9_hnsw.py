"""Query op9: the ten nearest neighbours of every hundredth embedding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import hnsw
from scriptoria.llm.common import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(100)) == 0)
