"""Query op3: the main text of every page."""

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import html_tree
from scriptoria.llm.common import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(table(spark, sf_dir, "pages"))
