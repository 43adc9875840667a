"""Query op10: the language of every document."""

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import langid
from scriptoria.llm.common import crc_mod, table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
