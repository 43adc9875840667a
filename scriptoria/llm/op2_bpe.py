"""Query op2: every document encoded to ids and decoded again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import bpe
from scriptoria.llm.common import small_batches, table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = vocabulary_path()
    decoded = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
