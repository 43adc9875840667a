"""The corpus pipeline: documents in five stages, each written as Parquet and read again.

Language identification rejects documents of no learned language; of each group of near copies (five
words, similarity 0.8) the document with the least id stays; personal data is masked; the sources are
interleaved to their target weights; the texts become token ids, each row with its slot in that mix, as a
reader of several files does not keep their order. The result is in the order of the slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import bpe, jaccard, langid, pfair, pii
from scriptoria.llm.common import Scratch, crc_mod, small_batches
from scriptoria.llm.op2_bpe import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text fits a language learned from labelled rows.

    Null and empty texts and those without a letter go; without labelled rows, no language is learned and all go.
    A null label teaches nothing; null ids count as the empty one for the fold; repeated rows stay or go alike.
    """
    return langid.accept(docs, langid.train(docs.where(crc_mod("doc_id", 4) != 2)))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, rows without an id last.

    Null and empty texts have no copies and stay; of rows equal in id and text one stays; long texts are compared whole.
    """
    return jaccard.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and `n_chars` brought up to date; null and empty texts stay as they are."""
    return pii.with_length(pii.redact(docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix. Null sources are a source of their own; rows of equal or no ids are
    ordered by a digest of their columns; columns of any name are kept."""
    return pfair.in_order(pfair.mix(docs, prefix="_mix_"), prefix="_mix_").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, with their slots; a null text is encoded as the empty one.

    The mix's slots follow from its rows alone, so they are computed again from the rows that were read.
    """
    small_batches(spark)
    path, keep = vocabulary_path(), ("_mix_slot",)
    mixed = pfair.mix(docs, prefix="_mix_").select("doc_id", "_mix_slot", "text")
    decoded = bpe.bpe_decode(bpe.bpe_encode(mixed, path, keep=keep), path, keep=keep)
    return decoded.select("doc_id", F.col("_mix_slot").alias("slot"), "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("personal data", mask_personal_data),
    ("mixing sources", mix_sources),
    ("byte-pair encoding", encode),
]
#: SQL has no expression for trained classifiers and token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows in the order of the mix; every stage's table goes to the shared checkpoint folder and is
    removed when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = done
    return docs.orderBy("slot", "doc_id")
