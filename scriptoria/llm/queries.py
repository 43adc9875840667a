"""The queries of this subpackage, one module opN_<name> each, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import op1_tiff, op2_bpe, op3_html, op4_jaccard, op5_warc, op6_mix, op7_lm, op8_pii, op9_hnsw, op10_langid

MODULES = (op1_tiff, op2_bpe, op3_html, op4_jaccard, op5_warc, op6_mix, op7_lm, op8_pii, op9_hnsw, op10_langid)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.__name__.rpartition(".")[2]: m.run for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.__name__.rpartition(".")[2]: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
