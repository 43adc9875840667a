"""Decoding of per-step class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import text as T

BLANK = 0


def masked(probabilities: Column, allowed: list[bool]) -> Column:
    """One step's probabilities with those of forbidden classes at 0; `allowed` is the dictionary's size, which is fixed."""
    flags = F.array(*[F.lit(a) for a in allowed])
    return F.transform(probabilities, lambda p, i: F.when(F.coalesce(F.get(flags, i), F.lit(True)), p).otherwise(F.lit(0).cast("double")))


def best_path(steps: Column, characters: str | list[str], allowed: set[str] | None = None) -> Column:
    """struct(raw, confidence) of array<array<double>> steps.

    The first greatest class of each step; repeats collapse, a blank between them keeps them apart; a class
    beyond the dictionary writes nothing but still ends a repeat. Confidence is the mean probability of
    the written steps, 0 without any. A fold inside the row: no explode, no shuffle.
    """
    chars = list(characters)
    steps = steps.cast("array<array<double>>")
    if allowed is not None:
        flags = [True, *(c in allowed for c in chars)]
        steps = F.transform(steps, lambda p: masked(p, flags))
    names = F.array(*[F.lit(c) for c in chars])
    start = F.struct(F.lit(-1).alias("last"), F.lit("").alias("raw"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(acc, p):
        top = F.array_max(p)
        k = (F.array_position(p, top) - 1).cast("int")
        char = F.when((k != BLANK) & (k != acc["last"]), F.get(names, k - 1))
        wrote = char.isNotNull()
        return F.struct(
            k.alias("last"),
            F.concat(acc["raw"], F.coalesce(char, F.lit(""))).alias("raw"),
            (acc["total"] + F.when(wrote, top).otherwise(0.0)).alias("total"),
            (acc["n"] + wrote.cast("int")).alias("n"),
        )

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["raw"].alias("raw"), (acc["total"] / F.greatest(acc["n"], F.lit(1))).alias("confidence")))


def decode(df: DataFrame, steps: str, characters: str | list[str], allowed: set[str] | None = None) -> DataFrame:
    """The rows with raw_text and confidence."""
    return df.withColumn("_path", best_path(F.col(steps), characters, allowed)).withColumns({"raw_text": F.col("_path.raw"), "confidence": F.col("_path.confidence")}).drop("_path")


def verdict(df: DataFrame, steps: str, characters: str | list[str], threshold: float = 0.90) -> DataFrame:
    """The rows with raw_text, text (light normalization), confidence and certain: one reading, no vote, as small devices do it."""
    read = decode(df, steps, characters)
    return read.withColumns({"text": T.normalize_lite(F.col("raw_text")), "certain": F.col("confidence") >= threshold})


def uncovered(dictionary: DataFrame, allowed: DataFrame) -> DataFrame:
    """Allowed characters (ch) that the dictionary (ch) cannot write."""
    return allowed.select("ch").distinct().join(dictionary.select("ch"), "ch", "left_anti")
