"""Votes over several readings of one crop."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T

MODEL_SHARE, AGREEMENT_SHARE, CEILING = 0.70, 0.30, 0.999
#: Readings of the first pass, and of the later ones besides, in their order.
BASE_VARIANTS = ("raw", "gray", "otsu")
EXTENDED_VARIANTS = ("clahe", "otsu_inv", "adaptive", "rot90", "rot270")


def _winner(groups: DataFrame, by: list[str]) -> DataFrame:
    """Of each set of groups (key, n, mean, top, first): most readings, then best confidence, then first seen, then key."""
    everything = Window.partitionBy(*by)
    order = everything.orderBy(F.desc("n"), F.desc("top"), F.asc("first"), F.asc("key"))
    ranked = groups.withColumns({"total": F.sum("n").over(everything), "place": F.row_number().over(order)}).where("place = 1")
    # the share of n as a decimal, as in SQL: 0.3 * 3 as doubles falls short of 0.9, which decides between equal scores
    agreement = (F.lit(Decimal(str(AGREEMENT_SHARE))) * F.col("n")).cast("double")
    score = F.lit(MODEL_SHARE) * F.col("mean") + agreement / F.col("total")
    return ranked.withColumn("score", score).drop("place")


def consensus(readings: DataFrame, crop: str, key: str = "key", confidence: str = "confidence", seq: str = "seq", target: float = 0.90, order: str | None = None) -> DataFrame:
    """crop, text, confidence (capped), certain, n, total of each crop's readings.

    One partial aggregate to (crop, key) and a window over its few rows; `certain` needs the uncapped score
    at the target and at least two readings that agree. Confidences are added up by `order`, or else by seq
    and size: the last bit of a mean may decide between engines, and must not hang on how rows were dealt out.
    """
    place = F.col(order) if order else F.struct(F.col(seq), F.col(confidence))
    added = F.array_sort(F.collect_list(F.when(F.col(confidence).isNotNull(), F.struct(place.alias("at"), F.col(confidence).cast("double").alias("c")))))
    mean = F.when(F.size(added) > 0, F.aggregate(added, F.lit(0.0), lambda s, r: s + r["c"]) / F.size(added))
    groups = readings.groupBy(F.col(crop), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"), F.max(confidence).alias("top"), F.min(seq).alias("first"))
    won = _winner(groups, [crop])
    return won.select(crop, F.col("key").alias("text"), F.least(F.col("score"), F.lit(CEILING)).alias("confidence"), ((F.col("score") >= target) & (F.col("n") >= 2)).alias("certain"), "n", "total")


def bounded(readings: DataFrame, crop: str, key: str = "key", confidence: str = "confidence", seq: str = "seq", extended: str = "extended", passes: int = 4, target: float = 0.90) -> DataFrame:
    """crop, text, confidence, certain, passes: the vote repeated over growing evidence.

    A pass reads the base variants again and, from the second on, the extended ones, with the same
    results: after pass p a base reading weighs p + 1 and an extended one p. So readings are aggregated
    once, to the sums of either kind for each key, and passes are weights of those. The first pass that is
    certain wins, else the last.
    """
    if passes < 1:
        raise ValueError("at least one pass is needed")
    late = F.coalesce(F.col(extended), F.lit(False))
    of = lambda later, value: F.when(late if later else ~late, value)
    sums = readings.groupBy(F.col(crop), F.col(key).alias("key")).agg(
        F.count(of(False, F.lit(1))).alias("nb"), F.count(of(True, F.lit(1))).alias("nx"), F.coalesce(F.sum(of(False, F.col(confidence))), F.lit(0.0)).alias("sb"), F.coalesce(F.sum(of(True, F.col(confidence))), F.lit(0.0)).alias("sx"),
        F.max(of(False, F.col(confidence))).alias("tb"), F.max(of(True, F.col(confidence))).alias("tx"), F.min(of(False, F.col(seq))).alias("fb"), F.min(of(True, F.col(seq))).alias("fx"),
    )
    each = sums.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    n, later = F.col("nb") * (F.col("p") + 1) + F.col("nx") * F.col("p"), F.col("p") > 0
    groups = each.withColumn("n", n.cast("long")).where("n > 0").select(
        crop, "p", "key", "n", ((F.col("sb") * (F.col("p") + 1) + F.col("sx") * F.col("p")) / F.col("n")).alias("mean"),
        F.greatest("tb", F.when(later, F.col("tx"))).alias("top"), F.least("fb", F.when(later, F.col("fx"))).alias("first"),
    )
    sure = (F.col("score") >= target) & (F.col("n") >= 2)
    won = _winner(groups, [crop, "p"]).withColumn("certain", sure)
    # the first certain pass, else the last of all
    choice = F.min_by(F.struct("key", "score", "certain", "p"), F.when(F.col("certain"), F.col("p")).otherwise(F.lit(2 * passes) - F.col("p")))
    out = won.groupBy(crop).agg(choice.alias("c"))
    return out.select(crop, F.col("c.key").alias("text"), F.least(F.col("c.score"), F.lit(CEILING)).alias("confidence"), F.col("c.certain").alias("certain"), F.when(F.col("c.certain"), F.col("c.p") + 1).otherwise(passes).cast("int").alias("passes"))


def ensemble(primary: DataFrame, secondary: DataFrame, crop: str, normalize=lambda c: c, target: float = 0.90, names: tuple[str, str] = ("ppocrv3", "ppocrv5")) -> DataFrame:
    """crop, text, confidence, certain, passes, engine, engines_agree.

    Both inputs have crop, text, confidence, certain, passes. A stable primary result stands alone, and
    its crops need no secondary row; otherwise agreeing texts raise the confidence and disagreeing ones
    lower it and are never certain.
    """
    stable = F.col("certain") & (F.col("confidence") >= target)
    alone = primary.where(stable).select(crop, "text", "confidence", "certain", "passes", F.lit(names[0]).alias("engine"), F.lit(True).alias("engines_agree"))
    s = secondary.select(crop, F.col("text").alias("s_text"), F.col("confidence").alias("s_confidence"), F.col("passes").alias("s_passes"))
    both = primary.where(~F.coalesce(stable, F.lit(False))).join(s, crop)
    p_norm, s_norm = normalize(F.col("text")), normalize(F.col("s_text"))
    both = both.withColumns({"p_norm": p_norm, "s_norm": s_norm}).withColumn("agree", (F.col("p_norm") != "") & (F.lower("p_norm") == F.lower("s_norm")))
    joint = F.least(F.lit(CEILING), F.lit(0.5) * (F.col("confidence") + F.col("s_confidence")) + F.lit(0.12))
    first = F.col("confidence") >= F.col("s_confidence")
    settled = both.select(
        crop,
        F.when(F.col("agree") | first, F.col("p_norm")).otherwise(F.col("s_norm")).alias("text"),
        F.when(F.col("agree"), joint).otherwise(F.greatest("confidence", "s_confidence") * F.lit(0.85)).alias("confidence"),
        (F.col("agree") & (joint >= target)).alias("certain"),
        F.greatest("passes", "s_passes").alias("passes"),
        F.lit("+".join(names)).alias("engine"),
        F.col("agree").alias("engines_agree"),
    )
    return alone.unionByName(settled)


def choose(normal: DataFrame, bubble: DataFrame, page: str) -> DataFrame:
    """The page result that is certain, else the bubble one only if strictly more confident; `source` names it."""
    columns = [c for c in normal.columns if c != page]
    n, b = (d.select(page, F.struct(*columns).alias(s)) for d, s in ((normal, "n"), (bubble, "b")))
    take_normal = F.when(F.col("n.certain") != F.col("b.certain"), F.col("n.certain")).otherwise(~(F.col("b.confidence") > F.col("n.confidence")))
    both = n.join(b, page, "left").withColumn("normal", F.col("b").isNull() | take_normal)
    return both.select(page, *(F.when(F.col("normal"), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns), F.when(F.col("normal"), "normal").otherwise("bubble").alias("source"))


def not_noise(text: Column, confidence: Column) -> Column:
    """False for empty readings of low confidence; weak readings with text stay."""
    return ~((T.strip(text) == "") & (confidence < 0.5))
