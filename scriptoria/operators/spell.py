"""Spelling against a lexicon: one-edit correction and splitting of fused words.

A lexicon is a DataFrame (word, morph, zipf, ipm) with lower-case words. Texts are reduced to their
distinct tokens first, so the search runs once for each token of the corpus and its result is joined
back by token; the lexicon is an ordinary join side, broadcast by Spark only where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions.profile import CYRILLIC, AlphabetProfile
from scriptoria.session import stored

MORPH_SHARE, FREQUENCY_SHARE, LENGTH_PENALTY = 0.62, 0.38, 0.015
GOOD, FLOOR, MARGIN = 0.20, 0.35, 0.15
# The words of one letter, and the words under four letters that may stand between others.
ONE_LETTER = ("а", "в", "и", "к", "о", "с", "у", "я")
SHORT_WORDS = (*ONE_LETTER, "же", "не", "но", "на", "по", "из", "за", "от", "до", "ко", "со")


def frequency(zipf: Column, ipm: Column) -> Column:
    """0 to 1: the better of the Zipf scale over 6 and the logarithm of occurrences per million over 9."""
    by_zipf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(zipf, F.lit(0.0)) / 6.0))
    by_ipm = F.when(ipm > 0, F.least(F.lit(1.0), F.log1p(ipm) / 9.0)).otherwise(0.0)
    return F.greatest(by_zipf, by_ipm)


def scored_lexicon(lexicon: DataFrame) -> DataFrame:
    """word, morph, freq; the best of repeated words."""
    scored = lexicon.select(F.lower("word").alias("word"), F.coalesce("morph", F.lit(0.0)).alias("morph"), frequency(F.col("zipf"), F.col("ipm")).alias("freq"))
    return scored.groupBy("word").agg(F.max("morph").alias("morph"), F.max("freq").alias("freq"))


def edits(word: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """All strings at one edit of a lower-case word, first come first: deletions, insertions, replacements, swaps."""
    letters = F.array(*[F.lit(c) for c in profile.letters])
    n = F.char_length(word)
    upto = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    head, tail = (lambda i: F.substring(word, F.lit(1), i)), (lambda i: F.substring(word, i, n))
    gone = F.filter(F.transform(upto(F.lit(1), n), lambda i: F.concat(head(i - 1), tail(i + 1))), lambda s: s != "")
    added = F.flatten(F.transform(upto(F.lit(0), n), lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i + 1)))))
    changed = F.flatten(F.transform(upto(F.lit(1), n), lambda i: F.transform(F.filter(letters, lambda c: c != F.substring(word, i, F.lit(1))), lambda c: F.concat(head(i - 1), c, tail(i + 1)))))
    at = lambda i: F.substring(word, i, F.lit(1))
    swapped = F.transform(F.filter(upto(F.lit(1), n - 1), lambda i: at(i) != at(i + 1)), lambda i: F.concat(head(i - 1), at(i + 1), at(i), tail(i + 2)))
    return F.array_distinct(F.concat(gone, added, changed, swapped))


def best_edits(words: DataFrame, lexicon: DataFrame, profile: AlphabetProfile = CYRILLIC) -> DataFrame:
    """word, corrected for distinct lower-case words (word): the word itself unless an edit is clearly better.

    Known words (morph of 0.2 or more) are left out of the search before any edit is made. The candidate of
    the highest rank wins, the first made of equal ones, if it reaches 0.35 and 0.15 above the word's score.
    """
    known = scored_lexicon(lexicon)
    base = words.select("word").distinct().join(known.select("word", F.col("morph").alias("base")), "word", "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    made = base.where(F.col("base") < GOOD).select("word", "base", F.posexplode(edits(F.col("word"), profile)).alias("ord", "candidate"))
    found = made.join(known.where("morph > 0").withColumnRenamed("word", "candidate"), "candidate")
    rank = F.lit(MORPH_SHARE) * F.col("morph") + F.lit(FREQUENCY_SHARE) * F.col("freq") - F.lit(LENGTH_PENALTY) * F.abs(F.char_length("candidate") - F.char_length("word"))
    best = found.withColumn("rank", rank).groupBy("word").agg(F.max("base").alias("base"), F.max_by(F.struct("candidate", "rank"), F.struct(F.col("rank"), -F.col("ord"))).alias("best"))
    accepted = best.where(F.col("best.rank") >= F.greatest(F.lit(FLOOR), F.col("base") + MARGIN)).select("word", F.col("best.candidate").alias("candidate"))
    return base.select("word").join(accepted, "word", "left").select("word", F.coalesce("candidate", "word").alias("corrected"))


#: Letters of a piece at most; what a piece costs that does not begin the word, by whether it has one letter; what a split must gain.
LONGEST, PIECE_COST, LETTER_COST, GAIN = 20, 0.95, 1.35, 0.25


def piece_score(piece: Column, morph: Column, freq: Column) -> Column:
    """How well a known piece stands alone, null for one that may not; single letters go by their list, not by the lexicon."""
    trusted = (F.char_length(piece) >= 4) | (piece.isin(*SHORT_WORDS) & (freq >= 0.5))
    known = (morph > 0) | (freq >= 0.5)
    return F.when((F.char_length(piece) > 1) & trusted & known, F.lit(0.55) * F.least(F.lit(1.0), morph / 0.5) + F.lit(0.45) * freq)


def best_split(word: Column, scores: Column) -> Column:
    """The pieces of a word along its best path, with blanks between, or the word itself.

    `scores` maps the pieces of two letters or more that may stand alone to their score. A fold over the ends
    of pieces keeps the best path to each; of equal ones that with the longest last piece.
    """
    step = "struct<total:double,before:int,pieces:string>"
    nowhere = F.struct(F.lit(None).cast("double").alias("total"), F.lit(0).alias("before"), F.lit("").alias("pieces")).cast(step)

    def reach(paths: Column, end: Column) -> Column:
        def through(start: Column) -> Column:
            piece = F.substring(word, start + 1, end - start)
            single = F.when((end - start == 1) & piece.isin(*ONE_LETTER), F.lit(0.10))
            last = F.get(paths, start)
            cost = F.when(start == 0, 0.0).when(end - start == 1, LETTER_COST).otherwise(PIECE_COST)
            total = last["total"] + F.coalesce(single, F.element_at(scores, piece)) - cost
            joined = F.concat(last["pieces"], F.when(start == 0, "").otherwise(" "), piece)
            return F.struct(total.alias("total"), (-start).cast("int").alias("before"), joined.alias("pieces"))

        ways = F.transform(F.sequence(F.greatest(F.lit(0), end - LONGEST), end - 1), through)
        return F.coalesce(F.array_max(F.filter(ways, lambda w: w["total"].isNotNull())).cast(step), nowhere)

    begin = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("before"), F.lit("").alias("pieces")).cast(step))
    paths = F.aggregate(F.sequence(F.lit(1), F.char_length(word)), begin, lambda acc, end: F.concat(acc, F.array(reach(acc, end))))
    best = F.element_at(paths, -1)
    whole = F.coalesce(F.element_at(scores, word), F.lit(-1.0))
    return F.when(best["total"] >= whole + GAIN, best["pieces"]).otherwise(word)


def segmented(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, pieces (blank between them) for distinct lower-case words (word).

    Words under nine letters, and words good by themselves, pass by. The lexicon reaches the search through
    a join of the words' substrings, so no task needs all of it.
    """
    known = scored_lexicon(lexicon)
    base = words.select("word").distinct().join(known, "word", "left")
    long = base.where((F.char_length("word") >= 9) & ~F.coalesce((F.col("morph") >= GOOD) & (F.col("freq") >= 0.16), F.lit(False))).select("word")
    n = F.char_length("word")
    starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - i + 1)), lambda k: F.substring(F.col("word"), i, k)))
    pieces = long.select("word", F.explode(F.array_distinct(F.concat(F.flatten(starts), F.array("word")))).alias("piece"))
    scored = known.select(F.col("word").alias("piece"), piece_score(F.col("word"), F.col("morph"), F.col("freq")).alias("score")).where("score is not null")
    found = pieces.join(scored, "piece").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("piece", "score"))).alias("scores"))
    none = F.create_map().cast("map<string,double>")
    cut = long.join(found, "word", "left").select("word", best_split(F.col("word"), F.coalesce("scores", none)).alias("pieces"))
    return base.select("word").join(cut, "word", "left").select("word", F.coalesce("pieces", "word").alias("pieces"))


def _cased_pieces(source: Column, pieces: Column) -> Column:
    """All upper if the source is, else the first piece with a capital if the source has one."""
    return T.restore_case(source, pieces)


def normalize_with(df: DataFrame, text: str, lexicon: DataFrame, out: str = "normalized", profile: AlphabetProfile = CYRILLIC) -> DataFrame:
    """The rows with `text` normalized against the lexicon: look-alikes, one-edit spelling, fused words, tidying.

    Tokens become rows for the joins with the distinct corrected words and are put together again by text.
    All columns are kept, but one named as `out`, which it replaces; a null text stays null.
    """
    source = df[text]
    # distinct texts are the rows of the search, so that no row needs a number and repeated texts are done once
    rows = df.select(F.col(text).alias("_id")).where(F.col(text).isNotNull()).distinct()
    text = "_id"
    mapped = rows.select("_id", T.map_confusables(F.col(text), profile).alias("t"))
    # a gap and its token in one element: a row that carried all tokens would make long texts quadratic
    parts = mapped.select("_id", F.arrays_zip(F.split("t", profile.token_pattern, -1).alias("gap"), T.tokens(F.col("t"), profile).alias("token")).alias("parts"))
    each = parts.select("_id", F.posexplode("parts").alias("k", "p")).select("_id", "k", "p.gap", "p.token")
    each = each.withColumn("letters", F.when(F.col("token").isNotNull(), T.token_letters(F.col("token"), profile)))
    each = each.withColumn("word", F.when(F.col("letters").rlike(f"[{profile.letter_class}]"), F.lower("letters")))
    # written once: both joins below and the search for fused words read the corrected words
    corrected = stored(best_edits(each.where("word is not null").select("word"), lexicon, profile))
    pieces = segmented(corrected.select(F.col("corrected").alias("word")), lexicon)
    final = corrected.join(pieces.withColumnRenamed("word", "corrected"), "corrected").select("word", "corrected", "pieces")
    done = each.join(final, "word", "left")
    cased = F.when(F.col("word").isNull(), F.coalesce("letters", F.lit(""))).otherwise(_cased_pieces(T.restore_case(F.col("letters"), F.col("corrected")), F.col("pieces")))
    joined = done.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("k", F.concat("gap", cased).alias("s")))).alias("p"))
    text_ = joined.select("_id", T.tidy(T.allowed_only(F.array_join(F.transform("p", lambda p: p["s"]), ""), profile)).alias(out))
    found = text_.withColumnRenamed("_id", "_text").withColumnRenamed(out, "_normalized")
    kept = [df[f"`{c}`"] for c in df.columns if c != out]
    return df.join(found, source.eqNullSafe(F.col("_text")), "left").select(*kept, F.col("_normalized").alias(out))
