"""Text normalization as Column expressions: everything stays in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptoria.functions.profile import CYRILLIC, JAVA_DIGIT, JAVA_SPACE, AlphabetProfile, ranges


def bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once: a lambda's argument is not expanded by the optimizer."""
    return F.element_at(F.transform(F.array(value), use), 1)


def map_confusables(text: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """Latin look-alikes become letters of the profile."""
    return F.translate(text, profile.confusable_from, profile.confusable_to) if profile.confusable_from else text


def tokens(text: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """Runs of letters and ASCII digits, in order."""
    return F.regexp_extract_all(text, F.lit(f"({profile.token_pattern})"), 1)


def strip(text: Column) -> Column:
    """Trim white space as Python's str.strip does."""
    return F.regexp_replace(text, f"^[{JAVA_SPACE}]+|[{JAVA_SPACE}]+$", "")


def restore_case(source: Column, target: Column) -> Column:
    """The case pattern of `source` on the lower-case `target`: all upper, first upper, or as it is."""
    initial = F.substring(source, 1, 1)
    return (
        F.when((source == F.upper(source)) & (source != F.lower(source)), F.upper(target))
        .when((initial == F.upper(initial)) & (initial != F.lower(initial)), F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 1 << 30)))
        .otherwise(target)
    )


def token_letters(token: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """The token's letters, digit look-alikes included if it has a letter; else its digits."""
    has = token.rlike(f"[{profile.letter_class}]")
    digits = F.translate(token, profile.digit_from, profile.digit_to) if profile.digit_from else token
    return F.when(has, F.regexp_replace(digits, f"[^{profile.letter_class}]", "")).otherwise(F.regexp_replace(token, "[^0-9]", ""))


def correct_token(token: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """Visual correction of one mapped token, without a lexicon."""
    return bound(token_letters(token, profile), lambda letters: restore_case(letters, F.lower(letters)))


def rewrite_tokens(text: Column, rewrite, profile: AlphabetProfile = CYRILLIC) -> Column:
    """`rewrite` on every token; what stands between tokens stays."""
    gaps = F.split(text, profile.token_pattern, -1)
    changed = F.transform(tokens(text, profile), rewrite)
    return F.array_join(F.zip_with(gaps, changed, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def allowed_only(text: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """Letters of the profile, digits, white space and its punctuation; all else goes."""
    return F.regexp_replace(text, f"[^{profile.letter_class}0-9{profile.punctuation_class}{JAVA_SPACE}{JAVA_DIGIT}]+", "")


def tidy(text: Column) -> Column:
    """Blanks and tabs to one blank, none before closing punctuation, trimmed."""
    text = F.regexp_replace(text, "[ \\t]+", " ")
    return strip(F.regexp_replace(text, f"[{JAVA_SPACE}]+([,.;:!?%])", "$1"))


def without_foreign(text: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """Look-alikes mapped and the other foreign letters gone, in one pass: the token rules drop those in any case."""
    other = "".join(c for c in string.ascii_letters if c not in profile.confusable_from) if profile.foreign else ""
    return F.translate(text, profile.confusable_from + other, profile.confusable_to) if profile.confusable_from + other else text


def needs_tokens(mapped: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """Whether a token mixes letters with digits, or has a capital after its first letter and a small one.

    `mapped` holds no foreign letters. Without such a token the token rules change nothing.
    """
    small, capital = f"[{ranges(profile.letters)}]", f"[{ranges(profile.letters.upper())}]"
    return mapped.rlike(f"{small}(?:{capital}|[0-9])|{capital}(?:{capital}++{small}|[0-9])|[0-9][{profile.letter_class}]")


def normalize(text: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """Visual normalization of recognized text: look-alikes, case, alphabet, white space.

    Rows whose tokens need no rule of their own, the great majority, take whole-text replacements only;
    the rewrite token by token is evaluated for the others.
    """

    def rules(mapped: Column) -> Column:
        return F.when(needs_tokens(mapped, profile), rewrite_tokens(mapped, lambda t: correct_token(t, profile), profile)).otherwise(mapped)

    return tidy(allowed_only(bound(without_foreign(text, profile), rules), profile))


def normalize_lite(text: Column, profile: AlphabetProfile = CYRILLIC) -> Column:
    """The light profile of small devices: look-alikes, ASCII digits, alphabet, blanks; no token rules."""
    kept = F.regexp_replace(without_foreign(text, profile), f"[^{profile.letter_class}0-9{JAVA_SPACE}{profile.punctuation_class}]+", "")
    return strip(F.regexp_replace(kept, "[ \\t]+", " "))


def comparable(text: Column) -> Column:
    """Lower case, every run of white space one blank, trimmed."""
    return F.regexp_replace(strip(F.lower(text)), f"[{JAVA_SPACE}]+", " ")


def cer(expected: Column, actual: Column) -> Column:
    """Character error rate of `actual` over the length of `expected`; may exceed 1."""
    e, a = comparable(expected), comparable(actual)
    return F.levenshtein(e, a) / F.greatest(F.lit(1), F.char_length(e))


def words(text: Column) -> Column:
    """Words of the comparable form; none for an empty text."""
    c = comparable(text)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def wer(expected: Column, actual: Column) -> Column:
    """Word error rate: edit distance over words, by a fold over the rows of the distance table."""
    e, a = words(expected), words(actual)
    first = F.sequence(F.lit(0), F.size(a))

    def row(acc, word):
        # the next row: each cell from the one to its left, above and above left
        def cell(left, i):
            best = F.least(F.element_at(left, -1) + 1, F.get(acc, i + 1) + 1, F.get(acc, i) + F.when(F.get(a, i) == word, 0).otherwise(1))
            return F.concat(left, F.array(best))

        columns = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, F.array(F.get(acc, F.lit(0)) + 1), cell)

    return F.element_at(F.aggregate(e, first, row), -1) / F.greatest(F.lit(1), F.size(e))


def layout_score(expected_lines: Column, actual_lines: Column) -> Column:
    """Share of the expected lines that stand in the result in comparable form."""
    actual = F.transform(actual_lines, comparable)
    hit = F.size(F.filter(expected_lines, lambda x: F.array_contains(actual, comparable(x))))
    return hit / F.greatest(F.lit(1), F.size(expected_lines))


def wrap(text: Column, width: int) -> Column:
    """Greedy lines of at most `width` characters, a longer word alone; a text without words is its own line."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("current"))

    def step(acc, word):
        joined = F.when(acc["current"] == "", word).otherwise(F.concat_ws(" ", acc["current"], word))
        over = (acc["current"] != "") & (F.char_length(joined) > width)
        return F.struct(F.when(over, F.concat(acc["lines"], F.array(acc["current"]))).otherwise(acc["lines"]).alias("lines"), F.when(over, word).otherwise(joined).alias("current"))

    parts = F.filter(F.split(text, f"[{JAVA_SPACE}]+"), lambda w: w != "")
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["current"] == "", F.array(text)).otherwise(F.concat(acc["lines"], F.array(acc["current"]))))


def natural_key(name: Column) -> Column:
    """Sorts names with their numbers as numbers: lower case, digits padded to 20 places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def page_header(number: Column, name: Column, text: Column) -> Column:
    return F.concat(F.lit("\n===== СТРАНИЦА "), number.cast("string"), F.lit(": "), name, F.lit(" =====\n"), text, F.lit("\n"))
