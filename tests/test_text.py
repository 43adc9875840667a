import random

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions.profile import CYRILLIC


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def restated(text):
    """An independent statement of visual normalization, token by token."""
    import re

    lower = CYRILLIC.letters
    letters = set(lower) | set(lower.upper())
    text = text.translate(str.maketrans(CYRILLIC.confusable_from, CYRILLIC.confusable_to))

    def token(m):
        t = m[0]
        if letters.isdisjoint(t):
            return "".join(filter(str.isdigit, t))
        y = "".join(c for c in t.translate(str.maketrans(CYRILLIC.digit_from, CYRILLIC.digit_to)) if c in letters)
        return y if y == y.upper() else (y[0] + y[1:].lower() if y[0] == y[0].upper() else y.lower())

    text = re.sub(CYRILLIC.token_pattern, token, text)
    text = "".join(c for c in text if c in letters or c.isdigit() or c.isspace() or c in CYRILLIC.punctuation)
    return re.sub(r"\s+([,.;:!?%])", r"\1", re.sub(r"[ \t]+", " ", text)).strip()


@pytest.mark.parametrize("given,wanted", [("TeKcTa", "Текста"), ("Pyсckого", "Русского"), ("", ""), ("глава12", "глава"), ("12 глав", "12 глав"), ("а , б", "а, б"), ("xyz", "ху"), ("6улок", "булок")])
def test_normalize_cases(spark, given, wanted):
    assert one(spark, T.normalize(F.col("t")), t=given) == wanted


def test_normalize_matches_a_restatement(spark):
    rng = random.Random(5)
    pool = list("абВгЁёяЯ ABCEKacekijubqQZ0123456789 .,!?;:-()[]«»№\t\n@#$^\\") + ["ß", "é", " ", "²"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(800)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize(F.col("t")).alias("x")).collect()
    wrong = [(texts[r["i"]], r["x"], restated(texts[r["i"]])) for r in rows if r["x"] != restated(texts[r["i"]])]
    assert not wrong, wrong[:3]


def test_normalize_is_idempotent_and_keeps_null(spark):
    assert one(spark, T.normalize(T.normalize(F.col("t"))), t="Глава 3ab , тЕкСт") == one(spark, T.normalize(F.col("t")), t="Глава 3ab , тЕкСт")
    assert spark.sql("select cast(null as string) t").select(T.normalize(F.col("t")).alias("x")).first()["x"] is None


def test_lite_drops_letters_but_keeps_digits(spark):
    assert one(spark, T.normalize_lite(F.col("t")), t=" Глaва  12q ") == "Глава 12"


def test_error_rates(spark):
    assert one(spark, T.cer(F.col("e"), F.col("a")), e="проверка", a="роверка") == pytest.approx(1 / 8)
    assert one(spark, T.cer(F.col("e"), F.col("a")), e="", a="abc") == 3
    assert one(spark, T.wer(F.col("e"), F.col("a")), e="a b c", a="a x c d") == pytest.approx(2 / 3)
    assert one(spark, T.wer(F.col("e"), F.col("a")), e="a b", a="") == 1
    assert one(spark, T.layout_score(F.col("e"), F.col("a")), e=["A b", "c"], a=["a  B"]) == 0.5


def test_wrap_and_natural_key(spark):
    assert one(spark, T.wrap(F.col("t"), 7), t="aa bb cccc ddddddddd e") == ["aa bb", "cccc", "ddddddddd", "e"]
    assert one(spark, T.wrap(F.col("t"), 7), t="  ") == ["  "]
    names = ["p10.png", "p2.png", "P1.png", "p02b.png"]
    rows = spark.createDataFrame([(n,) for n in names], ["n"]).orderBy(T.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in rows] == ["P1.png", "p2.png", "p02b.png", "p10.png"]
