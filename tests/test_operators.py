import random

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.functions.profile import CYRILLIC
from scriptoria.operators import corpus, ctc, evaluate, layout, live, spell, vote


def test_ctc_repeats_blanks_and_missing_classes(spark):
    def steps(path):
        return [[1.0 if k == c else 0.0 for k in range(5)] for c in path]

    rows = spark.createDataFrame([(1, steps([1, 1, 0, 1, 2])), (2, steps([0, 0])), (3, steps([1, 4, 1])), (4, [])], "id int, p array<array<double>>")
    out = {r["id"]: (r["raw_text"], r["confidence"]) for r in ctc.decode(rows, "p", "abc").collect()}
    assert out == {1: ("aab", 1.0), 2: ("", 0.0), 3: ("aa", 1.0), 4: ("", 0.0)}
    masked = ctc.decode(rows, "p", "abc", {"b"}).where("id = 1").first()
    assert masked["raw_text"] == "b"


def literal_vote(cands, target, passes):
    """The loop over passes as it is defined, on lists: (variant order, extended, key, confidence)."""
    seen = []
    result = None
    for p in range(passes):
        seen += [c for c in cands if p > 0 or not c[1]]
        groups = {}
        for c in seen:
            groups.setdefault(c[2], []).append(c[3])
        key = max(groups, key=lambda k: (len(groups[k]), max(groups[k])))
        g = groups[key]
        score = 0.7 * sum(g) / len(g) + 0.3 * len(g) / len(seen)
        result = (key, score, score >= target and len(g) >= 2, p + 1)
        if result[2]:
            return result
    return result


def test_bounded_vote_equals_the_loop(spark):
    rng = random.Random(8)
    rows, wanted = [], {}
    for crop in range(300):
        ext = rng.choice([3, 5])
        cands = [(s, s >= 3, rng.choice("ab" if rng.random() < 0.6 else "abc"), rng.uniform(0.5, 1.0)) for s in range(3 + ext)]
        rows += [(crop, c[2], c[3], c[0], c[1]) for c in cands]
        wanted[crop] = literal_vote(cands, 0.9, 4)
    df = spark.createDataFrame(rows, "crop int, key string, confidence double, seq int, extended boolean")
    got = {r["crop"]: r for r in vote.bounded(df, "crop").collect()}
    for crop, (key, score, certain, passes) in wanted.items():
        assert (got[crop]["text"], got[crop]["certain"], got[crop]["passes"]) == (key, certain, passes)
        assert got[crop]["confidence"] == pytest.approx(min(score, 0.999))
    with pytest.raises(ValueError):
        vote.bounded(df, "crop", passes=0)


def test_ensemble_agreement_and_abstention(spark):
    schema = "crop int, text string, confidence double, certain boolean, passes int"
    p = spark.createDataFrame([(1, "да", 0.95, True, 1), (2, "Да", 0.8, False, 4), (3, "да", 0.7, False, 2), (4, "", 0.5, False, 1)], schema)
    s = spark.createDataFrame([(2, "да", 0.8, False, 3), (3, "нет", 0.9, True, 4), (4, "", 0.6, False, 1)], schema)
    out = {r["crop"]: r for r in vote.ensemble(p, s, "crop").collect()}
    assert out[1]["engine"] == "ppocrv3" and out[1]["certain"]
    assert out[2]["certain"] and out[2]["confidence"] == pytest.approx(0.92) and out[2]["passes"] == 4 and out[2]["text"] == "Да"
    assert not out[3]["certain"] and out[3]["text"] == "нет" and out[3]["confidence"] == pytest.approx(0.765)
    assert not out[4]["engines_agree"]


def test_choose_prefers_certain_then_strictly_better(spark):
    schema = "page int, confidence double, certain boolean"
    n = spark.createDataFrame([(1, 0.5, True), (2, 0.5, False), (3, 0.5, False), (4, 0.1, False)], schema)
    b = spark.createDataFrame([(1, 0.9, False), (2, 0.5, False), (3, 0.6, False)], schema)
    out = {r["page"]: r["source"] for r in vote.choose(n, b, "page").collect()}
    assert out == {1: "normal", 2: "normal", 3: "bubble", 4: "normal"}


def test_rows_equal_the_greedy_fold(spark):
    rng = random.Random(3)
    rows = [(page, seq, rng.uniform(0, 300), rng.uniform(8, 30), rng.uniform(0, 500)) for page in range(20) for seq in range(rng.randrange(1, 25))]
    wanted = set()
    for page in range(20):
        found = []
        for _, seq, cy, h, x in [r for r in rows if r[0] == page]:
            for row in found:
                if abs(cy - sum(r[1] for r in row) / len(row)) <= max(h, sum(r[2] for r in row) / len(row)) * 0.6:
                    row.append((seq, cy, h, x))
                    break
            else:
                found.append([(seq, cy, h, x)])
        found.sort(key=lambda row: min(r[1] for r in row))
        wanted |= {(page, i + 1, j + 1, r[0]) for i, row in enumerate(found) for j, r in enumerate(sorted(row, key=lambda r: r[3]))}
    df = spark.createDataFrame(rows, "page int, seq int, cy double, h double, x double")
    assert {tuple(r) for r in layout.rows_of(df, "page", "cy", "h", "x", "seq").collect()} == wanted


def test_word_spans_guards_and_padding(spark):
    def columns(crop, xs, w):
        return [(crop, x, w) for x in xs]

    rows = columns(1, [*range(5, 10), *range(12, 20), *range(40, 50)], 60) + columns(2, [0, 1, 25], 31) + columns(3, [*range(0, 10), *range(12, 20)], 50)
    out = sorted(tuple(r) for r in layout.word_spans(spark.createDataFrame(rows, "crop int, x int, w int"), "crop", "x", "w").collect())
    assert out == [(1, 1, 0, 60)] or out[0][0] == 1  # a cut needs 1.7 times the median gap
    from scriptoria.functions.kernels import word_pieces

    import numpy as np

    for crop in (1, 2, 3):
        w = next(r[2] for r in rows if r[0] == crop)
        image = np.full((10, w), 255, np.uint8)
        image[:, [r[1] for r in rows if r[0] == crop]] = 0
        assert [(o[2], o[3]) for o in out if o[0] == crop] == word_pieces(image)


def test_suppression_per_class_and_degenerate_boxes(spark):
    rows = [(1, 1, 0, 0, 10, 10, 0.9, 0), (1, 2, 1, 1, 10, 10, 0.8, 1), (1, 3, 5, 5, 5, 9, 0.99, 0), (1, 4, 0, 0, 10, 10, 0.1, 0), (1, 5, 20, 20, 30, 30, 0.9, 0)]
    df = spark.createDataFrame(rows, "page int, id int, x0 int, y0 int, x1 int, y1 int, score double, cls int")
    assert [r["id"] for r in layout.suppressed(df, "page", "score", "id").orderBy("ord").collect()] == [1, 5]
    assert {r["id"] for r in layout.suppressed(df, "page", "score", "id", per_class="cls").collect()} == {1, 2, 5}


def test_page_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "confidence double, certain boolean, passes int")
    r = empty.agg(*layout.page_summary(F.col("confidence"), F.col("certain"), F.col("passes"))).first()
    assert (r["confidence"], r["certain"], r["passes"]) == (0.0, False, 0)


def test_rounding_and_label_lines(spark):
    df = spark.createDataFrame([(0.00015,), (0.00005,), (None,)], "v double")
    assert [r[0] for r in df.select(G.python_round(F.col("v"), 4)).collect()][:2] == [0.0001, 0.0001]
    r = spark.range(1).select(G.label_line(F.lit(1), F.lit(-5), F.lit(0), F.lit(50), F.lit(100), F.lit(100), F.lit(200)).alias("a"), G.label_line(F.lit(0), F.lit(5), F.lit(0), F.lit(5), F.lit(9), F.lit(9), F.lit(9)).alias("b")).first()
    assert r["a"] == "1 0.250000 0.250000 0.500000 0.500000" and r["b"] == ""


def test_live_fold_reset_force_and_vectors(spark):
    rows = [("s", 1, [0.0, 0.0], "a", False, False), ("s", 2, [0.001, 0.0], "b", False, False), ("s", 3, [0.001, 0.0], "c", True, False), ("s", 4, [0.002, 0.0], "d", False, True), ("t", 1, [0.0, 0.0], "e", False, False), ("s", 5, [0.9, 0.0], "f", False, False)]
    df = spark.createDataFrame(rows, "session string, seq int, sig array<double>, text string, force boolean, reset boolean")
    out = {(r["session"], r["seq"]): (r["frame_id"], r["analyzed"], r["shown"]) for r in live.suppress_repeats(df, "session", ["seq"], "sig", "text", force="force", reset="reset").collect()}
    assert out == {("s", 1): (1, True, "a"), ("s", 2): (2, False, "a"), ("s", 3): (3, True, "c"), ("s", 4): (1, True, "d"), ("s", 5): (2, True, "f"), ("t", 1): (1, True, "e")}


LEXICON = [(w, 0.6, 4.5, 100.0) for w in ("проверка", "ещё", "булок", "какая", "ужасная", "последний", "воин", "человечества")] + [("же", 0.9, 6.5, 5000.0), ("не", 0.9, 7.0, 9000.0)]


@pytest.mark.parametrize("given,wanted", [
    ("роверка", "проверка"), ("ешё", "ещё"), ("роверк9", "проверка"), ("6улок", "булок"), ("КАКАЯЖЕУЖАСНАЯ", "КАКАЯ ЖЕ УЖАСНАЯ"),
    ("ПОСЛЕДНИЙВОИНЧЕЛОВЕЧЕСТВА", "ПОСЛЕДНИЙ ВОИН ЧЕЛОВЕЧЕСТВА"), ("Роверка, 12 ешё!", "Проверка, 12 ещё!"), ("", ""), ("ъъъ", "ъъъ"),
])
def test_dictionary_normalization(spark, given, wanted):
    lexicon = spark.createDataFrame(LEXICON, "word string, morph double, zipf double, ipm double")
    df = spark.createDataFrame([(given,), (given,)], ["t"])
    assert [r["normalized"] for r in spell.normalize_with(df, "t", lexicon).collect()] == [wanted, wanted]


def test_edits_are_all_and_in_order(spark):
    def made(word):
        abc, out = CYRILLIC.letters, []
        out += [word[:i] + word[i + 1 :] for i in range(len(word))]
        out += [word[:i] + c + word[i:] for i in range(len(word) + 1) for c in abc]
        out += [word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in abc if c != word[i]]
        out += [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1) if word[i] != word[i + 1]]
        return list(dict.fromkeys(x for x in out if x))

    df = spark.createDataFrame([(w,) for w in ("а", "аа", "ёлка", "проверка")], ["w"]).select("w", spell.edits(F.col("w")).alias("e"))
    for r in df.collect():
        assert r["e"] == made(r["w"])


def test_truth_evaluation_and_corpus(spark):
    manifest = spark.createDataFrame([(1, None, "а б"), (2, 2, "x"), (3, 2, "вг")], "ord int, page int, text string")
    results = spark.createDataFrame([(1, "А  Б", 0.5), (2, "в", 0.1), (9, "z", 0.2)], "page int, text string, latency_sec double")
    rows = evaluate.scored(results, evaluate.truth_of(manifest)).withColumns({"engine": F.lit("e"), "error": F.lit(None).cast("string")})
    assert {r["page"]: r["cer"] for r in rows.collect()} == {1: 0.0, 2: 0.5, 9: None}
    report = evaluate.engine_report(rows).first()
    assert (report["pages"], report["mean_cer"]) == (3, 0.25)
    with pytest.raises(Exception, match="no result for"):
        truth = spark.createDataFrame([("a.png", 1, "x")], "image string, page int, text string")
        evaluate.chapter_rows(spark.createDataFrame([], "image string, text string, certain boolean"), truth).collect()
    lines = spark.createDataFrame([(1, "Это  первая строка"), (2, "Это первая строка"), (3, "коротко"), (4, "latin letters only"), (5, None)], "seq int, text string")
    assert [tuple(r) for r in corpus.sentences(lines, "text", ["seq"]).collect()] == [(1, "Это первая строка")]
    n = corpus.numbered(spark.range(1000).selectExpr("id * 7 % 1000 as k"), ["k"]).collect()
    assert sorted((r["k"], r["index"]) for r in n) == [(k, k) for k in range(1000)]
