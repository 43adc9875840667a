"""Queries against a plain computation where their SQL twin does less than the whole job."""

import pytest

from scriptoria.plans import catalogue


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = row
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def comparable(s):
    return " ".join(s.lower().split())


@pytest.fixture
def tables(spark, tmp_path):
    def write(**data):
        for name, (rows, schema) in data.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_cer_reads_whole_texts(spark, tables):
    items = [(k, f"Item {k}: the quick brown fox\njumps over {k * 7} lazy dogs and is gone") for k in range(40)]
    docs = [(k, (f"page {k} " + "the quick brown fox jumps over lazy dogs; " * (k % 5)) + "é" * k) for k in range(80)]
    sf_dir = tables(benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    out = {r["doc_id"]: r for r in catalogue.QUERIES["cer_pairs"](spark, sf_dir).collect()}
    assert len(out) == len(docs) and max(len(t) for _, t in docs) > 200
    for k, text in docs:
        e = comparable(items[k % 40][1])
        d = distance(e, comparable(text))
        assert (out[k]["item_id"], out[k]["distance"], out[k]["cer"]) == (k % 40, d, round(d / len(e), 6))


def test_every_benchmark_item_is_compared(spark, tables):
    items = [(3 * k + 5, f"item {k} of many") for k in range(45)]
    docs = [(k, f"item {k % 45} of  Many") for k in range(90)]
    talks = [(k, 0, "user", t) for k, t in docs]
    sf_dir = tables(benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string"), conversations=(talks, "conv_id long, turn int, role string, text string"))
    out = catalogue.QUERIES["cer_pairs"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in out) == [(k, 3 * (k % 45) + 5, 0) for k in range(90)]
    report = catalogue.QUERIES["exact_match_rate"](spark, sf_dir).collect()
    assert [(r["pages"], r["exact_pages"], r["mean_cer"]) for r in report] == [(90, 90, 0.0)]


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def one_edit(w):
    """All strings at one edit, first come first."""
    n = len(w)
    made = [w[:i] + w[i + 1 :] for i in range(n)] + [w[:i] + c + w[i:] for i in range(n + 1) for c in LETTERS]
    made += [w[:i] + c + w[i + 1 :] for i in range(n) for c in LETTERS if c != w[i]]
    made += [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(n - 1) if w[i] != w[i + 1]]
    return list(dict.fromkeys(x for x in made if x))


#: One to 120 letters.
WORDS = ["a", "be", "the", "eight", "letters", "seventh", "international", "ternational", "nternational", "incomprehensibilities", "ncomprehensibilities", "a" * 120, "a" * 118, "xylophones", "ylophones"]


def test_edits_of_words_of_any_length(spark, tables):
    import hashlib

    sf_dir = tables(benchmark=([(k, w) for k, w in enumerate(WORDS)], "item_id long, text string"))
    out = {r["word"]: (r["n"], r["digest"]) for r in catalogue.QUERIES["edits_one"](spark, sf_dir).collect()}
    assert out == {w: (len(one_edit(w)), hashlib.md5(",".join(sorted(one_edit(w))).encode()).hexdigest()) for w in WORDS}


def test_words_of_any_length_are_corrected(spark, tables):
    import math

    counts = {w: 1 + k * 5 % 9 for k, w in enumerate(WORDS)}
    sf_dir = tables(benchmark=([(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())], "item_id long, text string"))
    out = {r["word"]: r["corrected"] for r in catalogue.QUERIES["spell_correct"](spark, sf_dir).collect()}
    morph = {w: min(1.0, n / 8) for w, n in counts.items()}
    wanted = {}
    for w in {w[1:] for w in WORDS}:
        base, best = morph.get(w, 0.0), (-1.0, w)
        for c in one_edit(w) if base < 0.2 else []:
            if c in morph:
                rank = 0.62 * morph[c] + 0.38 * min(1.0, math.log1p(counts[c] * 50) / 9) - 0.015 * abs(len(c) - len(w))
                best = max(best, (rank, c), key=lambda x: x[0])
        wanted[w] = best[1] if best[0] >= max(0.35, base + 0.15) else w
    assert out == wanted and any(len(w) > 12 and w != c for w, c in out.items())
