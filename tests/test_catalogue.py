import math
import os

import duckdb
import pytest

from scriptoria.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(round(r[k], 6) if isinstance(r[k], float) and not math.isnan(r[k]) else str(r[k]) for k in order) for r in data) if data else []


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    wanted = rows(names, cursor.fetchall())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in wanted]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def split_plainly(word, lexicon):
    """The best of all ways to cut the word, tried one by one."""
    ones, short = "авикосуя", set("а в и к о с у я же не но на по из за от до ко со".split())

    def worth(piece):
        if len(piece) == 1:
            return 0.10 if piece in ones else None
        morph, freq = lexicon.get(piece, (0.0, 0.0))
        if (morph <= 0 and freq < 0.5) or (len(piece) < 4 and not (piece in short and freq >= 0.5)):
            return None
        return 0.55 * min(1.0, morph / 0.5) + 0.45 * freq

    def ways(rest, first):
        if not rest:
            yield 0.0, []
        for k in range(1, min(20, len(rest)) + 1):
            if (v := worth(rest[:k])) is not None:
                for total, pieces in ways(rest[k:], False):
                    yield total + v - (0 if first else 1.35 if k == 1 else 0.95), [rest[:k], *pieces]

    best = max(ways(word, True), key=lambda w: w[0], default=None)
    return " ".join(best[1]) if best and best[0] >= (worth(word) if worth(word) is not None else -1.0) + 0.25 else word


def test_fused_words_against_all_ways_to_cut_them(spark):
    import math

    from scriptoria.operators import spell

    words = {"какая": (1.0, 900.0), "ужасная": (1.0, 400.0), "же": (1.0, 9000.0), "последний": (1.0, 500.0), "воин": (1.0, 300.0), "человечества": (1.0, 300.0), "на": (1.0, 20000.0), "стол": (1.0, 800.0), "столе": (0.6, 50.0), "кот": (1.0, 700.0), "дома": (0.9, 900.0), "домашний": (0.1, 90.0)}
    lexicon = spark.createDataFrame([(w, m, 0.0, i) for w, (m, i) in words.items()], "word string, morph double, zipf double, ipm double")
    fused = ["какаяжеужасная", "последнийвоинчеловечества", "котнастоле", "настолекот", "домавоинстол", "домашний", "ыыыыыыыыыы", "столнастоле", "воинидома", "а" * 12, "человечества"]
    scores = {w: (m, min(1.0, math.log1p(i) / 9)) for w, (m, i) in words.items()}
    got = {r["word"]: r["pieces"] for r in spell.segmented(spark.createDataFrame([(w,) for w in fused], "word string"), lexicon).collect()}
    for w in fused:
        good = w in scores and scores[w][0] >= 0.2 and scores[w][1] >= 0.16
        assert got[w] == (w if len(w) < 9 or good else split_plainly(w, scores)), w
    assert got["какаяжеужасная"] == "какая же ужасная"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(catalogue.QUERIES) <= set(e.queries()) and os.path.exists(e.__file__)
