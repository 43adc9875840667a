import numpy as np

from scriptoria.llm import langid
from scriptoria.llm.op10_langid import run


def test_held_out_accuracy(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()}
    out = run(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    assert len(out) == len(docs)
    held = [r for r in out if r["held_out"]]
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]
    assert len(held) > 200 and np.mean(right) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_document_frequencies_cover_all_rows(spark):
    texts = ["ab c", "ab", None, "12", "é", "ab c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got, n = langid.document_frequencies(df)
    wanted = np.zeros(langid.SIZE, np.int64)
    for t in texts:
        if (c := langid.counts(t)) is not None:
            wanted[c[0]] += 1
    assert n == 4 and (got == wanted).all()


def test_elastic_net_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    words = {"x": ["aba", "cad", "bab"], "y": ["zuz", "wuw", "cad"]}
    rows = []
    for k in range(300):
        lab = "xy"[k % 2]
        noisy = words["xy"[1 - k % 2]] if rng.random() < 0.2 else words[lab]
        rows.append((lab, langid.counts(" ".join(rng.choice(noisy, 6)))))
    df = np.zeros(langid.SIZE)
    for _, c in rows:
        df[c[0]] += 1
    model = langid.fit(rows, np.log((1 + len(rows)) / (1 + df)) + 1)
    assert (model.weights == 0).mean() > 0.99 and model.predict("aba bab aba")[0] == "x" and model.predict("wuw zuz")[0] == "y"
    assert 0.6 < model.predict("aba bab aba")[1] < 0.97  # a fifth of the labels is wrong


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "fr"), (4, "hello there", "en"), (5, "bonjour", None), (5, "bonjour", None), (None, "hello again", "en"), (6, "x" * 200_000, "fr")]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.train(df)
    out = langid.predict(df, model).collect()
    assert len(out) == len(rows) and [r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert langid.predict(df, langid.train(df.where("false"))).select("lang_pred").distinct().collect()[0][0] == "und"
    kept = langid.accept(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} <= {None, 4, 5, 6}
    assert langid.predict(df.where("false"), model).count() == 0


def test_junk_goes_and_clean_text_stays(spark, sf_dir):
    import random

    rng = random.Random(4)
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    keys = lambda letters, k: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 12))) for _ in range(k))
    junk = [keys("qwxzjkvbpfg0123456789", 30) for _ in range(20)] + [keys("абвгдежзиклмнопрст", 30) for _ in range(20)] + [keys("天地玄黄宇宙洪荒日月", 20) for _ in range(20)] + ["12 34", "!!", ""]
    planted = spark.createDataFrame([(10**6 + k, t, None, "junk", len(t)) for k, t in enumerate(junk)], docs.schema)
    kept = {r["doc_id"] for r in langid.accept(docs.unionByName(planted), langid.train(docs)).collect()}
    assert not any(10**6 + k in kept for k in range(20, len(junk))) and sum(10**6 + k in kept for k in range(20)) <= 2
    assert 0.98 * docs.count() <= len(kept & {r["doc_id"] for r in docs.collect()})


def test_prediction_against_plain_arithmetic(spark, sf_dir):
    import math

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    rows = docs.limit(25).collect()
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows), model).collect()}
    for r in rows:
        text = "".join(c if c.isalpha() else " " for c in r["text"].lower())
        text = " " + " ".join(text.split()) + " "
        grams: dict[int, int] = {}
        m32 = (1 << 32) - 1

        def mixed(x):
            x ^= x >> 15
            x = x * 668265263 & m32
            x ^= x >> 13
            return (x * 2654435761 & m32) >> 17

        c = list(map(ord, text))
        codes = [x * 2654435761 + 1 for x in c] + [a * 2246822519 + b * 3266489917 + 2 for a, b in zip(c, c[1:])] + [a * 3266489917 + b * 2654435761 + d * 2246822519 + 3 for a, b, d in zip(c, c[1:], c[2:])]
        for x in codes:
            grams[mixed(x & m32)] = grams.get(mixed(x & m32), 0) + 1
        x = {k: (1 + math.log(n)) * model.idf[k] for k, n in grams.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * model.weights[k][j] for k, v in x.items()) + model.weights[langid.SIZE][j]) / model.temperature for j in range(len(model.labels))]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(p)), key=lambda j: (p[j], -j))
        assert got[r["doc_id"]]["lang_pred"] == model.labels[best] and math.isclose(got[r["doc_id"]]["score"], p[best] / sum(p), rel_tol=1e-6)


def test_rows_without_ids_or_with_equal_ids_all_teach(spark):
    rows = [(None, f"the cat and the dog {k}", "en") for k in range(30)] + [(None, f"le chat et le chien {k}", "fr") for k in range(30)] + [(7, f"der hund und die katze {k}", "de") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.labels == ["de", "en", "fr"]
    out = langid.predict(df, model)
    assert out.join(df.select(df["text"].alias("t"), "lang").distinct(), out["lang_pred"] == df["lang"]).select("lang_pred").distinct().count() == 3
    assert (langid.train(df.repartition(5)).weights == model.weights).all()  # the same sample in the same order
