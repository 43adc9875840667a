import numpy as np
from pyspark.sql import functions as F

from scriptoria.llm import hnsw
from scriptoria.llm.op9_hnsw import run


def brute(ids, x, q_id, q, k=10):
    d = np.sqrt(((x.astype(np.float64) - q.astype(np.float64)) ** 2).sum(axis=1))
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != q_id][:k]


def test_query_recall_and_exact_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32)
    found = {}
    for r in run(spark, sf_dir).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11))
        wanted = brute(ids, x, q, x[ids == q][0])
        hits += len({w[0] for w in wanted} & {g[1] for g in got})
        scores = dict(brute(ids, x, q, x[ids == q][0], len(ids)))
        assert all(abs(scores[g[1]] - g[2]) < 1e-12 for g in got)
    assert hits >= 0.9 * 10 * len(found)


def test_graph_recall_and_flat_arrays():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    g = hnsw.Graph(x).build()
    again = hnsw.Graph.load(g.arrays(), x)
    hits = 0
    for q in rng.normal(size=(40, 24)).astype(np.float32):
        assert g.find(q) == again.find(q)
        hits += len(set(g.find(q)[:10]) & set(np.argsort(((x - q) ** 2).sum(axis=1))[:10].tolist()))
    assert hits >= 0.9 * 400
    assert all((d <= links.shape[1]).all() for d, links in zip(g.degree, g.links, strict=True))


def test_copies_ties_and_unfit_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(0, 400)] + [(k, rng.normal(size=3).tolist()) for k in range(400, 700)]
    rows += [(1000, None), (1100, [0.0, 0.0, 0.0]), (1200, [1.0, None, 2.0]), (1300, [float("nan"), 1.0, 1.0]), (1400, [float("inf"), 1.0, 1.0]), (1500, [1.0, 2.0]), (1501, [1.0, 3.0]), (None, [1.0, 1.0, 1.0]), (100, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    out = {}
    for r in hnsw.nearest(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(out) == {0, 100, 200, 300, 400, 500, 600, 1500}
    assert [v for v, _ in out[100]] == list(range(10)) and all(s == 0 for _, s in out[100])
    assert [v for v, _ in out[0]] == list(range(1, 11))
    assert out[1500] == [(1501, 1.0)]
    assert hnsw.nearest(df.where("false"), F.col("id") % 100 == 0).count() == 0


def test_several_shards_and_query_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(600)], "id long, v array<float>")
    index = hnsw.build(df, 4)
    assert index.count() == 4
    got = {}
    for r in hnsw.search(index, df.where("id % 20 = 0"), 4, 3).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(got) == 30
    hits = sum(len(v & {w[0] for w in brute(np.arange(600), x, q, x[q])}) for q, v in got.items())
    assert hits >= 0.95 * 300


def test_recall_over_full_shards(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(50, 16))
    n = 2 * hnsw.LEAST + 500
    x = (centres[rng.integers(0, 50, n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)
    assert hnsw.shard_count(n) == 3
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(n)], "vec_id long, embedding array<float>")
    got = {}
    for r in hnsw.nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(v & {w[0] for w in brute(np.arange(n), x, q, x[q])}) for q, v in got.items())
    assert len(got) == -(-n // 100) and hits >= 0.95 * 10 * len(got)


def test_doubles_are_measured_as_they_are(spark):
    rng = np.random.default_rng(5)
    for size in (1.0, 1e-200, 1e200):
        x = size * (1 + 1e-10 * rng.normal(size=(300, 4)))  # all alike in single precision
        x[:150] *= rng.normal(size=(150, 1))
        df = spark.createDataFrame([(k, x[k].tolist()) for k in range(300)], "vec_id long, embedding array<double>")
        out = {}
        for r in hnsw.nearest(df, F.col("id") == 0).orderBy("rank").collect():
            out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        exact = {i: float(np.linalg.norm((x[i] - x[0]) / size) * size) for i in range(300)}
        assert len(out[0]) == 10 and all(abs(d - exact[i]) <= 1e-9 * d for i, d in out[0])


def test_an_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r["query_id"], r["rank"], r["vec_id"]) for r in hnsw.nearest(df, F.col("id") == 0, k=2).collect()]
    assert sorted(out) == [(0, 1, 1), (0, 1, 2), (0, 2, 2), (0, 2, 1)] or sorted(out) == sorted([(0, 1, 1), (0, 1, 2), (0, 2, 1), (0, 2, 2)])
