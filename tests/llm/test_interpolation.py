import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptoria.llm import interpolation as I
from scriptoria.llm.common import crc_mod
from scriptoria.llm.op7_lm import run

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


def brute(rows):
    """Counts, weights and scores in plain Python; the weights from the exact estimates, without a histogram."""
    uni, bi, kept_uni, kept_bi = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if fold(i) == 2:
            continue
        w = tokens(t)
        for u, b in [(uni, bi)] + [(kept_uni, kept_bi)] * (fold(i) != 3):
            u.update(w)
            u["<s>"] += 1
            b.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()) - uni["<s>"], len([k for k in uni if k != "<s>"])
    kn, kv = sum(kept_uni.values()) - kept_uni["<s>"], len([k for k in kept_uni if k != "<s>"])

    def estimates(u, b, total, w):
        return [(int(I.context_bucket(np.array([u[p]]))[0]), b[p, x] / max(u[p], 1), u[x] / max(total, 1)) for p, x in zip(["<s>", *w], w, strict=False)]

    held = [e for i, t in rows if fold(i) == 3 for e in estimates(kept_uni, kept_bi, kn, tokens(t))]
    weights = {}
    for b in range(I.BUCKETS):
        mine = [e for e in held if e[0] == b] or held
        f = np.array([(x, y, 1 / (kv + 1)) for _, x, y in mine])
        lam = np.array([0.4, 0.5, 0.1])
        for _ in range(60):
            part = f * lam
            lam = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        weights[b] = (lam + 1e-6) / (lam + 1e-6).sum()
    out = []
    for i, t in rows:
        w = tokens(t)
        score = sum(math.log10(weights[b] @ np.array([x, y, 1 / (v + 1)])) for b, x, y in estimates(uni, bi, n, w))
        out.append((i, fold(i) == 2, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), score))
    return out


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = {r[0]: r for r in brute(rows)}
    got = {r["doc_id"]: tuple(r) for r in run(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, w in wanted.items():
        assert got[i][:5] == w[:5]
        assert got[i][5] == pytest.approx(w[5], rel=1e-9) and got[i][6] == pytest.approx(w[6], rel=2e-2)
    held = [g for g in got.values() if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # better than the base where it counts


def test_chunks_do_not_change_the_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    f = crc_mod("doc_id", 7)
    one = {r[0]: r for r in I.score(docs, f == 2, f == 3).collect()}
    many = {r[0]: r for r in I.score(docs, f == 2, f == 3, chunk_bytes=40_000).collect()}
    for i, r in one.items():
        assert tuple(r)[:5] == tuple(many[i])[:5] and many[i][5] == pytest.approx(r[5]) and many[i][6] == pytest.approx(r[6], rel=1e-6)


def test_probabilities_add_up_to_one():
    g = I.Grams(["a b a", "b c"])
    uni, bi = g.counts(np.array([True, True]))
    names = ["a", "b", "c", None]
    total, types = 7, 4
    w = np.array([0.5, 0.3, 0.2])
    u = Counter({"a": 2, "b": 2, "c": 1, None: 2})
    b = Counter(zip(["<s>", "a", "b", "a", "<s>", "b", "c"], ["a", "b", "a", None, "b", "c", None], strict=True))
    assert sorted(uni.tolist()) == sorted([*u.values(), 2]) and sorted(bi.tolist()) == sorted(b.values())
    for v in ("a", "b", "c"):
        p = sum(w[0] * b[v, x] / u[v] + w[1] * u[x] / total + w[2] / (types + 1) for x in names) + w[2] / (types + 1)
        assert p == pytest.approx(1)


def test_edge_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x " * 50_000), (3, "É é \xa0x\x0by"), (4, "\t\n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, chunk string")
    f = crc_mod("doc_id", 7)
    out = I.score(df, f == 2, f == 3).collect()
    assert sorted(r["n_tokens"] for r in out) == sorted(len(tokens(t)) for _, t in rows)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert I.score(df.where("false"), f == 2, f == 3).count() == 0
    none = I.score(df, f >= 0, f == 3).collect()
    assert len(none) == len(rows) and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)


def test_probabilities_add_up_to_one():
    import math
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)]
    uni, bi, rows = Counter(), Counter(), len(texts)
    for t in texts:
        w = [None, *t.split(), "END"]
        uni.update(w[1:])
        bi.update(zip(w, w[1:]))
    total, types = sum(uni.values()), len(uni)
    for cells in ([], [((5 * I.GRID + 3) * I.GRID + 7, 10, 2.0, 1.0)], [((0 * I.GRID + 0) * I.GRID + 7, 10, 0.0, 1.0), ((4 * I.GRID + 9) * I.GRID + 7, 50, 20.0, 3.0)]):
        weights = I.maximise(cells, types)
        assert weights[0, 0] == 0 and np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()
        for context, count in [(None, rows), *uni.items(), ("unseen", 0)]:
            if context == "END":
                continue
            w = weights[int(I.context_bucket(np.array([count]))[0])]
            mass = sum(w[0] * bi[context, x] / max(count, 1) + w[1] * uni[x] / total + w[2] / (types + 1) for x in [*uni, "an unseen word"])
            assert math.isclose(mass, 1.0, rel_tol=1e-9)


def test_the_level_in_between_changes_no_count(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = crc_mod("doc_id", 7)
    found = []
    for direct in (I.DIRECT, 2):
        monkeypatch.setattr(I, "DIRECT", direct)
        found.append({r["doc_id"]: tuple(r) for r in I.score(docs, fold == 2, fold == 3, chunk_bytes=20_000).collect()})
    assert len(found[0]) == docs.count() and found[0].keys() == found[1].keys()
    for a, b in ((found[0][k], found[1][k]) for k in found[0]):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-12) and math.isclose(a[6], b[6], rel_tol=1e-9)
