import random
from collections import Counter, defaultdict

import pytest

from scriptoria.llm import jaccard as J
from scriptoria.llm.components import components
from scriptoria.llm.op4_jaccard import run


def brute(rows, size, num, den):
    sets = {i: J.shingle_set(t, size) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        seen = Counter(j for x in s for j in holders[x])
        for j, both in seen.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def made_up(seed):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(30):
        base = [rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 60, 150]))]
        for _ in range(rng.choice([1, 3, 8, 40])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(pool)
            rows.append((len(rows) * 3 + 5, " ".join(w)))
    return rows + [(10**6 + k, x) for k, x in enumerate(["", None, " \t", "a", "A", "a b", "a B", "a b c"])]


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 8, 10), (2, 1, 2)])
def test_against_brute_force(spark, size, num, den):
    rows = made_up(size)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sid string")
    assert {r[0]: (r[1], r[2]) for r in J.near_duplicates(df, size, num, den).collect()} == brute(rows, size, num, den)


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "MANY", 8)  # parts are spread over slices
    monkeypatch.setattr(J, "HELD_ENTRIES", 300)  # buckets are taken in pieces
    monkeypatch.setattr(J, "PARTNERS", 7)
    rng = random.Random(9)
    pool = [f"w{k}" for k in range(200)]
    base = [rng.choice(pool) for _ in range(60)]
    rows = []
    for k in range(200):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = rng.choice(pool)
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in J.near_duplicates(df, 3, 90, 100).collect()} == brute(rows, 3, 90, 100)


def test_every_linked_pair_shares_a_kept_part():
    t = J.Threshold(8, 10)
    rng = random.Random(1)
    for forced in ({}, {"near": True}):
        bands = J.allocate(t, {n: 1000 for n in range(1, 200)})
        if forced:  # allocations that use one-deletion neighbourhoods
            bands = [J.Band(b.lo, b.hi, max(1, b.exact - 2 * 2), 2) if b.exact > 4 else b for b in bands]
        for _ in range(400):
            import numpy as np

            n = rng.randrange(2, 150)
            a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            b = np.unique(np.concatenate((a[rng.randrange(0, max(1, n // 8)) :], np.array([rng.getrandbits(64) for _ in range(rng.randrange(0, max(1, n // 8)))], np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(a) != len(b) or (a != b).any():
                if 10 * both >= 8 * (len(a) + len(b) - both):
                    assert set(J.signatures(a, bands, t).tolist()) & set(J.signatures(b, bands, t).tolist())


def test_one_deletion_segments_are_chosen_by_cost_and_change_no_result(spark, monkeypatch):
    t = J.Threshold(8, 10)
    assert not any(b.near for b in J.allocate(t, {n: 100 for n in range(1, 300)}))  # parts that hardly meet
    chosen = J.allocate(t, {n: 10**8 for n in range(1, 300)})
    assert any(b.near for b in chosen if b.hi < 20) and all(b.exact + 2 * b.near > J.most_differing(t, b.hi, b.hi) for b in chosen)
    often = {k: {c: (1000.0, 1e6 * 0.1**c) for c in J.LEVELS} for k in range(40)}  # measured: small parts meet very often, large ones rarely
    assert sum(b.near > 0 for b in J.allocate(t, {n: 10**4 for n in range(1, 300)}, often)) > 3
    # of 400 short texts with a common line, with the allocations of a table in which all parts meet often, and without one-deletion segments
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(40)]
    rows = [(k, "all rights reserved by us " + " ".join(rng.choice(pool) for _ in range(rng.randrange(3, 12)))) for k in range(150)]
    rows += [(1000 + k, x + rng.choice(["", " w1", " w2 w3"])) for k, x in rows]
    df, allocate, seen = spark.createDataFrame(rows, "doc_id long, text string"), J.allocate, []

    def forced(t, sizes, measured=None, near=True):
        bands = allocate(t, {n: c * 10**8 for n, c in sizes.items()}, None, forced.near)
        seen.append(any(b.near for b in bands))
        return bands

    monkeypatch.setattr(J, "allocate", forced)
    for forced.near in (True, False):
        assert {r[0]: (r[1], r[2]) for r in J.near_duplicates(df).collect()} == brute(rows, 5, 8, 10)
    assert seen == [True, False]


def test_hashed_probes_measure_parts():
    import numpy as np

    rng = np.random.default_rng(2)
    s = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    got = np.frombuffer(J.probes(s), "<u8").reshape(-1, 2)
    assert set(got[:, 0].tolist()) == set(J.LEVELS) and 10 < (got[:, 0] == 1).sum() < 70 and J.probes(s[:0]) == b""
    assert J.probes(s) == J.probes(s.copy())


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 120)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (5001, 5002), (5002, 5001)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(121)) and all(out[1000 + k] == 1000 for k in range(300)) and out[5001] == out[5002] == 5001 and 5000 not in out
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "y"), (7, "", None), (8, None, None), (None, "q r s", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = J.one_of_each(df)
    assert out.columns == df.columns and sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 7, 8]


def test_rows_without_an_id_and_clashing_names(spark):
    rows = [(None, "a b c d e f g", 1, "p"), (5, "a b c d e f g", 2, "p"), (None, "k l m n o p", 3, "q"), (None, "k l m n o p", 3, "q"), (None, "k l m n o p", 4, "q"), (9, "x y", 5, "r"), (9, "x z", 6, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept long, _text string").withColumnsRenamed({})
    kept = sorted((r["doc_id"] or -1, r["text"], r["_kept"]) for r in J.one_of_each(df).collect())
    assert [k[:2] for k in kept] == [(-1, "k l m n o p"), (5, "a b c d e f g"), (9, "x y"), (9, "x z")]
    assert J.one_of_each(df).columns == df.columns
    found = {(r["doc_id"], r["component_id"]) for r in J.near_duplicates(df).collect()}
    assert found == {(None, 5), (5, 5), (None, None), (9, 9)}


def test_query_and_empty_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r[0]: (r[1], r[2]) for r in run(spark, sf_dir).collect()} == brute(docs, 3, 90, 100)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(empty).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    from sql import connect, same

    from scriptoria.llm import op4_jaccard

    assert same(op4_jaccard.run(spark, sf_dir), connect(sf_dir), op4_jaccard.ORACLE_SQL) == 200
