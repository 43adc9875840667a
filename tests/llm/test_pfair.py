from collections import Counter, defaultdict

from sql import connect, same

from scriptoria.llm import op6_mix, pfair


def test_query_equals_its_sql(spark, sf_dir):
    assert same(op6_mix.run(spark, sf_dir), connect(sf_dir), op6_mix.ORACLE_SQL) == 200


def edf(units):
    """One period, slot by slot."""
    period, done, out = sum(units.values()), Counter(), []
    for t in range(period):
        ready = [k for k in units if done[k] < units[k] and done[k] * period // units[k] <= t]
        k = min(ready, key=lambda k: (-(-(done[k] + 1) * period // units[k]), k))
        out.append(k)
        done[k] += 1
    return out


def test_schedule_and_deviation(spark):
    for units in ({"a": 1}, {"a": 2, "b": 1, "c": 1}, {"a": 7, "b": 5, "c": 3, "d": 1, "e": 13}, {"a": 40, "b": 1}):
        plan = pfair.schedule(spark.createDataFrame(list(units.items()), "key string, units long")).collect()
        period = sum(units.values())
        order = {s: r["key"] for r in plan for s in r["slots"]}
        assert [order[t] for t in range(period)] == edf(units)
        got = Counter()
        for t in range(period):
            got[order[t]] += 1
            assert all(abs(got[k] - units[k] * (t + 1) / period) < 1 for k in units)


def test_blocks_sit_in_their_windows_and_all_rows_stay(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 11}", k % 7) for k in range(3000)] + [(k, None, 0) for k in range(5000, 5040)] + [(k, "", 0) for k in range(6000, 6003)] + [(1, "hot", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, block int")
    out = pfair.mix(df, digits=2).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((a, b) for a, b, _ in rows)
    taken = defaultdict(set)
    for r in out:
        assert r["release"] <= r["slot"] < r["deadline"]
        taken[r["slot"]].add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in taken.values())
    assert all(n <= pfair.BLOCK_ROWS for n in Counter((r["source"], r["block"]) for r in out).values())
    again = pfair.mix(df, digits=1).collect()
    assert Counter((r["doc_id"], r["slot"]) for r in again) == Counter((r["doc_id"], r["slot"]) for r in out)


def test_given_weights_order_and_empty(spark):
    df = spark.createDataFrame([(k, "a" if k < 64 else "b") for k in range(128)], "doc_id long, source string")
    weights = spark.createDataFrame([("=a", 3), ("=b", 1)], "key string, units long")
    out = pfair.mix(df, weights=weights)
    first = sorted({(r["slot"], r["source"]) for r in out.collect()})[:8]
    assert Counter(s for _, s in first) == {"a": 6, "b": 2}
    ordered = pfair.in_order(out)
    assert ordered.columns == ["doc_id", "source"] and ordered.count() == 128
    assert pfair.mix(df.where("false")).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op6_mix.run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "BroadcastNestedLoop"))


def test_clashing_names_null_ids_and_ties(spark):
    names = ["_key", "_digest", "_part", "_before", "_at", "_a", "_p", "_slots", "_tie", "_n"]
    rows = [(k if k % 4 else None, f"s{k % 3}", *([k] * len(names))) for k in range(400)] + [(1, "s1", *([9] * len(names)))] * 2
    df = spark.createDataFrame(rows, f"doc_id long, source string, {', '.join(f'{n} long' for n in names)}")
    out = pfair.mix(df, prefix="_m_")
    assert out.columns == [*df.columns, *("_m_" + c for c in pfair.ADDED)]
    got = out.collect()
    assert Counter(tuple(r)[: len(names) + 2] for r in got) == Counter(rows)
    again = pfair.mix(df.repartition(7), prefix="_m_", digits=3).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))  # ties have one order, whatever the partitions
    assert all(n <= pfair.BLOCK_ROWS for n in Counter((r["source"], r["_m_block"]) for r in got).values())
