"""Votes whose scores are equal as real numbers, so that the last bit of a double decides."""

import itertools

import duckdb

from scriptoria.operators import vote
from scriptoria.plans import catalogue

#: Quantities of the three winning lines of either engine; each engine has one other line.
TIES = [((16, 22, 22), (7, 22, 31)), ((4, 25, 40), (1, 28, 40)), ((1, 7, 49), (7, 10, 40)), ((4, 10, 49), (7, 22, 34)), ((10, 10, 49), (7, 16, 46)), ((4, 31, 34), (7, 28, 34)), ((13, 22, 31), (16, 16, 34)), ((19, 19, 22), (10, 16, 34))]


def test_ties_are_decided_as_by_the_sql(spark, tmp_path):
    rows = []
    for k, sides in enumerate(TIES):
        for line, (flag, quantities) in enumerate(zip("AN", sides, strict=True), 1):
            rows += [(k, line, float(q), flag) for q in quantities] + [(k, line, 1.0, "R")]
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["l_orderkey"]: r["text"] for r in catalogue.ensemble_verdict(spark, str(tmp_path)).collect()}
    con = duckdb.connect(config={"threads": 1})  # sums in the order of the rows
    con.execute(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    wanted = dict(con.execute(f"select l_orderkey, text from ({catalogue.ORACLES['ensemble_verdict']})").fetchall())
    assert got == wanted and set(wanted.values()) == {"A", "N"}


def test_means_do_not_hang_on_the_order_of_rows(spark):
    schema = "crop long, seq int, key string, confidence double, row int"
    perms = list(itertools.permutations([(0, 0.1), (1, 0.2), (2, 0.3), (3, None)]))
    rows = [(k, 1, "x", c, at) for k, perm in enumerate(perms) for at, c in perm]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    assert {r["confidence"] for r in vote.consensus(df, "crop").collect()} == {0.7 * ((0.1 + 0.2 + 0.3) / 3) + 0.3}
    back = df.selectExpr("crop", "seq", "key", "confidence", "-row AS row")
    assert {r["confidence"] for r in vote.consensus(back, "crop", order="row").collect()} == {0.7 * ((0.3 + 0.2 + 0.1) / 3) + 0.3}
