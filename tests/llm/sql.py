"""DuckDB beside Spark."""

import math
import os

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def same(df, con, sql):
    def rows(names, data):
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(tuple(str(round(r[k], 6) if isinstance(r[k], float) and not math.isnan(r[k]) else r[k]) for k in order) for r in data)

    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, wanted = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cursor.fetchall())
    assert got == wanted, (len(got), len(wanted), [x for x in got if x not in wanted][:3], [x for x in wanted if x not in got][:3])
    return len(got)
