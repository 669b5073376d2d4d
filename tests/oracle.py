"""Runs a query and its SQL on the same tables and compares the rows."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def difference(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names, (columns, names)
    at = [columns.index(n) for n in names]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    return list((got - want).items())[:3], list((want - got).items())[:3], sum(want.values())
