"""Runs a query and its SQL on the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str([text(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def check(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(text(v) for v in r) for r in df.select(*columns).collect())
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    assert sorted(found) == columns, name
    theirs = sorted(tuple(text(r[found.index(c)]) for c in columns) for r in cur.fetchall())
    assert ours == theirs, name
