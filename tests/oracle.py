"""Spark rows against DuckDB rows of the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if hasattr(v, "asDict"):
        return str({k: norm(x) for k, x in v.asDict().items()})
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def duck_rows(sql, sf_dir, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, [dict(zip(names, r)) for r in cur.fetchall()]


def assert_same(df, sql, sf_dir, tables=TABLES):
    names, expected = duck_rows(sql, sf_dir, tables)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(norm(r[c]) for c in cols) for r in expected)
    assert got == want
