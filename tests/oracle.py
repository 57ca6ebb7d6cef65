"""Compare a query with its SQL, whatever the order of rows and columns."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted(repr([value(r[c]) for c in order]) for r in df.collect())
    assert got == sorted(repr([value(r[names.index(c)]) for c in order]) for r in want)
