"""Compare a query with its SQL, as sorted rows with columns in order of name."""

import math
from pathlib import Path

import duckdb


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    res = con.sql(sql)
    assert sorted(df.columns) == sorted(res.columns)
    assert got == rows_of(res.columns, res.fetchall())
