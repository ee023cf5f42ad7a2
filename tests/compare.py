"""Spark rows against DuckDB rows of the same tables, whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


def same_rows(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert len(ours) == len(theirs)
    assert [p for p in zip(ours, theirs, strict=True) if p[0] != p[1]][:3] == []
