"""Runs a query and its oracle and compares the rows, in any order."""

import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        return repr(round(v + 0.0, 6)) if isinstance(v, float) else repr(v)

    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


def assert_equal(spark, sf_dir, run, sql):
    frame = run(spark, sf_dir)
    got = normal([tuple(r) for r in frame.collect()], frame.columns)
    result = connect(sf_dir).execute(sql)
    want = normal(result.fetchall(), [d[0] for d in result.description])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
