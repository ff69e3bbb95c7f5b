"""Runs registered queries beside their SQL: the driver's comparison, for tests and by hand (python -m tests.oracle SF_DIR [NAME ...])."""

from __future__ import annotations

import sys
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def differences(spark, sf_dir: str, query, sql: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    got = query(spark, sf_dir)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {got.columns} and {want.columns}"
    a = Counter(tuple(map(plain, r)) for r in got.select(*want.columns).collect())
    b = Counter(tuple(map(plain, r)) for r in want.fetchall())
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only here {list(a - b)[:2]}; only there {list(b - a)[:2]}"[:900]


if __name__ == "__main__":
    import __spark_entry__ as e
    from tests.conftest import session

    spark = session()
    queries, sqls = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sqls:
        try:
            why = differences(spark, sys.argv[1], queries[name], sqls[name])
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:600]}"
        print(name, why or "same", flush=True)
