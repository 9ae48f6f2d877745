"""Compare a query with its SQL over the same Parquet tables."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value that compares alike from both engines."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def by_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.sql(sql)
    return sorted(got.columns), table(list(got.columns), got.fetchall())


def by_spark(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), table(df.columns, df.collect())


def main(names: list[str]) -> int:
    import time

    import __spark_entry__ as entry
    from lemmaforge.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, wrong = local_session(), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or sorted(queries):
        began = time.time()
        try:
            columns, rows = by_spark(queries[name](spark, sf_dir))
            took = time.time() - began
            said = "rows only"
            if name in sql:
                expected = by_sql(sql[name], sf_dir)
                good = expected == (columns, rows)
                said = "ok" if good else f"WRONG {expected[0]} {len(expected[1])} {[x for x in zip(rows, expected[1]) if x[0] != x[1]][:2]}"
                wrong += not good
            print(f"{name}: {len(rows)} rows, {took:.1f} s, {said}", flush=True)
        except Exception as e:  # noqa: BLE001
            wrong += 1
            print(f"{name}: ERROR {str(e)[:1500]}", flush=True)
    return wrong


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    sys.exit(main(sys.argv[1:]))
