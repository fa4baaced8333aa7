"""Run registered queries against DuckDB: ``python -m tests.compare sf0.01 [names]``."""

from __future__ import annotations

import sys
import tempfile
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='duck-')}'")
    con.execute("SET memory_limit = '6GB'")
    con.execute("SET max_temp_directory_size = '2GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(r[i] for i in order) for r in rows)


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def difference(df, con, sql: str) -> str | None:
    """None if equal in names, types and rows, else what differs."""
    want_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    got_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    if got_types != want_types:
        return f"types {got_types} != {want_types}"
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = _rows(want_names, cur.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got != want:
        only_got, only_want = got - want, want - got
        return (
            f"{sum(got.values())} vs {sum(want.values())} rows, {sum(only_got.values())} differ\n"
            f"  spark {list(only_got)[:2]}\n  duck  {list(only_want)[:2]}"
        )
    return None if got else "empty result"


def main() -> int:
    from tests.conftest import session
    from helio_spark.catalog import QUERIES, SQL

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = session(), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in SQL:
                problem = difference(df, con, SQL[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'OK ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
