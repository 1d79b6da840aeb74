"""Compare every query with its SQL counterpart, value by value and without regard to order.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() and abs(v) < 2**53 else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sql, sf_dir) -> tuple[str, int]:
    """An empty text when both agree, else what differs; and the row count."""
    df = query(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {set(got_names) ^ set(want_names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if not bad:
        return "", len(got)
    g, w = bad[0]
    cells = [(n, a, b) for n, a, b in zip(got_names, g, w) if a != b]
    return f"{len(bad)} rows differ, first: {str(cells)[:600]}", len(got)


def main() -> int:
    import __spark_entry__ as entry
    from tests.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                text, n = difference(spark, con, queries[name], oracles[name], sf_dir)
            else:
                text, n = "", len(queries[name](spark, sf_dir).collect())
        except Exception as error:  # report and go on with the next query
            text, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        failed += bool(text)
        print(f"{'FAIL' if text else 'ok  '} {name:32s} {n:7d} rows {time.time() - start:6.2f}s {'' if name in oracles else '(no sql) '}{text}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree; without sql: {sorted(set(queries) - set(oracles))}; without query: {sorted(set(oracles) - set(queries))}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
