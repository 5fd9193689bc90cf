"""Compare every registered Spark query with its DuckDB oracle SQL.

    python tests/oracle_check.py [sf_dir] [name ...]

Prints one line per query (rows, column names, order-insensitive value
match) and exits non-zero on any mismatch. Used by the test suite at sf0.001
and by hand at sf0.01.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


# Spark type name -> DuckDB type name of the same physical type.
_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, sf_dir: str, names: list[str] | None = None) -> list[tuple[str, bool, str]]:
    import __spark_entry__ as entry

    qs = entry.queries()
    sql = entry.oracle_sql()
    con = duck(sf_dir)
    results = []
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in sql:
            results.append((name, True, f"rows={len(s_rows)} (no oracle) spark={t1 - t0:.1f}s"))
            continue
        rel = con.sql(sql[name])
        d_cols = rel.columns
        d_rows = rel.fetchall()
        t2 = time.time()
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
        s_types = {c: _TYPES.get(t, t) for c, t in df.dtypes}
        d_types = {c: _TYPES.get(str(t), str(t)) for c, t in zip(d_cols, rel.dtypes)}
        if s_types != d_types:
            problems.append(f"types spark={s_types} duck={d_types}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        if not problems and _rows(s_cols, s_rows) != _rows(d_cols, d_rows):
            a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
            diff = next(i for i in range(len(a)) if a[i] != b[i])
            problems.append(f"values differ, first at sorted row {diff}: spark={a[diff]} duck={b[diff]}")
        ok = not problems
        info = f"rows={len(s_rows)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s " + "; ".join(problems)
        results.append((name, ok, info))
    return results


def main(argv: list[str]) -> int:
    from tricklens.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or None
    spark = local_session(8)
    bad = 0
    for name, ok, info in compare(spark, sf_dir, names):
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {info}", flush=True)
        bad += not ok
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
