"""Run registered queries against their SQL and report differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        return round(float(v), 7)
    return v


def _family(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(_cell(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != columns:
        return f"columns differ: {columns} vs {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = [tuple(_cell(r[i]) for i in order) for r in cursor.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got.sort(key=key)
    want.sort(key=key)
    if got == want:
        for i, c in enumerate(columns):
            kinds = {_family(r[i]) for r in got if r[i] is not None} | {
                _family(r[i]) for r in want if r[i] is not None
            }
            if len(kinds) > 1:
                return f"types of {c} differ: {kinds}"
        return None
    a, b = set(got), set(want)
    return (
        f"{columns}: spark {len(got)} rows, sql {len(want)} rows; "
        f"only spark {len(a - b)} e.g. {sorted(a - b, key=key)[:2]}; "
        f"only sql {len(b - a)} e.g. {sorted(b - a, key=key)[:2]}"
    )


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pairwright.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8, memory="14g")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                problem = f"rows only: {fn(spark, sf_dir).count()}"
                print(f"---- {name} {problem} {time.time() - start:.1f}s", flush=True)
                continue
        except Exception as error:  # noqa: BLE001
            con = connect(sf_dir)
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
