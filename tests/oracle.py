"""Compare registered queries with DuckDB: ``python tests/oracle.py [sf] [names…]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, run, sql, folder) -> str | None:
    """None when equal, else a description of the first difference."""
    df = run(spark, folder)
    left_names, left = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    right_names, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first: {str(bad[0][0])[:400]} != {str(bad[0][1])[:400]}"
    types = [(n, type(a).__name__, type(b).__name__) for n, a, b in zip(left_names, left[0], right[0]) if type(a) is not type(b)] if left else []
    return f"types {types}" if types else None


def main() -> None:
    from tsalign.plans import ORACLES, QUERIES
    from tsalign.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), database(folder)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, name, QUERIES[name], ORACLES[name], folder)
            else:
                problem = None if QUERIES[name](spark, folder).count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(e))[:1500]
        if problem:
            failed.append(name)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - len(failed)} ok, {len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
