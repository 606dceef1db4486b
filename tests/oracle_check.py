"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/oracle_check.py [name ...]     (CHECK_SF_DIR, default sf0.01)
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x) -> str:
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{round(x, 6):.6f}"
    return str(x)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    frame = fn(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    if sql is None:
        return True, f"rows only: {len(got)}"
    start = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    took = f" (sql {time.time() - start:.1f}s)"
    if sorted(frame.columns) != sorted(columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if got == want:
        return True, f"{len(got)} rows equal{took}"
    only_spark = [r for r in got if r not in set(want)][:3]
    only_sql = [r for r in want if r not in set(got)][:3]
    return False, f"{len(got)} vs {len(want)} rows; spark {only_spark} sql {only_sql}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from offermend.session import local_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(8), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv or queries:
        start = time.time()
        try:
            ok, text = compare(spark, con, name, queries[name], oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - a report tool goes on to the next query
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {time.time() - start:6.1f}s {text}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
