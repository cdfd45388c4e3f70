"""Run a registered query in Spark and in DuckDB and compare rows, names and values."""

from __future__ import annotations

import glob
import math
import os
import signal
import sys
import time
from decimal import Decimal

import duckdb

ROOT = os.environ.get("STRATA_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, (int,)):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{cell(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, plan, sql):
    """(problem or None, number of rows, Spark seconds)."""
    start = time.time()
    df = plan(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, len(got), seconds
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), seconds
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got), seconds
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]}  names {sorted(names)}", len(got), seconds
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ducks = {d[0]: str(d[1]) for d in cur.description}
    for name, kind in kinds.items():
        duck = ducks[name].upper()
        if duck.startswith("DECIMAL") or duck.startswith("HUGEINT"):
            return f"oracle type of {name} is {duck}, Spark {kind}", len(got), seconds
    return None, len(got), seconds


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from strata.session import local_session

    sf = os.environ.get("SF", "0.01")
    sf_dir = f"{ROOT}/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in plans if not argv or any(n.startswith(a) for a in argv)]
    failed = []

    def too_long(*_):
        spark.sparkContext.cancelAllJobs()
        raise TimeoutError("query took too long")

    signal.signal(signal.SIGALRM, too_long)
    for name in names:
        signal.alarm(int(os.environ.get("QUERY_SECONDS", "40")))
        try:
            problem, rows, seconds = compare(spark, con, sf_dir, plans[name], sqls.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, rows, seconds = f"{type(exc).__name__}: {str(exc)[:700]}", -1, 0.0
        signal.alarm(0)
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={rows} {seconds:.2f}s"
              f"{'' if sqls.get(name) else ' (no oracle)'}{'' if problem is None else chr(10) + '     ' + problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
