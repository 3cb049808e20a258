"""Run registered queries in Spark and their oracles in DuckDB and compare all rows.

    python tests/compare.py [--sf 0.001] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import signal
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from repeatwise.fixtures import BASE_TABLES  # noqa: E402

DATA = "/root/testdata"
LIMIT = 120  # seconds per query


def _late(*_):
    raise TimeoutError(f"over {LIMIT} s")


signal.signal(signal.SIGALRM, _late)


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, (int, Decimal)):
        return str(int(v)) if v == int(v) else repr(float(v))
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return repr(v)
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, con, sf_dir, name, run, sql):
    """(ok, message)"""
    cols, got = spark_rows(run(spark, sf_dir))
    if sql is None:
        return True, f"rows only: {len(got)}"
    dcols, want = duck_rows(con, sql)
    if cols != dcols:
        return False, f"columns {cols} != {dcols}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return False, f"{len(got)} rows != {len(want)}; only spark {extra[0]} only duck {extra[1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        diff = [(c, a, b) for c, a, b in zip(cols, *bad[0]) if a != b]
        return False, f"{len(bad)} of {len(got)} rows differ, first {diff}"
    return True, f"{len(got)} rows equal"


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    import __spark_entry__ as entry
    from repeatwise.session import build_session

    spark = build_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, run in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        signal.alarm(LIMIT)
        try:
            ok, message = compare(spark, con, sf_dir, name, run, oracles.get(name))
        except Exception as e:  # report and go on with the next query
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        signal.alarm(0)
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {message}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
