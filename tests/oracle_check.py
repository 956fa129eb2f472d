"""Compare queries with their SQL: python tests/oracle_check.py [sf folder] [name part ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", int(v))
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else ("n", v + 0.0)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(plain(x) for x in v))
    return ("s", str(v))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, folder):
    started = time.time()
    df = run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return f"rows only  {name}: {len(rows)} rows, {took:.1f}s", len(rows) > 0
    cur = con.execute(sql)
    want_names, want = table([d[0] for d in cur.description], cur.fetchall())
    got_names, got = table(df.columns, rows)
    if want_names != got_names:
        return f"COLUMNS    {name}: {got_names} != {want_names}", False
    if got == want:
        return f"ok         {name}: {len(rows)} rows, {took:.1f}s", True
    extra = sorted(set(got) - set(want))[:3]
    missing = sorted(set(want) - set(got))[:3]
    differ = sum(1 for a, b in zip(got, want) if a != b)
    return (
        f"MISMATCH   {name}: {len(got)} vs {len(want)} rows, {differ} differ, {took:.1f}s\n"
        f"   columns {want_names}\n   spark only {extra}\n   sql only   {missing}"
    ), False


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry

    from metricwatch.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    sqls, bad = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            line, ok = compare(spark, con, name, run, sqls.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            line, ok = f"ERROR      {name}: {str(error)[:1500]}", False
        print(line, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
