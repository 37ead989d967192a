"""Run registered queries against their SQL on another engine: python tests/oracle_check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if isinstance(v, bool):
        return v
    if isinstance(v, pd.Timestamp) or str(type(v)).find("datetime") >= 0:
        return str(pd.Timestamp(v)) if not pd.isna(v) else None
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    if v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in data], key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_df, con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows_of(names, rel.fetchall())
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} vs {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows differ: {len(mine)} vs {len(theirs)}; first {mine[:2]} vs {theirs[:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        close = all(all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool)
                                   and abs(x - y) <= 1e-6 * max(1, abs(x))) for x, y in zip(a, b)) for a, b in bad)
        cols = sorted(names)
        diff = [(c, x, y) for c, x, y in zip(cols, *bad[0]) if x != y]
        return f"{'CLOSE ' if close else ''}{len(bad)}/{len(mine)} rows differ, e.g. {diff[:4]} in {bad[0][0][:6]}"
    return None


def main():
    import __spark_entry__ as entry
    from assayer.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    unknown = set(sqls) - set(queries)
    if unknown:
        print("SQL WITHOUT QUERY", unknown)
    fails = 0
    t_all = time.time()
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                why = compare(df, con, sqls[name])
                state = "ok" if why is None else f"MISMATCH {why}"
            else:
                n = df.count()
                state = f"rows-only {n}"
        except Exception as e:  # noqa: BLE001 - report and go on
            state = "ERROR " + str(e).split("JVM stacktrace")[0][:700]
        if not state.startswith(("ok", "rows")):
            fails += 1
        print(f"{name:28s} {time.time() - t0:6.2f}s {state}", flush=True)
    print(f"{fails} failing, {time.time() - t_all:.0f}s")


if __name__ == "__main__":
    main()
