"""Run registered queries against their SQL: ``python tests/compare.py [sf] [name ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, int):
        return value
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda t: tuple((v is None, str(type(v)), v) if v is not None else (True, "", "") for v in t))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, run, sql, sf_dir):
    t0 = time.time()
    df = run(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"{len(got[1])} rows (no SQL)", t1 - t0, 0.0
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if got == want:
        return True, f"{len(got[1])} rows", t1 - t0, t2 - t1
    note = f"columns {got[0]} vs {want[0]}" if got[0] != want[0] else f"{len(got[1])} vs {len(want[1])} rows"
    a, b = set(got[1]), set(want[1])
    return False, f"{note}\n   only spark: {sorted(map(str, a - b))[:3]}\n   only sql:   {sorted(map(str, b - a))[:3]}", t1 - t0, t2 - t1


def main():
    import __spark_entry__ as entry

    from factloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, note, a, b = compare(spark, con, name, run, oracle.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, note, a, b = False, f"{type(error).__name__}: {str(error)[:700]}", 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} spark {a:6.2f}s sql {b:6.2f}s {note}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
