"""Run queries next to their SQL: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import math
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, build, sql: str | None):
    """(rows, message); the message is empty when both sides agree."""
    df = build(spark, folder)
    got = df.collect()
    if sql is None:
        return len(got), ""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return len(got), f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a == b:
        return len(got), ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return len(got), (f"{len(a)} rows against {len(b)}; columns {sorted(df.columns)}\n   spark only {len(only_a)}: "
                      f"{only_a[:3]}\n   sql only {len(only_b)}: {only_b[:3]}")


def session():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").appName("compare").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, sqls = session(), duck(folder), entry.oracle_sql()
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            n, message = compare(spark, con, folder, entry.queries()[name], sqls.get(name))
        except Exception as e:
            n, message = -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(message)
        kind = "FAIL" if message else ("ok" if name in sqls else "rows")
        print(f"{kind:5}{name:32}{n:8} rows {time.time() - t0:6.2f}s {message}", flush=True)
    print(f"{bad} of {len(names)} differ")
    sys.exit(bool(bad))
