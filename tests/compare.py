"""Run registered queries in Spark and their SQL twins in DuckDB and compare the rows.

usage: python tests/compare.py [sf_dir] [name ...]
"""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(x):
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(canon(i) for i in x) + "]"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, fn, sql, con=None):
    """(matches, seconds, message)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return len(got_rows) > 0, seconds, f"rows only: {len(got_rows)}"
    cur = (con or connect(sf_dir)).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, seconds, f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, got_rows)
    if got != want:
        extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return False, seconds, f"rows {len(got)} vs {len(want)}; columns {sorted(names)}; spark only {extra}; sql only {missing}"
    return True, seconds, f"{len(got)} rows"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from leaktrail.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            ok, sec, msg = compare(spark, sf, name, fn, sqls.get(name), con)
        except Exception as err:  # report and go on
            ok, sec, msg = False, 0.0, f"{type(err).__name__}: {str(err)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {sec:6.2f}s {name}: {msg}", flush=True)
    print("failures:", bad)
    sys.exit(bad > 0)
