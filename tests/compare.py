"""Run registered queries beside their DuckDB statements and compare the rows.

usage: python tests/compare.py [-d DIR] [name or prefix ...]"""

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(cpus="8"):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{cpus}]").appName("tapelib")
         .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return repr(float(v))
    if isinstance(v, float):
        return repr(v + 0.0) if v != 0 else "0.0"
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    got = df.collect()
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns differ: {sorted(df.columns)} vs {sorted(cols)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return None, len(got)
    sa, sb = set(a), set(b)
    return (f"rows {len(a)} vs {len(b)}; order {sorted(cols)}\n   spark only {[x for x in a if x not in sb][:3]}"
            f"\n   duck only  {[x for x in b if x not in sa][:3]}"), len(got)


if __name__ == "__main__":
    import __spark_entry__ as E
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        sf, args = args[1], args[2:]
    spark, con = session(), duck(sf)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(q):
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in o:
                err, n = compare(spark, con, sf, q[name], o[name])
            else:
                n, err = q[name](spark, sf).count(), None
            status = "ok  " if not err else "FAIL"
        except Exception as e:  # report and go on
            err, n, status = repr(e)[:1500], -1, "ERR "
        bad += bool(err)
        print(f"{status} {name} rows={n} {'oracle' if name in o else 'rows-only'} {time.time()-t:.1f}s", flush=True)
        if err:
            print("   ", err, flush=True)
    print("bad:", bad)
