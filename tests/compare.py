"""Run registered queries beside their SQL: ``python tests/compare.py [pattern] [sf]``."""

from __future__ import annotations

import math
import re
import signal
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int = 8) -> SparkSession:
    s = (SparkSession.builder.master(f"local[{cores}]").appName("framelake-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.local.dir", "/tmp").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(t: str) -> str:
    t = t.lower()
    if t in ("int", "integer", "bigint", "smallint", "tinyint"):
        return "int"
    if t.startswith("decimal") or t in ("double", "float"):
        return "float" if not t.startswith("decimal") else "decimal"
    if t in ("string", "varchar"):
        return "text"
    return t


def check(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in cols]).collect()
    took = time.time() - t0
    if sql is None:
        return took, f"rows {len(rows)} (no SQL)", True
    t0 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    order = [dcols.index(c) for c in sorted(dcols)]
    got = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    dtook = time.time() - t0
    if sorted(dcols) != cols:
        return took, f"columns differ: spark only {set(cols) - set(dcols)}, sql only {set(dcols) - set(cols)}", False
    mine = [tuple(norm(x) for x in r) for r in rows]
    a, b = Counter(mine), Counter(got)
    types = [(c, t, dtypes[c]) for c, t in df.dtypes if kind(t) != kind(dtypes[c]) and "array" not in t]
    note = f" TYPES {types}" if types else ""
    if a != b:
        x, y = list((a - b).items())[:2], list((b - a).items())[:2]
        return took, f"DIFFER {len(mine)} vs {len(got)} cols {cols}\n    spark {x}\n    sql   {y}{note}", False
    return took, f"ok {len(mine)} rows (sql {dtook:.2f}s){note}", not types


def main() -> int:
    import __spark_entry__ as E

    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf_dir = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark, con = session(), duck(sf_dir)
    q, o = E.queries(), E.oracle_sql()
    bad = 0

    def late(*_):
        raise TimeoutError("query took too long")

    signal.signal(signal.SIGALRM, late)
    for name, fn in q.items():
        if not re.search(pattern, name):
            continue
        signal.alarm(60)
        try:
            took, text, ok = check(spark, con, name, fn, o.get(name), sf_dir)
        except Exception as e:  # report and go on with the other queries
            took, text, ok = 0, f"ERROR {type(e).__name__} {str(e)[:700]}", False
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:42s} {took:6.2f}s {text}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
