"""Percentiles agree with the comparison engine to the last bit."""

from __future__ import annotations

import duckdb
import numpy as np

from framelake.operators import layout as L


def test_neighbours_that_differ_in_the_last_bit(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in enumerate([10, 18, 59, 64, 898, 937, 944, 955, *rng.integers(20, 900, 20).tolist()]):
        base = np.round(rng.lognormal(2, 1, n), 2)
        at = int(np.floor(0.85 * (n - 1)))
        base.sort()
        base[at + 1] = np.nextafter(base[at], np.inf)  # the two values around the percentile
        rows += [(k, float(v)) for v in base]
    got = {r.k: r.p for r in L.percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"p": 0.85}).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE t (k INT, v DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert got == dict(db.execute("SELECT k, quantile_cont(v, 0.85) FROM t GROUP BY k").fetchall())
