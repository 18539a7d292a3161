"""Percentiles of many small groups move every different value a few times only; large groups give the same."""

from __future__ import annotations

import numpy as np
import pandas as pd

from framelake.operators import layout as L


def shuffled(spark) -> int:
    """Records that all stages so far have written for a shuffle."""
    store = spark._jsc.sc().statusStore()
    doubles = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Double.TYPE, 0)
    stages = store.stageList(None, False, False, doubles, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_small_groups_are_shuffled_twice(spark):
    rows = pd.DataFrame({"k": np.repeat(np.arange(200), 100), "v": np.random.default_rng(1).random(20_000)})
    df = spark.createDataFrame(rows)
    before = shuffled(spark)
    got = {r.k: r.p for r in L.percentiles(df, ["k"], "v", {"p": 0.3}).collect()}
    assert shuffled(spark) - before < 2.5 * len(rows)
    assert all(np.isclose(got[k], np.percentile(g, 30)) for k, g in rows.groupby("k")["v"])


def test_small_and_large_groups_agree(spark):
    rng = np.random.default_rng(2)
    rows = [("few", float(v)) for v in rng.integers(0, 40, 3_000)] + [("many", float(v)) for v in rng.normal(size=3_000)] + [("one", -0.0), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    asked = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 1.0}
    small, mixed, large = (sorted(map(tuple, L.percentiles(df, ["k"], "v", asked, few=n).collect())) for n in (10_000, 100, 0))
    assert small == mixed == large and [r[0] for r in small] == ["few", "many", "one"]
