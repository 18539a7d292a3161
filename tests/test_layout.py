"""Chunked forms against plain loops: results must not depend on the chunk length."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from framelake.operators import folds, layout as L, trajectories as TR


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(5)
    rows = []
    for v, n in ((1, 53), (2, 20), (3, 1)):
        p = np.cumsum(rng.normal(size=(n, 3)) + [0, 0, 0.4], axis=0)
        rows += [(v, i, *map(float, p[i])) for i in range(n)]
    return pd.DataFrame(rows, columns=["video_name", "frame_order", "cx", "cy", "cz"])


def as_spark(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("frame_order", F.col("frame_order").cast("int"))


def test_position_over_buckets(spark):
    rows = [(k, float(v)) for k in "ab" for v in random.Random(1).sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = L.with_position(df, ["k"], ["v"], F.floor(F.col("v") / 37), "p").toPandas()
    want = pd.DataFrame(rows, columns=["k", "v"])
    want["p"] = want.groupby("k")["v"].rank().astype(int) - 1
    assert got.sort_values(["k", "v"])["p"].tolist() == want.sort_values(["k", "v"])["p"].tolist()


def test_running_and_neighbourhood(spark, walk):
    df = as_spark(spark, walk)
    got = L.running(df, ["video_name"], "frame_order", {"s": ("sum", F.col("cx")), "m": ("max", F.col("cx"))}, chunk=7)
    got = L.neighbourhood(got, ["video_name"], "frame_order", 2, 3, lambda w: {"near": F.sum("cx").over(w.rowsBetween(-2, 3))}, chunk=7)
    g = got.toPandas().sort_values(["video_name", "frame_order"]).reset_index(drop=True)
    for _, part in g.groupby("video_name"):
        x = part["cx"].to_numpy()
        assert np.allclose(part["s"], np.cumsum(x)) and np.allclose(part["m"], np.maximum.accumulate(x))
        assert np.allclose(part["near"], [x[max(0, i - 2): i + 4].sum() for i in range(len(x))])


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = {"even": np.arange(101.0), "tied": np.repeat([1.0, 2.0, 9.0], [50, 3, 1]), "long": rng.exponential(size=500) ** 4, "one": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in vals.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in L.percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, bins=16).collect()}
    for k, vs in vals.items():
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], np.percentile(vs, [5, 50, 95]))


def test_salted_lookup_keeps_rows(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, n string")
    got = L.lookup(big, small, ["k"], F.col("id"))
    assert got.count() == 1000 and got.filter("n IS NULL").count() == 333
    assert L.lookup(big, small, ["k"], F.col("id"), "inner").count() == 667


def _loop(rows, axis, mid, min_cos=-0.1, lo=0.25, hi=2.0, alpha=0.2):
    ref, out = np.array(axis), []
    for s in rows:
        n = np.linalg.norm(s)
        if n <= 1e-8 or s @ ref / n < min_cos:
            out.append(ref * mid)
            continue
        out.append(s / n * np.clip(n, lo * mid, hi * mid))
        new = (1 - alpha) * ref + alpha * s / n
        ref = new / np.linalg.norm(new)
    return np.array(out)


@pytest.mark.parametrize("chunk", [5, 1000])
def test_rebuild_equals_sequential_pass(spark, walk, chunk):
    st = TR.steps(as_spark(spark, walk), chunk=chunk)
    got = TR.rebuild_steps(st, TR.progress_axis(st, "first_valid"), TR.step_scale(st), chunk=chunk).toPandas()
    for v, part in walk.groupby("video_name"):
        c = part.sort_values("frame_order")[["cx", "cy", "cz"]].to_numpy()
        if len(c) < 2:
            continue
        s = np.diff(c, axis=0)
        n = np.linalg.norm(s, axis=1)
        want = _loop(s, s[0] / n[0], np.median(n))
        mine = got[got["video_name"] == v].sort_values("frame_order")[["nx", "ny", "nz"]].to_numpy()
        assert np.allclose(mine, want, atol=1e-12)


def test_fold_carries_state_over_chunks(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))

    def fold(pdf, state):
        total = pdf["v"].cumsum() + state[0]
        return pd.DataFrame({"t": total}), (float(total.iloc[-1]),)

    start = spark.createDataFrame([(1, 10.0)], "k int, s double")
    got = folds.chunked_fold(df, ["k"], "i", start, ["s"], fold, T.StructType([T.StructField("t", T.DoubleType())]), chunk=9).toPandas()
    assert np.allclose(got.sort_values("i")["t"], 10 + np.cumsum(np.arange(100)))


@pytest.mark.parametrize("reverse", [False, True])
def test_products_over_chunks(spark, reverse):
    rng = np.random.default_rng(0)
    ms = []
    for _ in range(23):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        ms.append(np.column_stack([q, rng.normal(size=3)]))
    df = spark.createDataFrame([(1, i, [float(x) for x in m.reshape(-1)]) for i, m in enumerate(ms)], "k int, i int, m array<double>")
    got = folds.scan_products(df, ["k"], "i", "m", reverse=reverse, chunk=4).toPandas().sort_values("i")["total"].tolist()
    acc = np.eye(4)
    for g, m in zip(got, ms):
        full = np.vstack([m, [0, 0, 0, 1]])
        acc = full @ acc if reverse else acc @ full
        assert np.allclose(np.array(g).reshape(3, 4), acc[:3])


def test_moving_average_mirrors_short_sequences(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(3)], "video_name int, frame_order int, v double")
    got = TR.moving_average(df, ["v"], 9, chunk=2).toPandas().sort_values("frame_order")["v_mean"].tolist()
    x = np.pad(np.array([0.0, 1.0, 4.0]), 4, mode="symmetric")
    assert np.allclose(got, [x[i: i + 9].mean() for i in range(3)])


def test_same_side_push_small_chunks(spark, walk):
    pts = as_spark(spark, walk)
    rng = np.random.default_rng(9)
    n = rng.normal(size=(len(walk), 3)) + [0, 0, 1]
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    nd = walk[["video_name", "frame_order"]].assign(qx=n[:, 0], qy=n[:, 1], qz=n[:, 2])
    normals = as_spark(spark, nd)
    st = TR.steps(pts)
    axis, least = TR.progress_axis(st), TR.step_scale(st).select("video_name", (F.col("median_step") * 0.1).alias("min_step"))
    got = TR.push_same_side(pts, normals, axis, least, chunk=6).toPandas()
    for v, part in walk.groupby("video_name"):
        c = part.sort_values("frame_order")[["cx", "cy", "cz"]].to_numpy().copy()
        if len(c) < 2:
            continue
        q = nd[nd["video_name"] == v].sort_values("frame_order")[["qx", "qy", "qz"]].to_numpy()
        first = c[1] - c[0]
        ref, m = first / np.linalg.norm(first), 0.1 * np.median(np.linalg.norm(np.diff(c, axis=0), axis=1))
        for i in range(len(c) - 1):
            back = (-ref if i == 0 else c[i - 1] - c[i]) @ q[i]
            ahead = (c[i + 1] - c[i]) @ q[i]
            if abs(back) > 1e-8 and abs(ahead) > 1e-8 and back * ahead >= 0:
                c[i + 1:] += (-np.sign(back) * m - ahead) * q[i]
        mine = got[got["video_name"] == v].sort_values("frame_order")[["cx", "cy", "cz"]].to_numpy()
        assert np.allclose(mine, c, atol=1e-9)


@pytest.mark.parametrize("kind", ["affine", "clamp", "states"])
def test_effects_compose_over_chunks(spark, kind):
    rng, rows, want = np.random.default_rng(4), [], {}
    for k in range(4):
        x = {"affine": 2.0, "clamp": 0.5, "states": 1}[kind]
        for i in range(150):
            if k == 2 and 20 <= i < 60:
                continue  # chunks without rows
            if kind == "affine":
                e = [rng.uniform(-1.05, 1.05), rng.normal()]
                x = e[0] * x + e[1]
            elif kind == "clamp":
                low = rng.normal() - 1
                e = [rng.normal(), low, low + rng.random() * 3]
                x = min(max(x + e[0], e[1]), e[2])
            else:
                e = [float(v) for v in rng.integers(0, 3, 3)] if i % 7 == 0 else [float(v) for v in rng.permutation(3)]
                x = int(e[x])
            rows.append((k, i, [float(v) for v in e]))
            want[k, i] = x
    df = spark.createDataFrame(rows, "k int, i int, e array<double>").repartition(3)
    got = folds.composed(df, ["k"], "i", "e", getattr(folds, kind), chunk=8).collect()
    assert len(got) == len(rows)
    for r in got:
        e = r["total"]
        x = {"affine": lambda: e[0] * 2.0 + e[1], "clamp": lambda: min(max(0.5 + e[0], e[1]), e[2]), "states": lambda: int(e[1])}[kind]()
        assert abs(x - want[r["k"], r["i"]]) < 1e-9


def test_a_fold_that_never_forgets_ends_within_bounded_rounds(spark, monkeypatch):
    rounds = []
    plain = folds.group_batches
    monkeypatch.setattr(folds, "group_batches", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).cast("long").alias("i"), F.col("id").cast("double").alias("v"))

    def fold(pdf, state):
        total = pdf["v"].cumsum() + state[0]
        return pd.DataFrame({"t": total}), (float(total.iloc[-1]),)

    start = spark.createDataFrame([(0, 1.0), (1, 2.0)], "k bigint, s double")
    got = folds.chunked_fold(df, ["k"], "i", start, ["s"], fold, T.StructType([T.StructField("t", T.DoubleType())]), chunk=1).toPandas()
    for k in (0, 1):
        assert np.allclose(got[got.k == k].sort_values("i")["t"], k + 1 + np.cumsum(np.arange(k, 2000, 2)))
    assert len(rounds) <= 13  # log2 of 1,000 chunks, two more, and the pass that writes the rows


def test_far_values_do_not_fill_one_bin(spark):
    v = np.random.default_rng(1).random(200_000)
    v[7] = 1e18
    df = spark.createDataFrame(pd.DataFrame({"k": np.ones(len(v), int), "v": v}))
    counted = df.groupBy("k", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = [r["count"] for r in L.value_bins(counted, ["k"]).groupBy("_bin").count().collect()]
    assert max(sizes) < 10_000 and sum(sizes) == len(v)
    got = L.percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.999, "d": 1.0}).first()
    assert np.allclose([got["a"], got["b"], got["c"], got["d"]], np.quantile(v, [0.05, 0.5, 0.999, 1.0]))
    order = np.argsort(v)
    bins = L.value_bins(counted, ["k"]).orderBy("_v").toPandas()["_bin"].to_numpy()
    assert (np.diff(bins) >= 0).all() and len(order) == len(bins)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_places_in_a_skewed_order(spark, keys):
    n = 5000
    rows = [("hot" if i % 10 else f"k{i % 4}", 1.0 if i % 3 else float(i % 17), i, i % 5) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v double, i int, a int").repartition(4)
    got = L.ordered(df, keys, ["v", "i"], "a").collect()
    seen, total = {}, {}
    for k, v, i, a in sorted(rows, key=lambda r: ((r[0],) if keys else (), r[1], r[2])):
        g = k if keys else None
        seen[i] = (sum(1 for _ in ()) + total.get((g, "n"), 0), total.get((g, "a"), 0))
        total[g, "n"] = total.get((g, "n"), 0) + 1
        total[g, "a"] = total.get((g, "a"), 0) + a
    assert {r["i"]: (r["position"], r["before"]) for r in got} == seen
    parts = L.cut_lineage(df.repartitionByRange(8, *keys, "v", "i").withColumn("p", F.spark_partition_id())).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < n / 3


def test_running_total_keeps_what_rounding_takes(spark):
    """200 million in cents: plain sums are off by more than the sixth digit after the point."""
    cents = np.random.default_rng(3).integers(1, 800_000, 50_000)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(len(cents)), "v": cents / 100}))
    start = spark.createDataFrame([(1, 0.0, 0.0)], "k long, s double, e double")
    got = folds.chunked_fold(df, ["k"], "i", start, ["s", "e"], folds.total("v", "t"), T.StructType([T.StructField("t", T.DoubleType())]), chunk=7_000).toPandas()
    want = np.cumsum(cents) / 100
    assert (got.sort_values("i")["t"].round(6).to_numpy() == want).all()
    assert (np.cumsum(cents / 100).round(6) != want).any()


def test_positions_keep_what_rounding_takes(spark):
    n = 60_000
    st = spark.range(n).select((F.col("id") % 2).alias("video_name"), F.floor(F.col("id") / 2).cast("int").alias("frame_order"))
    st = st.select("*", F.lit(0.1).alias("nx"), F.when(F.col("frame_order") == 0, 1e15).otherwise(0.3).alias("ny"), F.when(F.col("frame_order") % 3 == 0, 0.7).alias("nz"))
    first = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)], "video_name long, ox double, oy double, oz double")
    got = TR.positions(first, st, chunk=7_000).toPandas().sort_values(["video_name", "frame_order"])
    for _, g in got.groupby("video_name"):
        k = np.arange(n // 2 + 1)
        exact = {"cx": k * np.longdouble(0.1), "cy": np.where(k > 0, np.longdouble(1e15) + (k - 1) * np.longdouble(0.3), 0), "cz": (k + 2) // 3 * np.longdouble(0.7)}
        for c, want in exact.items():
            want = want.astype(float)
            assert (np.abs(g[c].to_numpy() - want) <= np.spacing(np.abs(want))).all(), c
            assert c != "cx" or np.abs(np.cumsum(np.full(n // 2, 0.1)) - want[1:]).max() > 1e-9  # what a plain sum is off by


def test_running_totals_of_odd_values(spark):
    rows = [(0, 1.0), (1, None), (2, 2.0), (3, float("inf")), (4, 1.0), (5, float("nan"))]
    got = L.running_totals(spark.createDataFrame([("k", *r) for r in rows], "k string, i int, v double"), ["k"], "i", {"t": F.col("v")}, chunk=2)
    t = [r.t for r in got.orderBy("i").collect()]
    assert t[:5] == [1.0, 1.0, 3.0, float("inf"), float("inf")] and np.isnan(t[5])
