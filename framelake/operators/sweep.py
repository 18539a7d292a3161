"""Parameter sweeps: search space, summaries, ablations, Pareto front, hard-case choice."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from framelake.functions import flags as FL
from framelake.functions.names import config_id, hash_order
from framelake.functions.ratios import NULL, finite, ratio
from framelake.operators.layout import ordered, outgrown, percentile_table, with_hash_position
from framelake.session import cut_lineage

HITS = (1, 8, 16, 32)
QUANTILES = {"median": 0.5, "p10": 0.1, "p05": 0.05}


def search_space(spark: SparkSession, base: Mapping[str, object], stages: Sequence[Mapping], max_configs: int = 100) -> DataFrame:
    """All configurations of a search file, numbered in the order they are listed.

    A stage may ask for the base, explicit changes, one-factor lists and a
    product of lists.  Unknown fields and more than ``max_configs`` rows are
    errors; the list is written down by hand, so it is small by construction.
    """
    rows: list[dict] = []

    def add(stage: str, name: str, changes: Mapping[str, object]) -> None:
        unknown = set(changes) - set(base)
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        if any(r["stage"] == stage and r["name"] == name for r in rows):
            raise ValueError(f"duplicate configuration {stage}/{name}")
        rows.append({"ordinal": len(rows), "stage": stage, "name": name, **base, **changes})

    for st in stages:
        if st.get("include_base"):
            add(st["stage"], "base", {})
        for name, changes in st.get("configs", {}).items():
            add(st["stage"], name, changes)
        for field, values in st.get("one_factor", {}).items():
            for v in values:
                add(st["stage"], f"{field}={v}", {field: v})
        grid = st.get("product", {})
        if grid:
            for combo in itertools.product(*grid.values()):
                add(st["stage"], ",".join(f"{k}={v}" for k, v in zip(grid, combo)), dict(zip(grid, combo)))
    if len(rows) > max_configs:
        raise ValueError(f"{len(rows)} configurations, at most {max_configs} allowed")
    df = spark.createDataFrame(pd.DataFrame(rows))
    return df.withColumn("config_id", config_id(sorted(base)))


def first_of_config(df: DataFrame, key: str = "config_id", order: str = "ordinal") -> DataFrame:
    """One row per configuration, the first listed wins; a map-side maximum, not a sort."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def box_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Retention over boxes: rates, micro and mean recall, exact percentiles, hits per threshold.

    ``rows``: valid, teacher_positive, selected_positive, recall, zero_positive, extent_recall.
    """
    ok = rows.filter("valid").withColumns({c: finite(c) for c in ("recall", "extent_recall")})
    agg = rows.groupBy(*keys).agg(
        F.count_if("valid").alias("valid_boxes"), F.count_if(~F.col("valid")).alias("invalid_boxes"), F.count_if(F.col("valid") & F.col("zero_positive")).alias("zero_boxes"),
        F.sum(F.when(F.col("valid"), F.col("teacher_positive")).otherwise(0)).alias("_t"), F.sum(F.when(F.col("valid"), F.col("selected_positive")).otherwise(0)).alias("_s"),
        F.avg(F.when(F.col("valid"), finite("recall"))).alias("recall_mean"), F.min(F.when(F.col("valid"), finite("recall"))).alias("recall_min"),
        F.avg(F.when(F.col("valid"), finite("extent_recall"))).alias("extent_mean"),
        *[F.count_if(F.col("valid") & (F.col("selected_positive") >= h)).alias(f"hits_at_{h}") for h in HITS])
    asked = {f"recall_{n}": ("recall", v) for n, v in QUANTILES.items()} | {"extent_p05": ("extent_recall", 0.05)}
    out = agg.join(percentile_table(ok, keys, asked), list(keys), "left")
    out = out.withColumns({"zero_rate": ratio("zero_boxes", "valid_boxes", NULL), "recall_micro": ratio("_s", "_t", NULL),
                           **{f"recall_at_{h}": ratio(f"hits_at_{h}", "valid_boxes", NULL) for h in HITS}})
    return out.drop("_t", "_s")


def frame_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points over frames: totals, spread, multiplier over the old sampling, label shares, context yields.

    ``rows``: total, legacy, positive, background, ignored, context_only,
    context_background, context_ignored, seconds.
    """
    sums = ["total", "legacy", "positive", "background", "ignored", "context_only", "context_background", "context_ignored", "seconds"]
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_frames"), *[F.sum(c).alias(f"{c}_sum") for c in sums], F.avg("total").alias("points_mean"),
                                  F.max("total").alias("points_max"), F.count_if(F.col("legacy") == 0).alias("legacy_zero_frames"), F.avg("seconds").alias("seconds_per_frame"))
    q = percentile_table(rows, keys, {"points_median": ("total", 0.5), "points_p95": ("total", 0.95)})
    out = agg.join(q, list(keys), "left")
    return out.withColumns({
        "legacy_multiplier": ratio("total_sum", "legacy_sum", NULL), "positive_ratio": ratio("positive_sum", "total_sum"), "background_ratio": ratio("background_sum", "total_sum"),
        "ignore_ratio": ratio("ignored_sum", "total_sum"), "useful_ratio": ratio(F.col("positive_sum") + F.col("background_sum"), "total_sum"),
        "context_background_yield": ratio("context_background_sum", "context_only_sum", NULL), "context_ignore_yield": ratio("context_ignored_sum", "context_only_sum", NULL)})


def global_summary(boxes: DataFrame, frames: DataFrame, config: str = "config", video: str = "video_name",
                   spread: Sequence[str] = ("recall_at_1", "recall_at_16", "recall_micro")) -> tuple[DataFrame, DataFrame]:
    """Per-video table and per-configuration table with worst and low-percentile videos."""
    per_video = box_summary(boxes, [config, video]).join(frame_summary(frames, [config, video]), [config, video], "full")
    total = box_summary(boxes, [config]).join(frame_summary(frames, [config]), config, "full")
    total = total.join(per_video.groupBy(config).agg(F.count(F.lit(1)).alias("num_videos"), *[F.min(finite(c)).alias(f"worst_{c}") for c in spread]), config)
    asked = {f"video_p{p:02d}_{c}": (c, p / 100) for c in spread for p in (5, 10)}
    low = percentile_table(per_video.withColumns({c: finite(c) for c in spread}), [config], asked)
    return per_video, total.join(low, config, "left")


ABLATIONS = {"full": 0xFFFF, **{f"without_{s}": 0xFFFF & ~b for s, b in FL.SOURCE_BITS.items()}}


def ablation_counts(teacher: DataFrame, points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per video and ablation: boxes still hit, hits, totals, and boxes only the cleared source found.

    ``points``: one row per (video, frame, pixel) with merged flags; ``teacher``
    one row per positive pixel and box.
    """
    cell, box = ["video_name", "frame_order", "px", "py"], ["video_name", "frame_order", "bbox_index"]
    on = lambda m: F.col("flags").bitwiseAND(F.lit(m)) != 0
    totals = points.groupBy("video_name").agg(*[F.count_if(on(m)).alias(f"t_{n}") for n, m in ABLATIONS.items()])
    hits = outgrown(teacher).join(points, cell).groupBy(*box).agg(*[F.count_if(on(m)).alias(f"s_{n}") for n, m in ABLATIONS.items()])
    size = teacher.groupBy(*box).agg(F.count(F.lit(1)).alias("teacher_positive"))
    b = boxes.filter("valid").select(*box).join(outgrown(size), box, "left").join(outgrown(hits), box, "left").fillna(0)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("ablation"), F.col(f"s_{n}").alias("kept"), F.col("s_full").alias("whole")) for n in ABLATIONS])).alias("a")
    rows = b.select("video_name", "teacher_positive", each).select("video_name", "teacher_positive", "a.*")
    agg = rows.groupBy("video_name", "ablation").agg(
        F.count(F.lit(1)).alias("valid_boxes"), F.count_if(F.col("kept") == 0).alias("zero_boxes"), F.sum("teacher_positive").alias("teacher_positive"), F.sum("kept").alias("selected_positive"),
        F.count_if((F.col("whole") > 0) & (F.col("kept") == 0)).alias("rescued"), *[F.count_if(F.col("kept") >= h).alias(f"hits_at_{h}") for h in HITS])
    long = totals.select("video_name", F.explode(F.array(*[F.struct(F.lit(n).alias("ablation"), F.col(f"t_{n}").alias("total_points")) for n in ABLATIONS])).alias("t")).select("video_name", "t.*")
    return long.join(outgrown(agg), ["video_name", "ablation"], "left").fillna(0)


def ablation_table(per_video: DataFrame) -> DataFrame:
    """Video rows and their global sums, with rates; a grouping set instead of a second pass."""
    sums = [c for c in per_video.columns if c not in ("video_name", "ablation")]
    both = per_video.groupingSets([[F.col("video_name"), F.col("ablation")], [F.col("ablation")]], F.col("video_name"), F.col("ablation")).agg(
        *[F.sum(c).alias(c) for c in sums], F.grouping("video_name").alias("_g"))
    out = both.withColumn("scope", F.when(F.col("_g") == 1, "global").otherwise("video")).drop("_g")
    return out.withColumns({"zero_rate": ratio("zero_boxes", "valid_boxes", NULL), "recall_micro": ratio("selected_positive", "teacher_positive", NULL),
                            **{f"recall_at_{h}": ratio(f"hits_at_{h}", "valid_boxes", NULL) for h in HITS}})


def ablation_deltas(table: DataFrame) -> DataFrame:
    """Points only the cleared source added, and boxes rescued per thousand of them (global scope)."""
    g = table.filter(F.col("scope") == "global").select("ablation", "total_points", "rescued")
    full = g.filter(F.col("ablation") == "full").agg(F.max("total_points"))
    j = g.withColumn("_full", full.scalar())
    added = F.col("_full") - F.col("total_points")
    added = F.when(added < 0, F.raise_error(F.lit("an ablation added points")).cast("bigint")).otherwise(added)
    return j.select("ablation", "total_points", "rescued", added.alias("unique_added"),
                    F.when((F.col("ablation") != "full"), ratio(F.col("rescued") * 1000.0, added, NULL)).alias("rescued_per_1000"))


def _dominated(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which cost vectors some other vector beats or equals everywhere and beats somewhere."""
    out = np.zeros(len(v), bool)
    order = np.argsort(np.where(np.isfinite(by), by, 1e300).sum(axis=1))  # strong rows first
    alive = np.arange(len(v))
    for d in by[order]:
        if not len(alive):
            break
        rows = v[alive]
        hit = (d <= rows).all(axis=1) & (d < rows).any(axis=1)
        out[alive[hit]] = True
        alive = alive[~hit]
    return out


def pareto(df: DataFrame, low: Sequence[str], high: Sequence[str], blocks: int = 1, most: int = 4096) -> DataFrame:
    """Rows not dominated in any objective; equal rows keep each other.

    Missing and infinite values count as the worst.  Distinct cost vectors
    first lose to others of their Arrow batch.  The survivors are put in
    dictionary order, where whatever dominates a vector comes before it, and
    cut into blocks of at most ``most``, at least ``blocks`` of them; a block
    meets only earlier blocks whose best corner is nowhere worse than its own
    worst corner, pair by pair, so no task sees more than two blocks.
    """
    big = F.lit(float("inf"))
    cost = {f"_o{i}": F.coalesce(finite(c).cast("double"), big) for i, c in enumerate(low)}
    cost |= {f"_h{i}": F.coalesce(-finite(c).cast("double"), big) for i, c in enumerate(high)}
    names = list(cost)
    rows = df.withColumns(cost)
    vectors = rows.select(*names).distinct()

    def thin(batches):
        for b in batches:
            v = b.to_numpy(float)
            yield b[~_dominated(v, v)]

    left = vectors.mapInPandas(thin, vectors.schema)
    placed = ordered(left, [], names)
    size = F.least(F.lit(most), F.ceil(placed.agg(F.count(F.lit(1))).scalar() / blocks))
    placed = cut_lineage(placed.withColumn("_b", F.floor(F.col("position") / size)).drop("position"))
    corners = placed.groupBy("_b").agg(*[F.min(c).alias(f"lo{c}") for c in names], *[F.max(c).alias(f"hi{c}") for c in names])
    before = corners.select(F.col("_b").alias("_a"), *[f"lo{c}" for c in names])
    meets = reduce(lambda x, y: x & y, [F.col(f"lo{c}") <= F.col(f"hi{c}") for c in names])
    # one row per block on either side; a block meets itself too
    pairs = corners.select("_b", *[f"hi{c}" for c in names], F.explode(F.sequence(F.lit(0).cast("bigint"), "_b")).alias("_a")).join(before, "_a").filter(meets).select("_a", "_b")
    judged = placed.join(pairs, "_b").withColumn("_judge", F.lit(False)).select("_a", "_b", *names, "_judge")
    judges = placed.withColumnRenamed("_b", "_a").join(pairs, "_a").withColumn("_judge", F.lit(True)).select("_a", "_b", *names, "_judge")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        v, judge = pdf[names].to_numpy(float), pdf["_judge"].to_numpy(bool)
        return pdf.loc[~judge, names][_dominated(v[~judge], v[judge])]

    beaten = judged.unionByName(judges).groupBy("_a", "_b").applyInPandas(meet, vectors.schema).distinct()
    front = placed.select(*names).join(beaten, names, "left_anti")
    return rows.join(front, names, "left_semi").drop(*names)


def rank_finite(df: DataFrame, value: str, descending: bool, name: str = "rank", tie: str = "video_name") -> DataFrame:
    """1-based rank of finite values, ties by name."""
    v = df.withColumn("_v", finite(value)).filter(F.col("_v").isNotNull())
    keyed = v.withColumn("_k", -F.col("_v") if descending else F.col("_v"))
    return ordered(keyed, [], ["_k", tie], name=name).withColumn(name, F.col(name) + 1).drop("_v", "_k")


def hard_cases(df: DataFrame, target: int, seed: str) -> DataFrame:
    """Screening set: failures, hardest, costliest, then a repeatable fill up to ``target``.

    ``df``: one row per video with valid_boxes, zero_boxes, recall_at_16,
    recall_min, recall_p05, recall_micro, ignore_ratio, points_mean.  The set
    may exceed ``target``; no named reason is dropped.
    """
    if target < 1:
        raise ValueError("target must be at least 1")
    sized = df.withColumn("_t", df.agg(F.least(F.count(F.lit(1)), F.lit(target))).scalar())
    ok = sized.filter(F.col("valid_boxes") > 0)
    hard, cost = F.greatest(F.lit(1), F.floor(F.col("_t") / 4)), F.greatest(F.lit(1), F.floor(F.col("_t") / 6))
    # The reason codes, here and in the fill below.
    failed = ok.filter((F.col("zero_boxes") > 0) | (finite("recall_at_16") < 1.0)).select("video_name", F.lit("baseline_failure_or_recall16_below_1").alias("reason"))
    parts = [failed]
    for src, col, desc, quota, why in ((ok, "recall_min", False, hard, "lowest_positive_recall_min"), (ok, "recall_p05", False, hard, "lowest_positive_recall_p05"),
                                       (ok, "recall_micro", False, cost, "lowest_positive_recall_micro"), (sized, "ignore_ratio", True, cost, "highest_selected_ignore_ratio"),
                                       (sized, "points_mean", True, cost, "highest_points_per_frame")):
        v = src.withColumn("_v", finite(col)).filter(F.col("_v").isNotNull())
        w = W.partitionBy().orderBy(F.desc("_v") if desc else F.asc("_v"), "video_name")
        # The constant limit is what lets Spark cut every partition before the single sorted one.
        top = v.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= target).filter(F.col("_r") <= quota)
        parts.append(top.select("video_name", F.lit(why).alias("reason")))
    marked = parts[0]
    for p in parts[1:]:
        marked = marked.unionByName(p)
    reasons = marked.groupBy("video_name").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    have = reasons.agg(F.count(F.lit(1)))
    rest = sized.select("video_name", "_t").join(reasons, "video_name", "left_anti").withColumn("_h", hash_order(seed, "video_name"))
    rest = with_hash_position(rest, [], "_h", ["video_name"], "_p").withColumn("_have", have.scalar()).filter(F.col("_p") < F.col("_t") - F.col("_have"))
    fill = rest.select("video_name", F.array(F.lit("deterministic_hash_fill")).alias("reasons"))
    return reasons.unionByName(fill)


def choose(df: DataFrame, column: str, wanted: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """Rows whose column is among the wanted values; a wanted value nobody has is an error row-side.

    ``forbidden`` values (a held-out split) are refused before anything runs.
    """
    bad = set(wanted) & set(forbidden)
    if bad:
        raise ValueError(f"{sorted(bad)} may not be used here")
    return df.filter(F.col(column).isin(list(wanted)))


def unknown_values(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Wanted values no row has."""
    asked = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{column} string")
    return asked.join(df.select(F.col(column).cast("string").alias(column)).distinct(), column, "left_anti")


def run_metadata(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """One JSON record that describes a run."""
    return df.agg(*[c.alias(n) for n, c in counts.items()]).select(F.to_json(F.struct(*sorted(counts))).alias("metadata"))
