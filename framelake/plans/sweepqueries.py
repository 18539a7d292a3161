"""Queries over parameter sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions.names import hash_order
from framelake.operators import boxes as B, sweep as S
from framelake.plans import views as V
from framelake.plans.boxqueries import CONFIGS, PARTS_SQL, TEACHER_SQL, contour, rounded, sweep_tables
from framelake.plans.registry import query

# One row per box and configuration, taken from order lines: a line's order is the box.
BOX_SQL = """bx AS (SELECT l_suppkey AS video_name, l_returnflag AS config, l_linenumber % 5 <> 0 AS valid, CAST(l_quantity AS BIGINT) AS teacher_positive,
    CAST(least(l_quantity, l_partkey % 45) AS BIGINT) AS selected_positive, least(l_quantity, l_partkey % 45) / l_quantity AS recall, l_linenumber % 5 <> 0 AND l_partkey % 45 = 0 AS zero_positive,
    CASE WHEN l_partkey % 7 <> 0 THEN (l_partkey % 90) / 90.0::DOUBLE END AS extent_recall FROM lineitem),
  fr AS (SELECT l_suppkey AS video_name, l_returnflag AS config, l_partkey % 300 AS total, l_partkey % 50 AS legacy, l_partkey % 300 - l_partkey % 40 - l_partkey % 30 AS positive, l_partkey % 40 AS background,
    l_partkey % 30 AS ignored, l_partkey % 11 AS context_only, l_partkey % 3 AS context_background, l_partkey % 2 AS context_ignored, l_tax AS seconds FROM lineitem)"""


def box_rows(spark, d):
    li = V.table(spark, d, "lineitem")
    ok, k = F.col("l_linenumber") % 5 != 0, F.col("l_partkey")
    sel = F.least(F.col("l_quantity"), (k % 45).cast("double"))
    return li.select(F.col("l_suppkey").alias("video_name"), F.col("l_returnflag").alias("config"), ok.alias("valid"), F.col("l_quantity").cast("bigint").alias("teacher_positive"),
                     sel.cast("bigint").alias("selected_positive"), (sel / F.col("l_quantity")).alias("recall"), (ok & (k % 45 == 0)).alias("zero_positive"),
                     F.when(k % 7 != 0, (k % 90) / 90.0).otherwise(float("nan")).alias("extent_recall"))


def frame_rows(spark, d):
    k = F.col("l_partkey")
    return V.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("video_name"), F.col("l_returnflag").alias("config"), (k % 300).alias("total"), (k % 50).alias("legacy"), (k % 300 - k % 40 - k % 30).alias("positive"),
        (k % 40).alias("background"), (k % 30).alias("ignored"), (k % 11).alias("context_only"), (k % 3).alias("context_background"), (k % 2).alias("context_ignored"), F.col("l_tax").alias("seconds"))


def _box_sql(keys: str) -> str:
    hits = ", ".join(f"count(*) FILTER (valid AND selected_positive >= {h}) AS hits_at_{h}, round(count(*) FILTER (valid AND selected_positive >= {h}) / nullif(count(*) FILTER (valid), 0)::DOUBLE, 6) AS recall_at_{h}" for h in S.HITS)
    q = lambda v, p, n: f"round(quantile_cont({v}, {p}) FILTER (valid), 6) AS {n}"
    return f"""SELECT {keys}, count(*) FILTER (valid) AS valid_boxes, count(*) FILTER (NOT valid) AS invalid_boxes, count(*) FILTER (valid AND zero_positive) AS zero_boxes,
      round(count(*) FILTER (valid AND zero_positive) / nullif(count(*) FILTER (valid), 0)::DOUBLE, 6) AS zero_rate, round(sum(selected_positive) FILTER (valid) / nullif(sum(teacher_positive) FILTER (valid), 0)::DOUBLE, 6) AS recall_micro,
      round(avg(recall) FILTER (valid), 6) AS recall_mean, round(min(recall) FILTER (valid), 6) AS recall_min, {q('recall', 0.5, 'recall_median')}, {q('recall', 0.1, 'recall_p10')}, {q('recall', 0.05, 'recall_p05')},
      round(avg(extent_recall) FILTER (valid), 6) AS extent_mean, {q('extent_recall', 0.05, 'extent_p05')}, {hits} FROM bx GROUP BY {keys}"""


def _frame_sql(keys: str) -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in ("total", "legacy", "positive", "background", "ignored", "context_only", "context_background", "context_ignored"))
    r = lambda a, b, n, z=False: (f"round(coalesce(({a}) / nullif({b}, 0)::DOUBLE, 0), 6) AS {n}" if z else f"round(({a}) / nullif({b}, 0)::DOUBLE, 6) AS {n}")
    return f"""SELECT {keys}, count(*) AS num_frames, {sums}, round(sum(seconds), 6) AS seconds_sum, round(avg(total), 6) AS points_mean, max(total) AS points_max, count(*) FILTER (legacy = 0) AS legacy_zero_frames,
      round(avg(seconds), 6) AS seconds_per_frame, round(quantile_cont(total, 0.5), 6) AS points_median, round(quantile_cont(total, 0.95), 6) AS points_p95, {r('sum(total)', 'sum(legacy)', 'legacy_multiplier')},
      {r('sum(positive)', 'sum(total)', 'positive_ratio', True)}, {r('sum(background)', 'sum(total)', 'background_ratio', True)}, {r('sum(ignored)', 'sum(total)', 'ignore_ratio', True)},
      {r('sum(positive) + sum(background)', 'sum(total)', 'useful_ratio', True)}, {r('sum(context_background)', 'sum(context_only)', 'context_background_yield')}, {r('sum(context_ignored)', 'sum(context_only)', 'context_ignore_yield')}
      FROM fr GROUP BY {keys}"""


@query("a14_box_summary", f"WITH {BOX_SQL} {_box_sql('config')}")
def a14(spark, d):
    return rounded(S.box_summary(box_rows(spark, d), ["config"]))


@query("a15_frame_summary", f"WITH {BOX_SQL} {_frame_sql('config')}")
def a15(spark, d):
    return rounded(S.frame_summary(frame_rows(spark, d), ["config"]))


@query("a16_per_video_summary", f"WITH {BOX_SQL} SELECT * FROM ({_box_sql('config, video_name')}) JOIN ({_frame_sql('config, video_name')}) USING (config, video_name)")
def a16_video(spark, d):
    return rounded(S.global_summary(box_rows(spark, d), frame_rows(spark, d))[0])


@query("a16_global_summary", f"""
  WITH {BOX_SQL}, pv AS (SELECT config, video_name, count(*) FILTER (valid AND selected_positive >= 1) / nullif(count(*) FILTER (valid), 0)::DOUBLE AS recall_at_1,
    count(*) FILTER (valid AND selected_positive >= 16) / nullif(count(*) FILTER (valid), 0)::DOUBLE AS recall_at_16, sum(selected_positive) FILTER (valid) / nullif(sum(teacher_positive) FILTER (valid), 0)::DOUBLE AS recall_micro FROM bx GROUP BY 1, 2)
  SELECT config, count(*) AS num_videos, {", ".join(f"round(min({c}), 6) AS worst_{c}, round(quantile_cont({c}, 0.05), 6) AS video_p05_{c}, round(quantile_cont({c}, 0.1), 6) AS video_p10_{c}" for c in ("recall_at_1", "recall_at_16", "recall_micro"))}
  FROM pv GROUP BY 1""")
def a16_global(spark, d):
    out = S.global_summary(box_rows(spark, d), frame_rows(spark, d))[1]
    return rounded(out.select("config", "num_videos", *[c for c in out.columns if c.startswith(("worst_", "video_p"))]))


ABL_SQL = f"""{TEACHER_SQL}, pts AS (SELECT video_name, frame_order, CAST(pixel_x AS INTEGER) AS px, CAST(pixel_y AS INTEGER) AS py, bit_or(source_flags) AS flags FROM points GROUP BY 1, 2, 3, 4),
  abl AS (SELECT * FROM (VALUES ('full', 65535), ('without_global', 65534), ('without_local', 65533), ('without_tophat', 65531), ('without_context', 65527)) a(ablation, mask)),
  tb AS (SELECT video_name, frame_order, bbox_index, count(*) AS tp FROM teacher GROUP BY 1, 2, 3),
  hb AS (SELECT video_name, frame_order, bbox_index, ablation, count(*) FILTER (flags & mask <> 0) AS kept, count(*) AS whole FROM teacher JOIN pts USING (video_name, frame_order, px, py) CROSS JOIN abl GROUP BY 1, 2, 3, 4),
  bb AS (SELECT b.video_name, a.ablation, coalesce(tp, 0) AS tp, coalesce(kept, 0) AS kept, coalesce(whole, 0) AS whole FROM (SELECT * FROM boxes WHERE valid) b CROSS JOIN abl a LEFT JOIN tb USING (video_name, frame_order, bbox_index)
    LEFT JOIN hb ON hb.video_name = b.video_name AND hb.frame_order = b.frame_order AND hb.bbox_index = b.bbox_index AND hb.ablation = a.ablation),
  ag AS (SELECT video_name, ablation, count(*) AS valid_boxes, count(*) FILTER (kept = 0) AS zero_boxes, sum(tp) AS teacher_positive, sum(kept) AS selected_positive, count(*) FILTER (whole > 0 AND kept = 0) AS rescued,
    {", ".join(f"count(*) FILTER (kept >= {h}) AS hits_at_{h}" for h in S.HITS)} FROM bb GROUP BY 1, 2),
  tt AS (SELECT video_name, ablation, count(*) FILTER (flags & mask <> 0) AS total_points FROM pts CROSS JOIN abl GROUP BY 1, 2),
  pv AS (SELECT * FROM tt LEFT JOIN ag USING (video_name, ablation)),
  gs AS (SELECT video_name, ablation, CASE WHEN grouping(video_name) = 1 THEN 'global' ELSE 'video' END AS scope,
    {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ["total_points", "valid_boxes", "zero_boxes", "teacher_positive", "selected_positive", "rescued", *[f"hits_at_{h}" for h in S.HITS]])}
    FROM pv GROUP BY GROUPING SETS ((video_name, ablation), (ablation)))"""


def ablation(spark, d):
    teacher = contour(spark, d, ["bbox_index"])
    pts = B.pixel(V.points(spark, d)).groupBy("video_name", "frame_order", "px", "py").agg(F.bit_or("source_flags").alias("flags"))
    return S.ablation_table(S.ablation_counts(teacher, pts, V.boxes(spark, d)))


@query("a17_ablation_table", f"""
  WITH {ABL_SQL} SELECT *, round(zero_boxes / nullif(valid_boxes, 0)::DOUBLE, 6) AS zero_rate, round(selected_positive / nullif(teacher_positive, 0)::DOUBLE, 6) AS recall_micro,
    {", ".join(f"round(hits_at_{h} / nullif(valid_boxes, 0)::DOUBLE, 6) AS recall_at_{h}" for h in S.HITS)} FROM gs""", "points boxes")
def a17(spark, d):
    return rounded(ablation(spark, d))


@query("a18_ablation_deltas", f"""
  WITH {ABL_SQL}, g AS (SELECT * FROM gs WHERE scope = 'global'), f AS (SELECT total_points AS tf FROM g WHERE ablation = 'full')
  SELECT ablation, total_points, rescued, tf - total_points AS unique_added, CASE WHEN ablation <> 'full' THEN round(rescued * 1000.0::DOUBLE / nullif(tf - total_points, 0), 6) END AS rescued_per_1000 FROM g, f""", "points boxes")
def a18(spark, d):
    return rounded(S.ablation_deltas(ablation(spark, d)))


SPACE = {"stride": 2, "window": 41, "percentile": 80.0}
STAGES = [{"stage": "a", "include_base": True, "one_factor": {"window": [21, 31, 41]}}, {"stage": "b", "configs": {"dense": {"stride": 1}}, "product": {"stride": [1, 2, 3], "percentile": [75.0, 80.0, 85.0]}}]
SPACE_SQL = """cf AS (SELECT * FROM (VALUES (0, 'a', 'base', 2, 41, 80.0), (1, 'a', 'window=21', 2, 21, 80.0), (2, 'a', 'window=31', 2, 31, 80.0), (3, 'a', 'window=41', 2, 41, 80.0), (4, 'b', 'dense', 1, 41, 80.0),
    (5, 'b', 'stride=1,percentile=75.0', 1, 41, 75.0), (6, 'b', 'stride=1,percentile=80.0', 1, 41, 80.0), (7, 'b', 'stride=1,percentile=85.0', 1, 41, 85.0), (8, 'b', 'stride=2,percentile=75.0', 2, 41, 75.0),
    (9, 'b', 'stride=2,percentile=80.0', 2, 41, 80.0), (10, 'b', 'stride=2,percentile=85.0', 2, 41, 85.0), (11, 'b', 'stride=3,percentile=75.0', 3, 41, 75.0), (12, 'b', 'stride=3,percentile=80.0', 3, 41, 80.0),
    (13, 'b', 'stride=3,percentile=85.0', 3, 41, 85.0)) c(ordinal, stage, name, stride, win, pct)),
  ids AS (SELECT *, 'cfg_' || substr(sha256('{"percentile":' || CAST(pct AS DECIMAL(4,1)) || ',"stride":' || stride || ',"window":' || win || '}'), 1, 12) AS config_id FROM cf)"""


def config_costs(spark, d, space):
    """What each configuration would select from the given points: work grows with the table."""
    p = V.points(spark, d).select("intensity", "pixel_x", "point_label")
    steps = space.select("config_id", "stage", "name", "ordinal", F.col("stride").cast("int").alias("stride"), "percentile")
    # Points are counted per (brightness, pixel phase, label) first: a few thousand rows whatever the table holds.
    hist = p.groupBy("intensity", (F.col("pixel_x") % 6).cast("int").alias("phase"), "point_label").agg(F.count(F.lit(1)).alias("n"))
    # A configuration meets only the phases its stride keeps.
    keep = steps.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(5), F.col("stride"))))
    j = keep.join(hist, "phase")
    hit = F.col("intensity") >= F.col("percentile") * 2.56
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return j.groupBy("ordinal", "stage", "name", "config_id").agg(n(hit).alias("selected"), n(hit & (F.col("point_label") == 1)).alias("positive"), n(hit & (F.col("point_label") == -1)).alias("ignored"))


COST_SQL = f"""{SPACE_SQL}, ct AS (SELECT ordinal, stage, name, config_id, count(*) FILTER (h) AS selected, count(*) FILTER (h AND point_label = 1) AS positive, count(*) FILTER (h AND point_label = -1) AS ignored
    FROM (SELECT ids.*, point_label, (CAST(pixel_x AS INT) % 6) % stride = 0 AND intensity >= CAST(pct AS DOUBLE) * 2.56::DOUBLE AS h FROM points, ids) GROUP BY 1, 2, 3, 4)"""


@query("g01_search_space", f"WITH {COST_SQL} SELECT * FROM ct", "points")
def g01(spark, d):
    return config_costs(spark, d, S.search_space(spark, SPACE, STAGES))


@query("o05_first_of_config", f"WITH {COST_SQL} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY ordinal) AS r FROM ct) WHERE r = 1", "points")
def o05(spark, d):
    return S.first_of_config(config_costs(spark, d, S.search_space(spark, SPACE, STAGES)))


@query("j14_pareto_front", """
  WITH s AS (SELECT l_suppkey AS video_name, round(avg(l_tax), 6) AS zero_rate, round(avg(l_quantity), 6) AS recall_at_16, round(min(l_extendedprice), 6) AS recall_p05, round(avg(l_discount), 6) AS ignore_ratio, count(*) AS points_mean FROM lineitem GROUP BY 1)
  SELECT a.* FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.zero_rate <= a.zero_rate AND b.recall_at_16 >= a.recall_at_16 AND b.recall_p05 >= a.recall_p05 AND b.ignore_ratio <= a.ignore_ratio AND b.points_mean <= a.points_mean
    AND (b.zero_rate < a.zero_rate OR b.recall_at_16 > a.recall_at_16 OR b.recall_p05 > a.recall_p05 OR b.ignore_ratio < a.ignore_ratio OR b.points_mean < a.points_mean))""")
def j14(spark, d):
    s = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("video_name")).agg(
        F.round(F.avg("l_tax"), 6).alias("zero_rate"), F.round(F.avg("l_quantity"), 6).alias("recall_at_16"), F.round(F.min("l_extendedprice"), 6).alias("recall_p05"),
        F.round(F.avg("l_discount"), 6).alias("ignore_ratio"), F.count(F.lit(1)).alias("points_mean"))
    return S.pareto(s, ["zero_rate", "ignore_ratio", "points_mean"], ["recall_at_16", "recall_p05"])


VIDEO_SQL = """vd AS (SELECT l_suppkey AS video_name, count(*) FILTER (l_returnflag <> 'A') AS valid_boxes, count(*) FILTER (l_partkey % 1997 = 0) AS zero_boxes, CASE WHEN l_suppkey % 9 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS recall_at_16,
    round(min(l_extendedprice), 2) AS recall_min, round(avg(l_tax), 6) AS recall_p05, round(avg(l_quantity), 6) AS recall_micro, round(avg(l_discount), 6) AS ignore_ratio, count(*) AS points_mean FROM lineitem GROUP BY 1)"""


def video_table(spark, d):
    k = F.col("l_suppkey")
    return V.table(spark, d, "lineitem").groupBy(k.alias("video_name")).agg(
        F.count_if(F.col("l_returnflag") != "A").alias("valid_boxes"), F.count_if(F.col("l_partkey") % 1997 == 0).alias("zero_boxes"),
        F.first(F.when(k % 9 == 0, 0.5).otherwise(1.0)).alias("recall_at_16"), F.round(F.min("l_extendedprice"), 2).alias("recall_min"), F.round(F.avg("l_tax"), 6).alias("recall_p05"),
        F.round(F.avg("l_quantity"), 6).alias("recall_micro"), F.round(F.avg("l_discount"), 6).alias("ignore_ratio"), F.count(F.lit(1)).alias("points_mean"))


@query("t01_rank_finite", f"WITH {VIDEO_SQL} SELECT video_name, row_number() OVER (ORDER BY recall_micro DESC, video_name) AS rank FROM vd")
def t01(spark, d):
    return S.rank_finite(video_table(spark, d), "recall_micro", True).select("video_name", "rank")


@query("t03_hash_order", "SELECT s_suppkey AS video_name, row_number() OVER (ORDER BY sha256('screen:' || s_suppkey), s_suppkey) AS place FROM supplier")
def t03(spark, d):
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("video_name")).withColumn("_h", hash_order("screen", "video_name"))
    return S.with_hash_position(s, [], "_h", ["video_name"], "place").select("video_name", (F.col("place") + 1).alias("place"))


TARGET = 84


@query("t02_hard_cases", f"""
  WITH {VIDEO_SQL}, t AS (SELECT least(count(*), {TARGET}) AS t FROM vd), ok AS (SELECT * FROM vd WHERE valid_boxes > 0),
  m AS (SELECT video_name, 'baseline_failure_or_recall16_below_1' AS reason FROM ok WHERE zero_boxes > 0 OR recall_at_16 < 1
    {"".join(f" UNION ALL SELECT video_name, '{why}' FROM (SELECT video_name, row_number() OVER (ORDER BY {c} {o}, video_name) AS r FROM {src}), t WHERE r <= greatest(1, t // {q})"
             for c, o, src, q, why in (("recall_min", "", "ok", 4, "lowest_positive_recall_min"), ("recall_p05", "", "ok", 4, "lowest_positive_recall_p05"), ("recall_micro", "", "ok", 6, "lowest_positive_recall_micro"),
                                       ("ignore_ratio", "DESC", "vd", 6, "highest_selected_ignore_ratio"), ("points_mean", "DESC", "vd", 6, "highest_points_per_frame")))}),
  g AS (SELECT video_name, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM m GROUP BY 1),
  r AS (SELECT video_name, row_number() OVER (ORDER BY sha256('screen:' || video_name), video_name) AS p FROM vd WHERE video_name NOT IN (SELECT video_name FROM g))
  SELECT * FROM g UNION ALL SELECT video_name, 'deterministic_hash_fill' FROM r, t WHERE p <= t - (SELECT count(*) FROM g)""")
def t02(spark, d):
    return S.hard_cases(video_table(spark, d), TARGET, "screen").withColumn("reasons", F.array_join("reasons", ","))


@query("a31_reason_counters", f"""
  WITH {VIDEO_SQL}, m AS (SELECT video_name, 'baseline_failure_or_recall16_below_1' AS reason FROM vd WHERE valid_boxes > 0 AND (zero_boxes > 0 OR recall_at_16 < 1))
  SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'validation' ELSE 'train' END AS split, CASE WHEN m.video_name IS NULL THEN 'other' ELSE reason END AS reason, count(*) AS n FROM supplier LEFT JOIN m ON m.video_name = s_suppkey GROUP BY 1, 2""")
def a31(spark, d):
    why = F.when((F.col("valid_boxes") > 0) & ((F.col("zero_boxes") > 0) | (F.col("recall_at_16") < 1)), F.array(F.lit("baseline_failure_or_recall16_below_1"))).otherwise(F.array(F.lit("other")))
    v = V.video_split(spark, d).join(video_table(spark, d), "video_name", "left").withColumn("reason", F.explode(F.coalesce(why, F.array(F.lit("other")))))
    return v.groupBy("split", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("f07_split_filter", "SELECT video_name, split FROM video_split WHERE split IN ('validation')", "video_split")
def f07(spark, d):
    return S.choose(V.video_split(spark, d), "split", ["validation"], forbidden=["test"])


@query("f07_unknown_splits", "SELECT 'smoke' AS split WHERE (SELECT count(*) FROM video_split WHERE split = 'smoke') = 0", "video_split")
def f07_unknown(spark, d):
    return S.unknown_values(V.video_split(spark, d), "split", ["train", "smoke"])


@query("s16_run_metadata", """SELECT '{"points":' || count(*) || ',"seed":"screen","videos":' || count(DISTINCT video_name) || '}' AS metadata FROM points""", "points")
def s16(spark, d):
    return S.run_metadata(V.points(spark, d), {"points": F.count(F.lit(1)), "videos": F.count_distinct("video_name"), "seed": F.lit("screen")})
