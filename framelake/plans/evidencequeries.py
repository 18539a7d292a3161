"""Queries over neighbourhood evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import evidence as E
from framelake.plans import views as V
from framelake.plans.boxqueries import rounded
from framelake.plans.registry import query


@query("f11_threshold_per_frame", """
  WITH r AS (SELECT video_name, frame_order, point_index, intensity - 120 AS response FROM points), t AS (SELECT video_name, frame_order, quantile_cont(response, 0.85) FILTER (response > 0) AS t FROM r GROUP BY 1, 2)
  SELECT r.video_name, r.frame_order, point_index, coalesce(response >= t AND response >= 20, false) AS selected FROM r JOIN t USING (video_name, frame_order)""", "points")
def f11(spark, d):
    p = V.points(spark, d).select("video_name", "frame_order", "point_index", (F.col("intensity") - 120).alias("response"))
    return E.threshold_per_group(p, ["video_name", "frame_order"], "response", 85, 20).drop("response")


@query("w15_local_percentile", """
  SELECT video_name, frame_order, round(quantile_cont(value, 0.8) OVER w, 6) AS threshold, round(value - quantile_cont(value, 0.5) OVER w, 6) AS contrast,
    value >= quantile_cont(value, 0.8) OVER w AND value - quantile_cont(value, 0.5) OVER w >= 4 AS selected
  FROM frames WINDOW w AS (PARTITION BY video_name ORDER BY frame_order ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""", "frames")
def w15(spark, d):
    f = V.frames(spark, d).select("video_name", "frame_order", "value")
    return rounded(E.local_percentile(f, "value", 15, 80, 4.0).drop("value"))


TOPHAT_SQL = """e AS (SELECT video_name, frame_order, value, min(value) OVER w AS e FROM frames WINDOW w AS (PARTITION BY video_name ORDER BY frame_order ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  h AS (SELECT video_name, frame_order, value - max(e) OVER w AS response FROM e WINDOW w AS (PARTITION BY video_name ORDER BY frame_order ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""


@query("w16_top_hat", f"""
  WITH {TOPHAT_SQL}, t AS (SELECT video_name, quantile_cont(response, 0.85) FILTER (response > 0) AS t FROM h GROUP BY 1)
  SELECT video_name, frame_order, round(response, 6) AS response, coalesce(response >= t AND response >= 2, false) AS selected FROM h JOIN t USING (video_name)""", "frames")
def w16(spark, d):
    f = V.frames(spark, d).select("video_name", "frame_order", "value")
    return rounded(E.threshold_per_group(E.top_hat(f, "value", 7), ["video_name"], "response", 85, 2.0, spread="frame_order").drop("value"))


@query("w17_clean_runs", """
  WITH b AS (SELECT video_name, frame_order, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS b FROM frames), a1 AS (SELECT *, min(b) OVER w AS x FROM b WINDOW w AS (PARTITION BY video_name ORDER BY frame_order ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
  a2 AS (SELECT * EXCLUDE (x), max(x) OVER w AS x FROM a1 WINDOW w AS (PARTITION BY video_name ORDER BY frame_order ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
  a3 AS (SELECT * EXCLUDE (x), max(x) OVER w AS x FROM a2 WINDOW w AS (PARTITION BY video_name ORDER BY frame_order ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  a4 AS (SELECT * EXCLUDE (x), min(x) OVER w AS x FROM a3 WINDOW w AS (PARTITION BY video_name ORDER BY frame_order ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  g AS (SELECT *, sum(c) OVER (PARTITION BY video_name ORDER BY frame_order) AS g FROM (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY video_name ORDER BY frame_order) = x THEN 0 ELSE 1 END AS c FROM a4))
  SELECT video_name, frame_order, b = 1 AS flag, x = 1 AND count(*) OVER (PARTITION BY video_name, g) >= 4 AS cleaned FROM g""", "frames")
def w17(spark, d):
    f = V.frames(spark, d).select("video_name", "frame_order", (F.col("value") >= 20).alias("flag"))
    return E.clean_runs(f, "flag", 3, 5, 4)


@query("w18_components", """
  WITH RECURSIVE c AS (SELECT video_name, frame_order, x, y FROM cells), reach AS (
    SELECT video_name, frame_order, x, y, y AS ly, x AS lx FROM c
    UNION SELECT c.video_name, c.frame_order, c.x, c.y, r.ly, r.lx FROM reach r JOIN c ON c.video_name = r.video_name AND c.frame_order = r.frame_order AND abs(c.x - r.x) <= 1 AND abs(c.y - r.y) <= 1 AND (c.x, c.y) <> (r.x, r.y))
  SELECT video_name, frame_order, x, y, CAST(min(ly) AS INTEGER) AS comp_y, CAST(arg_min(lx, ly * 100 + lx) AS INTEGER) AS comp_x FROM reach GROUP BY 1, 2, 3, 4""", "cells")
def w18(spark, d):
    return E.components(V.cells(spark, d))


@query("w15_w16_grid_evidence")
def grid(spark, d):
    return E.grid_evidence(V.cells(spark, d), 51, 11, 5, 80, 4.0, 3, 85, 2.0)


@query("w17_grid_evidence_cleaned")
def grid_clean(spark, d):
    return E.grid_evidence(V.cells(spark, d), 51, 11, 5, 80, 4.0, 3, 85, 2.0, close_size=3, min_area=3)


@query("a27_frame_brightness", """
  SELECT video_name, frame_order, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) AS spread,
    round(avg((value >= 180)::INT), 6) AS bright_share, round(avg((value >= 20)::INT), 6) AS lit_share FROM cells GROUP BY 1, 2""", "cells")
def a27(spark, d):
    return rounded(E.brightness(V.cells(spark, d), ["video_name", "frame_order"]))


@query("j15_frame_difference", """
  SELECT video_name, frame_order, round(avg(d), 6) AS diff_mean, round(stddev_pop(d), 6) AS diff_std, count(*) AS pixels FROM (
    SELECT a.video_name, a.frame_order, abs(a.value - b.value) AS d FROM cells a JOIN cells b ON a.video_name = b.video_name AND a.frame_order = b.frame_order + 1 AND a.x = b.x AND a.y = b.y) GROUP BY 1, 2""", "cells")
def j15(spark, d):
    return rounded(E.frame_difference(V.cells(spark, d)))
