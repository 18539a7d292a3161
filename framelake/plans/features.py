"""Queries over point features, source flags, names and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import features as FE, flags as FL, names as N
from framelake.functions.ratios import NAN, NULL, ZERO, ratio
from framelake.operators import pointprep as PP
from framelake.operators.layout import percentiles
from framelake.plans import views as V
from framelake.plans.registry import query

R = lambda c, d=9: F.round(c, d)


@query("p01_scale_byte", "SELECT video_name, point_index, round(intensity / 255.0::DOUBLE, 9) AS v, round(alpha / 255.0::DOUBLE, 9) AS a FROM points", "points")
def p01(spark, d):
    return V.points(spark, d).select("video_name", "point_index", R(FE.scale_byte("intensity")).alias("v"), R(FE.scale_byte("alpha")).alias("a"))


@query("p02_frame_order_in_video", """
  SELECT video_name, point_index, round((frame_order - min(frame_order) OVER w) / greatest(max(frame_order) OVER w - min(frame_order) OVER w, 1)::DOUBLE, 9) AS v
  FROM points WINDOW w AS (PARTITION BY video_name)""", "points")
def p02(spark, d):
    p = PP.with_video_ranges(V.points(spark, d))
    return p.select("video_name", "point_index", R(FE.scale_order("frame_order", "min_frame", "max_frame")).alias("v"))


@query("p03_pixel_in_video", """
  SELECT video_name, point_index, round(pixel_x / greatest(max(pixel_x) OVER w, 1), 9) AS px, round(pixel_y / greatest(max(pixel_y) OVER w, 1), 9) AS py
  FROM points WINDOW w AS (PARTITION BY video_name)""", "points")
def p03(spark, d):
    p = PP.with_video_ranges(V.points(spark, d))
    return p.select("video_name", "point_index", R(FE.scale_pixel("pixel_x", "max_x")).alias("px"), R(FE.scale_pixel("pixel_y", "max_y")).alias("py"))


@query("p04_normalize_xyz", """
  WITH c AS (SELECT video_name, point_index, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM points WINDOW w AS (PARTITION BY video_name)),
  r AS (SELECT *, max(sqrt(x*x + y*y + z*z)) OVER (PARTITION BY video_name) AS m FROM c)
  SELECT video_name, point_index, round(x / m, 7) AS xn, round(y / m, 7) AS yn, round(z / m, 7) AS zn FROM r""", "points")
def p04(spark, d):
    return PP.normalize_xyz(V.points(spark, d)).select("video_name", "point_index", *[R(c, 7).alias(c) for c in ("xn", "yn", "zn")])


@query("p05_feature_vectors", """
  SELECT video_name, point_index, 6 AS channels, round(intensity/255.0::DOUBLE, 9) AS f1, round(confidence, 9) AS f2, round(alpha/255.0::DOUBLE, 9) AS f3,
    CAST(frame_order AS DOUBLE) AS f4, round(pixel_x / greatest(max(pixel_x) OVER w, 1), 9) AS f5, round(pixel_y / greatest(max(pixel_y) OVER w, 1), 9) AS f6
  FROM points WINDOW w AS (PARTITION BY video_name)""", "points")
def p05(spark, d):
    v = FE.feature_vector(["intensity", "confidence", "alpha", "frame_order", "pixel_xy"])
    p = PP.with_video_ranges(V.points(spark, d)).withColumn("f", v)
    return p.select("video_name", "point_index", F.size("f").alias("channels"), *[R(F.col("f").getItem(i)).alias(f"f{i + 1}") for i in range(6)])


@query("p06_merge_source_flags", """
  SELECT video_name, frame_order, pixel_x, pixel_y, bit_or(source_flags) AS flags, bit_or(source_flags) <> 0 AS selected, count(*) AS samples
  FROM points GROUP BY ALL""", "points")
def p06(spark, d):
    return V.points(spark, d).groupBy("video_name", "frame_order", "pixel_x", "pixel_y").agg(
        FL.merge_sources("source_flags").alias("flags"), F.count(F.lit(1)).alias("samples")).withColumn("selected", FL.any_source("flags"))


@query("p07_source_type", """
  SELECT source_flags, CASE WHEN source_flags & 1 <> 0 THEN 1 WHEN source_flags & 2 <> 0 THEN 2 WHEN source_flags & 4 <> 0 THEN 3
    WHEN source_flags & 8 <> 0 THEN 4 ELSE 0 END AS source_type, count(*) AS n FROM points GROUP BY 1, 2""", "points")
def p07(spark, d):
    return V.points(spark, d).groupBy("source_flags", FL.source_type("source_flags").alias("source_type")).agg(F.count(F.lit(1)).alias("n"))


@query("p08_source_confidence", """
  SELECT video_name, point_index, round(greatest(CASE WHEN source_flags & 1 <> 0 THEN confidence ELSE 0 END,
    CASE WHEN source_flags & 6 <> 0 THEN 0.7 ELSE 0 END), 9) AS sampling_confidence FROM points""", "points")
def p08(spark, d):
    return V.points(spark, d).select("video_name", "point_index", R(FL.source_confidence("source_flags", "confidence")).alias("sampling_confidence"))


@query("p09_backfill_sources", """
  SELECT video_name, point_index, CASE WHEN video_name % 2 = 0 THEN 1 ELSE 8 END AS source_flags, round(confidence, 9) AS sampling_confidence,
    true AS source_flags_inferred, true AS sampling_confidence_inferred FROM points""", "points")
def p09(spark, d):
    old = V.points(spark, d).drop("source_flags")
    mode = F.when(F.col("video_name") % 2 == 0, "foreground").otherwise("grid")
    out = PP.backfill_sources(old, mode)
    return out.select("video_name", "point_index", "source_flags", R("sampling_confidence").alias("sampling_confidence"),
                      "source_flags_inferred", "sampling_confidence_inferred")


@query("p19_outcome_category", """
  SELECT video_name, category, count(*) AS n FROM (SELECT video_name, CASE WHEN valid_mask THEN
      CASE WHEN point_label = 1 AND intensity >= 128 THEN 0 WHEN intensity >= 128 THEN 1 WHEN point_label = 1 THEN 2 ELSE 3 END
      WHEN intensity >= 128 THEN 4 ELSE 5 END AS category FROM points) GROUP BY 1, 2""", "points")
def p19(spark, d):
    p = V.points(spark, d).withColumn("pred_label", (F.col("intensity") >= 128).cast("int"))
    return p.groupBy("video_name", FE.outcome_category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("p21_video_names", r"""
  WITH u AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '  ' WHEN page_id % 3 = 1 THEN NULL ELSE ' clip ' || page_id || ' ' END AS attr,
    '/scans/' || CASE WHEN page_id % 2 = 0 THEN 'us_20240101_120000_' || page_id ELSE 'scan.' || page_id || '_points' END || '.h5' AS path FROM pages)
  SELECT page_id, coalesce(nullif(trim(attr), ''), nullif(regexp_extract(path, '\d{8}_\d{6}_\d+'), ''), 'scan.' || page_id) AS video_name,
    trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS safe FROM u""")
def p21(spark, d):
    i = F.col("page_id")
    u = V.table(spark, d, "pages").select(
        "page_id", "url",
        F.when(i % 3 == 0, "  ").when(i % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit(" clip "), i, F.lit(" "))).alias("attr"),
        F.concat(F.lit("/scans/"), F.when(i % 2 == 0, F.concat(F.lit("us_20240101_120000_"), i)).otherwise(
            F.concat(F.lit("scan."), i, F.lit("_points"))), F.lit(".h5")).alias("path"))
    return u.select("page_id", N.video_name("attr", "path", "_points").alias("video_name"), N.safe_name("url").alias("safe"))


@query("p23_config_ids", """
  SELECT l_suppkey, l_linenumber, l_returnflag, 'cfg_' || substr(h, 1, 12) AS config_id, h AS fingerprint FROM (
    SELECT l_suppkey, l_linenumber, l_returnflag, sha256('{"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '","l_suppkey":' || l_suppkey || '}') AS h
    FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem))""")
def p23(spark, d):
    fields = ["l_suppkey", "l_linenumber", "l_returnflag"]
    c = V.table(spark, d, "lineitem").select(*fields).distinct()
    return c.select(*fields, N.config_id(fields).alias("config_id"), N.fingerprint(fields).alias("fingerprint"))


@query("p24_ratio_policies", """
  SELECT video_name, round(coalesce(pos / nullif(n8, 0)::DOUBLE, 0), 9) AS on_zero, round(pos / nullif(n8, 0)::DOUBLE, 9) AS on_null,
    CASE WHEN n8 = 0 THEN 'nan'::DOUBLE ELSE round(pos / n8::DOUBLE, 9) END AS on_nan FROM (
    SELECT video_name * 40 + frame_order AS video_name, count(*) FILTER (point_label = 1) AS pos, count(*) FILTER (source_flags = 8) AS n8 FROM points GROUP BY 1)""", "points")
def p24(spark, d):
    g = V.points(spark, d).groupBy((F.col("video_name") * 40 + F.col("frame_order")).alias("video_name")).agg(
        F.count_if(F.col("point_label") == 1).alias("pos"), F.count_if(F.col("source_flags") == 8).alias("n8"))
    return g.select("video_name", R(ratio("pos", "n8", ZERO)).alias("on_zero"), R(ratio("pos", "n8", NULL)).alias("on_null"),
                    R(ratio("pos", "n8", NAN)).alias("on_nan"))


@query("p25_source_ablation", """
  SELECT bit, source_flags & (65535 - bit) AS left_flags, count(*) AS n FROM points, (VALUES (1), (2), (4), (8)) b(bit) GROUP BY 1, 2""", "points")
def p25(spark, d):
    each = F.array(*[F.struct(F.lit(b).alias("bit"), FL.without_source("source_flags", s).alias("left_flags")) for s, b in FL.SOURCE_BITS.items()])
    return V.points(spark, d).select(F.explode(each).alias("a")).groupBy("a.bit", "a.left_flags").agg(F.count(F.lit(1)).alias("n"))


@query("f01_metric_mask", "SELECT video_name, count(*) FILTER (valid_mask AND point_label <> -1) AS counted, count(*) AS total FROM points GROUP BY 1", "points")
def f01(spark, d):
    return V.points(spark, d).groupBy("video_name").agg(F.count_if(FE.counted()).alias("counted"), F.count(F.lit(1)).alias("total"))


@query("f02_candidates_with_fallback", """
  SELECT video_name, point_index FROM (SELECT *, bool_or(valid_mask) OVER (PARTITION BY video_name) AS any_ok
    FROM (SELECT * REPLACE (valid_mask AND video_name % 4 <> 0 AS valid_mask) FROM points)) WHERE valid_mask OR NOT any_ok""", "points")
def f02(spark, d):
    p = V.points(spark, d).withColumn("valid_mask", F.col("valid_mask") & (F.col("video_name") % 4 != 0))
    return PP.candidates(p).select("video_name", "point_index")


@query("f05_grid_masks", """
  SELECT video_name, count(*) FILTER (px % 4 = 0 AND py % 4 = 0) AS origin, count(*) FILTER (px >= 2 AND py >= 2 AND (px-2) % 4 = 0 AND (py-2) % 4 = 0) AS centred,
    count(*) FILTER ((px % 4 = 0 AND py % 4 = 0) OR (px >= 2 AND py >= 2 AND (px-2) % 4 = 0 AND (py-2) % 4 = 0)) AS dual
  FROM (SELECT video_name, CAST(pixel_x AS INT) AS px, CAST(pixel_y AS INT) AS py FROM points) GROUP BY 1""", "points")
def f05(spark, d):
    p = V.points(spark, d)
    x, y = F.col("pixel_x").cast("int"), F.col("pixel_y").cast("int")
    return p.groupBy("video_name").agg(*[F.count_if(FE.grid_mask(x, y, 4, ph)).alias(n) for n, ph in
                                         (("origin", "origin"), ("centred", "centered"), ("dual", "dual"))])


@query("f06_foreground", """
  SELECT video_name, count(*) FILTER (alpha >= 40) AS by_alpha, count(*) AS by_all, count(*) FILTER (intensity > 0) AS by_nonzero,
    count(*) FILTER (intensity >= 100 AND px % 2 = 0 AND py % 2 = 0) AS by_intensity_grid
  FROM (SELECT *, CAST(pixel_x AS INT) AS px, CAST(pixel_y AS INT) AS py FROM points) GROUP BY 1""", "points")
def f06(spark, d):
    fg = FE.foreground
    return V.points(spark, d).groupBy("video_name").agg(
        F.count_if(fg("alpha", 40)).alias("by_alpha"), F.count_if(fg("all")).alias("by_all"), F.count_if(fg("nonzero")).alias("by_nonzero"),
        F.count_if(fg("intensity", 100, 2)).alias("by_intensity_grid"))


@query("f08_label_selection", """
  SELECT video_name, point_index, point_label FROM points WHERE valid_mask AND point_label IN (1)""", "points")
def f08(spark, d):
    return V.points(spark, d).filter(FE.in_labels([1])).select("video_name", "point_index", "point_label")


LABELS_SQL = """count(*) AS total, count(*) FILTER (point_label = 1) AS positive, count(*) FILTER (point_label = 0) AS background, count(*) FILTER (point_label = -1) AS ignored"""


@query("a08_label_counts", f"""
  SELECT *, round(positive / total::DOUBLE, 9) AS positive_ratio, round(background / total::DOUBLE, 9) AS background_ratio,
    round(ignored / total::DOUBLE, 9) AS ignore_ratio, round((positive + background) / total::DOUBLE, 9) AS useful_ratio
  FROM (SELECT video_name, frame_order, {LABELS_SQL} FROM points GROUP BY 1, 2)""", "points")
def a08(spark, d):
    out = PP.label_counts(V.points(spark, d), ["video_name", "frame_order"])
    return out.select(*[R(c).alias(c) if c.endswith("ratio") else c for c in out.columns])


def _source_sql():
    g = {s: f"source_flags & {b} <> 0" for s, b in FL.SOURCE_BITS.items()} | {"context_only": "source_flags = 8"}
    l = {"selected": "true", "positive": "point_label = 1", "background": "point_label = 0", "ignored": "point_label = -1"}
    return ", ".join(f"count(*) FILTER ({ge} AND {le}) AS {gn}_{ln}" for gn, ge in g.items() for ln, le in l.items())


@query("a09_source_label_counts", f"SELECT video_name, {_source_sql()} FROM points GROUP BY 1", "points")
def a09(spark, d):
    return PP.source_label_counts(V.points(spark, d), ["video_name"])


@query("a09_source_names", """
  SELECT source, point_label, count(*) AS n FROM points, (VALUES ('global', 1), ('local', 2), ('tophat', 4), ('context', 8)) s(source, bit)
  WHERE source_flags & bit <> 0 GROUP BY 1, 2""", "points")
def a09_long(spark, d):
    return V.points(spark, d).select(F.explode(FL.source_names("source_flags")).alias("source"), "point_label").groupBy(
        "source", "point_label").agg(F.count(F.lit(1)).alias("n"))


@query("a10_source_summary", """
  SELECT video_name, count(*) AS total, count(*) FILTER (source_flags & 1 <> 0) AS global_points, count(*) FILTER (source_flags & 2 <> 0) AS local_points,
    count(*) FILTER (source_flags & 4 <> 0) AS tophat_points, count(*) FILTER (source_flags & 8 <> 0) AS context_points,
    count(*) FILTER (source_flags & 7 <> 0) AS evidence_points, count(*) FILTER (bit_count(source_flags) > 1) AS overlap_points,
    count(*) FILTER (source_flags = 8) AS context_only_points, round(count(*) / count(*) FILTER (source_flags & 1 <> 0)::DOUBLE, 9) AS multiplier
  FROM points GROUP BY 1""", "points")
def a10(spark, d):
    return PP.source_summary(V.points(spark, d), ["video_name"]).withColumn("multiplier", R("multiplier"))


@query("a11_frame_count_statistics", """
  WITH spine AS (SELECT s_suppkey AS video_name, f AS frame_order FROM supplier, generate_series(0, 39) g(f)),
  n AS (SELECT s.video_name, s.frame_order, count(p.point_index) AS num_points FROM spine s
    LEFT JOIN points p USING (video_name, frame_order) GROUP BY 1, 2)
  SELECT video_name, min(num_points) AS lowest, round(avg(num_points), 9) AS mean, round(median(num_points), 9) AS middle, max(num_points) AS highest,
    count(*) FILTER (num_points = 0) AS empty_frames FROM n GROUP BY 1""", "points")
def a11(spark, d):
    spine = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("video_name"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("frame_order"))
    n = PP.frame_counts(V.points(spark, d), spine)
    mid = percentiles(n, ["video_name"], "num_points", {"middle": 0.5})
    agg = n.groupBy("video_name").agg(F.min("num_points").alias("lowest"), R(F.avg("num_points")).alias("mean"), F.max("num_points").alias("highest"),
                                      F.count_if(F.col("num_points") == 0).alias("empty_frames"))
    return agg.join(mid.withColumn("middle", R("middle")), "video_name")
