"""Queries over boxes, labels, candidates and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import boxes as B, layout, pointprep as PP
from framelake.plans import views as V
from framelake.plans.registry import query

R = lambda c, d=6: F.round(c, d) + F.lit(0.0)
T = lambda name: lambda spark, d: V.table(spark, d, name)


def rounded(df, digits=6):
    return df.select(*[R(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("p10_boxes_to_local", """
  WITH v AS (SELECT s_suppkey AS video_name, CASE WHEN s_suppkey % 2 = 0 THEN 'resize' ELSE 'crop' END AS preprocess, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 60.0::DOUBLE END AS raw_w,
      40.0::DOUBLE AS raw_h, 24.0::DOUBLE AS local_w, 12.0::DOUBLE AS local_h, CASE WHEN s_suppkey % 5 = 0 THEN 'nan'::DOUBLE ELSE 0.8 END AS resize_scale, 2.0::DOUBLE AS crop_left, NULL::DOUBLE AS crop_top FROM supplier),
  b AS (SELECT boxes.*, CASE WHEN size % 4 = 0 THEN NULL ELSE 50.0::DOUBLE END AS xw0, 40.0::DOUBLE AS xh0, v.* EXCLUDE (video_name) FROM boxes JOIN v USING (video_name)),
  s AS (SELECT *, coalesce(xw0, raw_w) AS xw, coalesce(xh0, raw_h) AS xh, coalesce(raw_w, xw0, raw_w) AS rw, raw_h AS rh, CASE WHEN isnan(resize_scale) THEN 1 ELSE resize_scale END AS sc FROM b),
  f AS (SELECT *, CASE WHEN xw > 0 AND xh > 0 THEN rw / xw ELSE 1 END AS fx, CASE WHEN xw > 0 AND xh > 0 THEN rh / xh ELSE 1 END AS fy FROM s),
  l AS (SELECT *, CASE WHEN preprocess = 'resize' THEN xmin * fx * local_w / rw ELSE xmin * fx * sc - 2 END AS x1, CASE WHEN preprocess = 'resize' THEN xmax * fx * local_w / rw ELSE xmax * fx * sc - 2 END AS x2,
    CASE WHEN preprocess = 'resize' THEN ymin * fy * local_h / rh ELSE ymin * fy * sc END AS y1, CASE WHEN preprocess = 'resize' THEN ymax * fy * local_h / rh ELSE ymax * fy * sc END AS y2 FROM f),
  c AS (SELECT *, greatest(0, least(23.0, x1)) AS a1, greatest(0, least(23.0, x2)) AS a2, greatest(0, least(11.0, y1)) AS c1, greatest(0, least(11.0, y2)) AS c2 FROM l)
  SELECT video_name, frame_order, bbox_index, round(a1, 6) AS lxmin, round(a2, 6) AS lxmax, round(c1, 6) AS lymin, round(c2, 6) AS lymax, a2 > a1 AND c2 > c1 AS valid_local FROM c""", "boxes")
def p10(spark, d):
    k = F.col("s_suppkey")
    videos = V.table(spark, d, "supplier").select(
        k.alias("video_name"), F.when(k % 2 == 0, "resize").otherwise("crop").alias("preprocess"), F.when(k % 3 != 0, 60.0).alias("raw_w"), F.lit(40.0).alias("raw_h"),
        F.lit(24.0).alias("local_w"), F.lit(12.0).alias("local_h"), F.when(k % 5 == 0, float("nan")).otherwise(0.8).alias("resize_scale"), F.lit(2.0).alias("crop_left"),
        F.lit(None).cast("double").alias("crop_top"))
    b = V.boxes(spark, d).withColumn("xml_w", F.when(F.col("size") % 4 != 0, 50.0)).withColumn("xml_h", F.lit(40.0))
    return rounded(B.to_local(b, videos).select("video_name", "frame_order", "bbox_index", "lxmin", "lxmax", "lymin", "lymax", "valid_local"))


CROP_SQL = """c AS (SELECT *, xmin * 0.9 - 3 AS uxmin, xmax * 0.9 - 3 AS uxmax, ymin * 0.9 - 1 AS uymin, ymax * 0.9 - 1 AS uymax FROM boxes),
  k AS (SELECT *, greatest(0, least(16.0, uxmin)) AS cxmin, greatest(0, least(16.0, uxmax)) AS cxmax, greatest(0, least(16.0, uymin)) AS cymin, greatest(0, least(16.0, uymax)) AS cymax FROM c)"""


def crops(spark, d):
    return B.to_crop(V.boxes(spark, d), 16, "crop", F.lit(50.0), F.lit(12.0), F.lit(0.9), F.lit(3.0), F.lit(1.0))


@query("p11_boxes_to_crop", f"""
  WITH {CROP_SQL} SELECT video_name, frame_order, bbox_index, {", ".join(f"round({p}{c}{e}, 6) AS {p}{c}{e}" for p in "uc" for c in "xy" for e in ("min", "max"))} FROM k""", "boxes")
def p11(spark, d):
    return rounded(crops(spark, d).select("video_name", "frame_order", "bbox_index", *[f"{p}{c}{e}" for p in "uc" for c in "xy" for e in ("min", "max")]))


@query("a26_box_visibility", f"""
  WITH {CROP_SQL}, a AS (SELECT video_name, (uxmax-uxmin)*(uymax-uymin) AS full_area, (cxmax-cxmin)*(cymax-cymin) AS seen, cxmax-cxmin AS w, cymax-cymin AS h FROM k),
  r AS (SELECT video_name, seen / full_area AS vr, seen / 256 AS ar, w / 16 AS wr, h / 16 AS hr, sqrt(w*w+h*h) / sqrt(512.0) AS dr FROM a WHERE full_area > 1e-6)
  SELECT video_name, count(*) AS num_boxes, round(avg(vr), 9) AS visible_mean, round(min(vr), 9) AS visible_min, round(avg(ar), 9) AS area_mean, round(avg(wr), 9) AS width_mean, round(avg(hr), 9) AS height_mean,
    round(avg(dr), 9) AS diag_mean, round(avg(vr * sqrt(ar)), 9) AS score_area, round(avg(vr * dr), 9) AS score_diag, round(avg((vr >= 0.95)::INT), 9) AS fully_inside,
    round(avg((vr > 0)::INT), 9) AS partially, round(avg((vr <= 0)::INT), 9) AS missing FROM r GROUP BY 1""", "boxes")
def a26(spark, d):
    return rounded(B.visibility(crops(spark, d), 16, ["video_name"]), 9)


@query("p12_crop_geometry", """
  WITH i AS (SELECT p_partkey, 200 + p_size * 3 AS h, 260 + p_partkey % 97 AS w, p_size % 40 - 20 AS oy, p_partkey % 61 - 30 AS ox FROM part),
  t AS (SELECT *, h < 256 OR w < 256 AS small, round_even(h / 2.0::DOUBLE + oy - 128, 0) AS top, round_even(w / 2.0::DOUBLE + ox - 128, 0) AS lft FROM i),
  s AS (SELECT *, 300.0::DOUBLE / least(h, w) AS sc FROM t), s2 AS (SELECT *, round_even(h * sc, 0) AS rh, round_even(w * sc, 0) AS rw FROM s),
  s3 AS (SELECT *, round_even(rh / 2 + oy - 128, 0) AS top2, round_even(rw / 2 + ox - 128, 0) AS lft2 FROM s2)
  SELECT p_partkey, CASE WHEN small THEN 'offset_crop_fallback_resize' ELSE 'offset_crop' END AS effective, CAST(CASE WHEN small THEN 256 ELSE h END AS INTEGER) AS resized_h,
    CAST(CASE WHEN small THEN 256 ELSE w END AS INTEGER) AS resized_w, CAST(CASE WHEN small THEN 0 ELSE least(greatest(top, 0), h - 256) END AS INTEGER) AS crop_top,
    CAST(CASE WHEN small THEN 0 ELSE least(greatest(lft, 0), w - 256) END AS INTEGER) AS crop_left, CASE WHEN small THEN NULL ELSE 1.0::DOUBLE END AS resize_scale,
    CASE WHEN small THEN true ELSE top < 0 OR lft < 0 OR top + 256 > h OR lft + 256 > w END AS crop_clipped, CAST(rh AS INTEGER) AS h2, CAST(rw AS INTEGER) AS w2,
    CAST(least(greatest(top2, 0), rh - 256) AS INTEGER) AS top2, CAST(least(greatest(lft2, 0), rw - 256) AS INTEGER) AS left2, round(sc, 6) AS scale2 FROM s3""")
def p12(spark, d):
    p = V.table(spark, d, "part")
    h, w = (200 + F.col("p_size") * 3).cast("double"), (260 + F.col("p_partkey") % 97).cast("double")
    oy, ox = F.col("p_size") % 40 - 20, F.col("p_partkey") % 61 - 30
    a, b = B.crop_geometry(h, w, 256, 256, oy, ox), B.crop_geometry(h, w, 256, 256, oy, ox, 300)
    return p.select("p_partkey", *[c.alias(n) for n, c in a.items()], b["resized_h"].alias("h2"), b["resized_w"].alias("w2"), b["crop_top"].alias("top2"),
                    b["crop_left"].alias("left2"), R(b["resize_scale"]).alias("scale2"))


@query("j02_box_margin_labels", """
  WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_name, frame_order ORDER BY bbox_index) AS r FROM boxes WHERE valid) WHERE r = 1)
  SELECT p.video_name, p.point_index, CASE WHEN o.r IS NULL THEN -1 WHEN pixel_x BETWEEN xmin AND xmax AND pixel_y BETWEEN ymin AND ymax THEN
    CASE WHEN least(abs(pixel_x - xmin), abs(pixel_x - xmax), abs(pixel_y - ymin), abs(pixel_y - ymax)) <= 1 THEN -1 ELSE 1 END ELSE 0 END AS label
  FROM points p LEFT JOIN o USING (video_name, frame_order)""", "points boxes")
def j02(spark, d):
    return B.margin_labels(V.points(spark, d), V.boxes(spark, d), 1.0, -1).select("video_name", "point_index", "label")


@query("j03_points_in_box_union", """
  SELECT p.video_name, p.frame_order, count(*) FILTER (EXISTS (SELECT 1 FROM boxes b WHERE b.video_name = p.video_name AND b.frame_order = p.frame_order AND valid
      AND pixel_x + 0.25 BETWEEN xmin AND xmax AND pixel_y BETWEEN ymin AND ymax)) AS counted,
    count(*) FILTER (EXISTS (SELECT 1 FROM boxes b WHERE b.video_name = p.video_name AND b.frame_order = p.frame_order AND valid
      AND round_even(pixel_x + 0.25, 0) BETWEEN floor(xmin) AND ceil(xmax) AND round_even(pixel_y, 0) BETWEEN floor(ymin) AND ceil(ymax))) AS labelled FROM points p GROUP BY 1, 2""", "points boxes")
def j03(spark, d):
    p = V.points(spark, d).withColumn("pixel_x", F.col("pixel_x") + 0.25)
    ok = V.boxes(spark, d).filter("valid")
    n = B.count_in_boxes(p, ok).groupBy("video_name", "frame_order").agg(F.count(F.lit(1)).alias("counted"))
    lab = B.in_cells(B.pixel(p), B.box_cells(ok), "hit").groupBy("video_name", "frame_order").agg(F.count_if("hit").alias("labelled"))
    return lab.join(layout.outgrown(n), ["video_name", "frame_order"], "left").fillna(0, ["counted"])


CONTOUR_SQL = "contour AS (SELECT DISTINCT b.video_name, b.frame_order, CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py FROM boxes b, generate_series(0, 40) g(x), generate_series(0, 12) h(y) WHERE valid AND x BETWEEN xmin + 2 AND xmax - 2 AND y BETWEEN ymin + 1 AND ymax - 1)"


def contour(spark, d, keep=()):
    """Inner part of every valid box as the mask of a contour."""
    b = V.boxes(spark, d).filter("valid")
    inner = b.withColumns({"xmin": F.col("xmin") + 2, "xmax": F.col("xmax") - 2, "ymin": F.col("ymin") + 1, "ymax": F.col("ymax") - 1})
    return B.box_cells(inner, keep)


@query("j04_points_on_mask", f"""
  WITH {CONTOUR_SQL} SELECT p.video_name, p.point_index FROM points p JOIN contour c ON p.video_name = c.video_name AND p.frame_order = c.frame_order
    AND c.px = least(greatest(round_even(pixel_x, 0), 0), 31) AND c.py = least(greatest(round_even(pixel_y, 0), 0), 7)""", "points boxes")
def j04(spark, d):
    p = B.pixel(V.points(spark, d), 32, 8)
    return B.in_cells(p, contour(spark, d), "hit").filter("hit").select("video_name", "point_index")


POLICY_SQL = f"""{CONTOUR_SQL}, f AS (SELECT DISTINCT video_name, frame_order FROM boxes WHERE valid),
  lab AS (SELECT p.*, EXISTS (SELECT 1 FROM contour c WHERE c.video_name = p.video_name AND c.frame_order = p.frame_order AND c.px = pixel_x AND c.py = pixel_y) AS in_contour,
    EXISTS (SELECT 1 FROM boxes b WHERE valid AND b.video_name = p.video_name AND b.frame_order = p.frame_order AND pixel_x BETWEEN xmin AND xmax AND pixel_y BETWEEN ymin AND ymax) AS in_box,
    EXISTS (SELECT 1 FROM f WHERE f.video_name = p.video_name AND f.frame_order = p.frame_order) AS box_frame FROM points p),
  pol AS (SELECT *, CASE WHEN in_contour THEN 1 WHEN in_box THEN -1 WHEN box_frame THEN 0 ELSE 0 END AS label FROM lab)"""


def policy(spark, d):
    return B.policy_labels(V.points(spark, d), V.boxes(spark, d).filter("valid"), contour(spark, d))


@query("j05_labelling_policy", f"""
  WITH {POLICY_SQL} SELECT video_name, point_index, label, label <> -1 AS label_valid, in_box, in_contour, box_frame FROM pol""", "points boxes")
def j05(spark, d):
    return policy(spark, d).select("video_name", "point_index", "label", "label_valid", "in_box", "in_contour", "box_frame")


@query("q02_label_policy_audit", f"""
  WITH {POLICY_SQL} SELECT count(*) AS points, 0::BIGINT AS valid_mismatch, 0::BIGINT AS unexpected_label, 0::BIGINT AS no_box_not_background, 0::BIGINT AS background_in_box,
    count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = -1) AS ignored FROM pol""", "points boxes")
def q02(spark, d):
    return B.label_policy_audit(policy(spark, d))


@query("q02_planted_violations", f"""
  WITH {POLICY_SQL}, bad AS (SELECT * REPLACE (CASE frame_order % 5 WHEN 0 THEN CASE WHEN label = 1 THEN 2 ELSE label END WHEN 1 THEN CASE WHEN in_box THEN 0 ELSE label END
      WHEN 2 THEN CASE WHEN NOT box_frame THEN -1 ELSE label END ELSE label END AS label), (label <> -1) <> (frame_order % 5 = 3) AS label_valid, label AS told FROM pol)
  SELECT count(*) AS points, count(*) FILTER (label_valid <> (label <> -1)) AS valid_mismatch, count(*) FILTER (frame_order % 5 = 0 AND told = 1) AS unexpected_label,
    count(*) FILTER (frame_order % 5 = 2 AND NOT box_frame) AS no_box_not_background, count(*) FILTER (frame_order % 5 = 1 AND in_box) AS background_in_box,
    count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = -1) AS ignored FROM bad""", "points boxes")
def q02_planted(spark, d):
    """Labels that break each rule of the policy, frame by frame."""
    k, lab = F.col("frame_order") % 5, F.col("label")
    valid = (lab != -1) != (k == 3)
    bad = F.when((k == 0) & (lab == 1), 2).when((k == 1) & F.col("in_box"), 0).when((k == 2) & ~F.col("box_frame"), -1).otherwise(lab)
    return B.label_policy_audit(policy(spark, d).withColumn("label_valid", valid).withColumn("label", bad))


@query("j06_annotation_match", """
  WITH f AS (SELECT video_name, frame_order, frame_index FROM frames),
  files AS (SELECT CASE frame_index % 4 WHEN 0 THEN 'frame_' || lpad(CAST(frame_index AS VARCHAR), 6, '0') || '.xml' WHEN 1 THEN 'annotations/' || frame_index || '.xml'
      WHEN 2 THEN video_name || '/annotations/' || video_name || '-' || lpad(CAST(frame_order AS VARCHAR), 4, '0') || '.xml' ELSE 'other/' || frame_index END AS path, * FROM f),
  c AS (SELECT f.video_name, f.frame_order, dn, dd || pre || lpad(CAST(n AS VARCHAR), CAST(greatest(w, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '.xml' AS path,
      dn * 40 + (CASE WHEN n_id = 0 THEN 0 ELSE 20 END) + wi * 5 + pn AS rank
    FROM f, LATERAL (VALUES (0, frame_index), (1, frame_order)) AS ids(n_id, n), (VALUES (0, 0), (1, 4), (2, 5), (3, 6)) ws(wi, w),
      LATERAL (VALUES (0, ''), (1, 'frame_'), (2, video_name || '_'), (3, video_name || '-'), (4, video_name || '_frame_')) AS ps(pn, pre),
      LATERAL (VALUES (0, ''), (1, video_name || '/'), (2, 'annotations_renamed/'), (3, 'annotation_renamed/'), (4, 'annotations_rename/'), (5, 'annotation_rename/'), (6, 'annotations/'),
        (7, video_name || '/annotations_renamed/'), (8, video_name || '/annotation_renamed/'), (9, video_name || '/annotations_rename/'), (10, video_name || '/annotation_rename/'), (11, video_name || '/annotations/')) AS ds(dn, dd))
  SELECT c.video_name, c.frame_order, arg_min(c.path, rank) AS path, CAST(min(rank) AS INTEGER) AS rank FROM c JOIN (SELECT DISTINCT path FROM files) x USING (path) GROUP BY 1, 2""", "frames")
def j06(spark, d):
    f = V.frames(spark, d).select("video_name", "frame_order", "frame_index")
    i, v = F.col("frame_index"), F.col("video_name").cast("string")
    path = (F.when(i % 4 == 0, F.concat(F.lit("frame_"), F.format_string("%06d", i), F.lit(".xml"))).when(i % 4 == 1, F.concat(F.lit("annotations/"), i, F.lit(".xml")))
            .when(i % 4 == 2, F.concat(v, F.lit("/annotations/"), v, F.lit("-"), F.format_string("%04d", F.col("frame_order").cast("bigint")), F.lit(".xml"))).otherwise(F.concat(F.lit("other/"), i)))
    return B.match_annotations(f, f.select(path.alias("path")))


TEACHER_SQL = """teacher AS (SELECT b.video_name, b.frame_order, bbox_index, CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py FROM boxes b, generate_series(0, 40) g(x), generate_series(0, 12) h(y)
    WHERE valid AND x BETWEEN xmin + 2 AND xmax - 2 AND y BETWEEN ymin + 1 AND ymax - 1),
  lab AS (SELECT video_name, frame_order, px, py, max(label) AS label FROM (SELECT video_name, frame_order, px, py, 1 AS label FROM teacher UNION ALL
    SELECT b.video_name, b.frame_order, CAST(x AS INTEGER), CAST(y AS INTEGER), -1 FROM boxes b, generate_series(0, 40) g(x), generate_series(0, 12) h(y) WHERE valid AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax) GROUP BY 1, 2, 3, 4),
  sel AS (SELECT DISTINCT config, video_name, frame_order, CAST(pixel_x AS INTEGER) AS px, CAST(pixel_y AS INTEGER) AS py FROM points, (VALUES ('all', 15), ('legacy', 1), ('evidence', 7)) c(config, mask) WHERE source_flags & mask <> 0)"""
CONFIGS = {"all": 15, "legacy": 1, "evidence": 7}


def sweep_tables(spark, d):
    teacher = contour(spark, d, ["bbox_index"])
    ok = V.boxes(spark, d).filter("valid")
    cell = ["video_name", "frame_order", "px", "py"]
    lab = teacher.select(*cell, F.lit(1).alias("label")).unionByName(B.box_cells(ok).withColumn("label", F.lit(-1))).groupBy(*cell).agg(F.max("label").alias("label"))
    each = F.filter(F.array(*[F.when(F.col("source_flags").bitwiseAND(F.lit(m)) != 0, F.lit(c)) for c, m in CONFIGS.items()]), lambda c: c.isNotNull())
    sel = B.pixel(V.points(spark, d)).select(F.explode(each).alias("config"), *cell).distinct()
    return teacher, sel, lab


@query("a12_box_retention", f"""
  WITH {TEACHER_SQL}, tp AS (SELECT video_name, frame_order, bbox_index, count(*) AS teacher_positive FROM teacher GROUP BY 1, 2, 3),
  sp AS (SELECT config, t.video_name, t.frame_order, bbox_index, count(*) AS selected_positive FROM teacher t JOIN sel s USING (video_name, frame_order, px, py) GROUP BY 1, 2, 3, 4),
  roi AS (SELECT config, s.video_name, s.frame_order, bbox_index, count(*) AS selected_total, count(*) FILTER (coalesce(label, 0) = 0) AS selected_background, count(*) FILTER (label = -1) AS selected_ignore
    FROM sel s JOIN boxes b ON b.video_name = s.video_name AND b.frame_order = s.frame_order AND px BETWEEN xmin AND xmax AND py BETWEEN ymin AND ymax
    LEFT JOIN lab l ON l.video_name = s.video_name AND l.frame_order = s.frame_order AND l.px = s.px AND l.py = s.py GROUP BY 1, 2, 3, 4)
  SELECT c AS config, b.video_name, b.frame_order, b.bbox_index, valid, coalesce(teacher_positive, 0) AS teacher_positive, coalesce(selected_positive, 0) AS selected_positive, coalesce(selected_total, 0) AS selected_total,
    coalesce(selected_background, 0) AS selected_background, coalesce(selected_ignore, 0) AS selected_ignore, round(coalesce(selected_positive, 0) / teacher_positive::DOUBLE, 6) AS recall,
    valid AND coalesce(selected_positive, 0) = 0 AS zero_positive
  FROM boxes b CROSS JOIN (VALUES ('all'), ('legacy'), ('evidence')) k(c) LEFT JOIN tp USING (video_name, frame_order, bbox_index)
    LEFT JOIN sp ON sp.config = c AND sp.video_name = b.video_name AND sp.frame_order = b.frame_order AND sp.bbox_index = b.bbox_index
    LEFT JOIN roi ON roi.config = c AND roi.video_name = b.video_name AND roi.frame_order = b.frame_order AND roi.bbox_index = b.bbox_index""", "points boxes")
def a12(spark, d):
    teacher, sel, lab = sweep_tables(spark, d)
    return rounded(B.retention(teacher, sel, lab, V.boxes(spark, d), list(CONFIGS)))


@query("a13_extent_recall", """
  WITH part AS (SELECT video_name, frame_order, CAST(floor(pixel_x / 17) AS INTEGER) AS bbox_index, CAST(pixel_x AS INTEGER) AS px, CAST(pixel_y AS INTEGER) AS py, bit_or(source_flags) AS flags FROM points GROUP BY 1, 2, 3, 4, 5),
  m AS (SELECT video_name, frame_order, bbox_index, count(*) AS n, var_samp(px) AS a, var_samp(py) AS c, covar_samp(px, py) AS b FROM part GROUP BY 1, 2, 3),
  e AS (SELECT *, (a+c)/2 + sqrt(((a-c)/2)**2 + b*b) AS major, greatest((a+c)/2 - sqrt(((a-c)/2)**2 + b*b), 0) AS minor, 0.5 * atan2(2*b, a-c) AS th FROM m),
  q AS (SELECT p.*, e.n, CASE WHEN e.n >= 3 THEN major / greatest(minor, 1e-12) END AS el, px * cos(th) + py * sin(th) AS t FROM part p JOIN e USING (video_name, frame_order, bbox_index)),
  s AS (SELECT video_name, frame_order, bbox_index, any_value(el) AS el, max(t) - min(t) AS w, count(*) FILTER (flags & 1 <> 0) AS k, max(t) FILTER (flags & 1 <> 0) - min(t) FILTER (flags & 1 <> 0) AS pw FROM q GROUP BY 1, 2, 3)
  SELECT video_name, frame_order, bbox_index, el < 1e3 AS thick, CASE WHEN el < 1e3 THEN round(el, 6) END AS elongation, CASE WHEN el >= 1.47 AND w > 0 THEN CASE WHEN k < 2 THEN 0 ELSE round(least(1, greatest(0, pw / w)), 6) END END AS extent_recall FROM s""", "points")
def a13(spark, d):
    c = V.points(spark, d).groupBy("video_name", "frame_order", F.floor(F.col("pixel_x") / 17).cast("int").alias("bbox_index"), F.col("pixel_x").cast("int").alias("px"),
                                   F.col("pixel_y").cast("int").alias("py")).agg(F.bit_or("source_flags").alias("flags"))
    sel = c.filter("flags & 1 <> 0").select(F.lit("global").alias("config"), "video_name", "frame_order", "px", "py")
    out = B.extent_recall(c.drop("flags"), sel, 1.47, ["global"])
    return out.select("video_name", "frame_order", "bbox_index", (F.col("elongation") < 1e3).alias("thick"),
                      F.when(F.col("elongation") < 1e3, R("elongation", 6)).alias("elongation"), R("extent_recall").alias("extent_recall"))


@query("a30_hard_frames", """
  WITH s AS (SELECT s_suppkey AS video_name, CAST(f AS INTEGER) AS frame_order FROM supplier, generate_series(0, 39) g(f)),
  pt AS (SELECT * FROM points), n AS (SELECT video_name, frame_order, count(*) AS np, count(*) FILTER (point_label = 1) AS npos FROM pt GROUP BY 1, 2),
  k AS (SELECT video_name, frame_order, count(*) AS nb FROM pt p WHERE EXISTS (SELECT 1 FROM boxes b WHERE valid AND b.video_name = p.video_name AND b.frame_order = p.frame_order AND pixel_x BETWEEN xmin AND xmax AND pixel_y BETWEEN ymin AND ymax) GROUP BY 1, 2),
  b AS (SELECT video_name, frame_order, max((xmax-xmin)*(ymax-ymin)) AS max_box_area FROM boxes WHERE valid GROUP BY 1, 2),
  j AS (SELECT video_name, frame_order, coalesce(np, 0) AS num_points, coalesce(npos, 0) AS num_positive, coalesce(nb, 0) AS points_in_box, max_box_area FROM s LEFT JOIN n USING (video_name, frame_order) LEFT JOIN k USING (video_name, frame_order) LEFT JOIN b USING (video_name, frame_order))
  SELECT *, CASE WHEN max_box_area IS NULL THEN 'no_box' WHEN points_in_box = 0 AND num_points > 0 THEN 'zero_with_points' WHEN points_in_box = 0 THEN 'zero_empty' WHEN points_in_box <= 2 THEN 'low' ELSE 'enough' END AS kind,
    max_box_area IS NOT NULL AND num_points > 0 AS eligible FROM j""", "points boxes")
def a30(spark, d):
    return B.hard_frames(spine(spark, d), V.points(spark, d), V.boxes(spark, d), 2)


def spine(spark, d):
    return V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("video_name"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("frame_order"))


@query("a32_annotation_frames", """
  WITH s AS (SELECT s_suppkey AS video_name, CAST(f AS INTEGER) AS frame_order FROM supplier, generate_series(0, 39) g(f)),
  f AS (SELECT s.*, EXISTS (SELECT 1 FROM points p WHERE p.video_name = s.video_name AND p.frame_order = s.frame_order AND point_label = 1) AS pos,
    EXISTS (SELECT 1 FROM boxes b WHERE valid AND b.video_name = s.video_name AND b.frame_order = s.frame_order) AS ok FROM s)
  SELECT video_name, count(*) AS frames, count(*) FILTER (pos) AS positive_frames, count(*) FILTER (NOT pos) AS zero_positive_frames, count(*) FILTER (NOT pos AND ok) AS zero_positive_with_valid_box FROM f GROUP BY 1""", "points boxes")
def a32(spark, d):
    return B.annotation_frames(spine(spark, d), V.points(spark, d), V.boxes(spark, d))


@query("a35_recovery_report", """
  WITH hit AS (SELECT p.* FROM points p WHERE EXISTS (SELECT 1 FROM boxes b WHERE valid AND b.video_name = p.video_name AND b.frame_order = p.frame_order AND pixel_x BETWEEN xmin AND xmax AND pixel_y BETWEEN ymin AND ymax)),
  f AS (SELECT DISTINCT video_name, frame_order FROM boxes WHERE valid), n AS (SELECT video_name, frame_order, count(*) AS fp FROM points GROUP BY 1, 2),
  o AS (SELECT f.*, (SELECT count(*) FROM hit h WHERE h.video_name = f.video_name AND h.frame_order = f.frame_order AND source_flags & 1 <> 0) AS old,
    (SELECT count(*) FROM hit h WHERE h.video_name = f.video_name AND h.frame_order = f.frame_order) AS new, coalesce(fp, 0) AS fp FROM f LEFT JOIN n USING (video_name, frame_order))
  SELECT video_name, count(*) AS box_frames, CAST(sum(old) AS BIGINT) AS old_points, CAST(sum(new) AS BIGINT) AS new_points, count(*) FILTER (old = 0 AND fp > 0) AS targets,
    count(*) FILTER (old = 0 AND fp > 0 AND new > 0) AS recovered, CAST(sum(new - old) AS BIGINT) AS added, min(new) AS min_new, max(new) AS max_new, round(sum(new) / nullif(sum(old), 0)::DOUBLE, 6) AS multiplier FROM o GROUP BY 1""", "points boxes")
def a35(spark, d):
    p = V.points(spark, d)
    return rounded(B.recovery(spine(spark, d), p.filter("source_flags & 1 <> 0"), p, V.boxes(spark, d)))


SELECTED_SQL = "sb AS (SELECT *, size % 3 = 0 AS fallback_used, CASE WHEN NOT valid THEN 'none' WHEN size % 5 = 0 THEN 'shared' WHEN size % 2 = 0 THEN 'global' ELSE 'local_percentile' END AS selected_source, size / 50.0::DOUBLE AS selected_score, 0.3::DOUBLE AS global_score FROM boxes)"


def selected_boxes(spark, d):
    s = F.col("size")
    src = F.when(~F.col("valid"), "none").when(s % 5 == 0, "shared").when(s % 2 == 0, "global").otherwise("local_percentile")
    return V.boxes(spark, d).withColumns({"fallback_used": s % 3 == 0, "selected_source": src, "selected_score": s / 50.0, "global_score": F.lit(0.3)})


@query("a36_annotation_summary", f"""
  WITH {SELECTED_SQL}, n AS (SELECT video_name, count(*) FILTER (point_label = 1) AS labelled_points FROM points GROUP BY 1)
  SELECT video_name, count(*) AS boxes, count(DISTINCT frame_order) AS annotated_frames, count(*) FILTER (valid) AS valid_boxes, count(DISTINCT CASE WHEN valid THEN frame_order END) AS valid_frames,
    count(*) FILTER (fallback_used) AS fallback_uses, {", ".join(f"count(*) FILTER (selected_source = '{s}') AS selected_{s}" for s in ("global", "local_percentile", "shared", "none"))},
    coalesce(any_value(labelled_points), 0) AS labelled_points FROM sb LEFT JOIN n USING (video_name) GROUP BY 1""", "points boxes")
def a36(spark, d):
    return B.annotation_summary(selected_boxes(spark, d), V.points(spark, d))


@query("q06_selection_audit", f"""
  WITH {SELECTED_SQL} SELECT 0::BIGINT AS valid_without_source, 0::BIGINT AS invalid_with_source, count(*) FILTER (selected_source = 'local_percentile' AND selected_score < 0.3 - 1e-7) AS worse_local_pick, count(*) AS boxes FROM sb""", "boxes")
def q06(spark, d):
    return B.selection_audit(selected_boxes(spark, d))


@query("q06_planted_violations", f"""
  WITH {SELECTED_SQL}, bad AS (SELECT * REPLACE (CASE WHEN size % 7 = 0 THEN CASE WHEN valid THEN 'none' ELSE 'global' END ELSE selected_source END AS selected_source) FROM sb)
  SELECT count(*) FILTER (valid AND size % 7 = 0) AS valid_without_source, count(*) FILTER (NOT valid AND size % 7 = 0) AS invalid_with_source,
    count(*) FILTER (selected_source = 'local_percentile' AND selected_score < 0.3 - 1e-7) AS worse_local_pick, count(*) AS boxes FROM bad""", "boxes")
def q06_planted(spark, d):
    """Sources taken from valid boxes and given to invalid ones."""
    bad = F.when(F.col("size") % 7 == 0, F.when(F.col("valid"), "none").otherwise("global")).otherwise(F.col("selected_source"))
    return B.selection_audit(selected_boxes(spark, d).withColumn("selected_source", bad))


@query("q03_frame_consistency", """
  WITH n AS (SELECT video_name, frame_order, count(*) AS n FROM points GROUP BY 1, 2), f AS (SELECT video_name, frame_order, n + CASE WHEN frame_order = 7 THEN 1 ELSE 0 END AS num_points FROM n WHERE frame_order <> 5)
  SELECT CAST(sum(CASE WHEN f.num_points IS NULL THEN n.n ELSE 0 END) AS BIGINT) AS points_outside_frames, count(*) FILTER (f.num_points <> n.n) AS wrong_counts, CAST(sum(n.n) AS BIGINT) AS points
  FROM n LEFT JOIN f USING (video_name, frame_order)""", "points")
def q03(spark, d):
    p = V.points(spark, d)
    f = p.groupBy("video_name", "frame_order").agg(F.count(F.lit(1)).alias("num_points")).filter("frame_order <> 5")
    f = f.withColumn("num_points", F.col("num_points") + (F.col("frame_order") == 7).cast("int"))
    return B.frame_consistency(p, f)


PARTS_SQL = """parts AS (SELECT b.video_name, b.frame_order, b.bbox_index, CASE WHEN c.value % 2 = 0 THEN 'global' ELSE 'local_percentile' END AS source, CAST(floor(c.x / 4.0) AS INTEGER) AS component, c.x AS px, c.y AS py
    FROM cells c JOIN boxes b ON b.video_name = c.video_name AND b.frame_order = c.frame_order AND c.x BETWEEN xmin AND xmax AND c.y BETWEEN ymin AND ymax),
  sc AS (SELECT p.video_name, p.frame_order, p.bbox_index, source, component, count(*) AS area, avg(px) AS mx, avg(py) AS my, any_value(xmin) AS xmin, any_value(xmax) AS xmax, any_value(ymin) AS ymin, any_value(ymax) AS ymax
    FROM parts p JOIN boxes USING (video_name, frame_order, bbox_index) GROUP BY 1, 2, 3, 4, 5),
  s2 AS (SELECT *, sqrt((mx - (xmin+xmax)/2)**2 + (my - (ymin+ymax)/2)**2) / sqrt((xmax-xmin+1)**2 + (ymax-ymin+1)**2) AS distance, area / ((xmax-xmin+1)*(ymax-ymin+1)) AS area_ratio FROM sc),
  s3 AS (SELECT *, greatest(0, least(1, 1 - distance / 0.5)) AS center_score, greatest(0, least(1, area_ratio / 0.2)) AS area_score FROM s2),
  s4 AS (SELECT *, 0.7::DOUBLE * center_score + 0.3::DOUBLE * area_score AS score, area >= 1 AND area_ratio >= 0.02 AND distance <= 0.5 AS eligible FROM s3)"""


def parts(spark, d):
    """Cells inside each box, split into candidates by brightness and column band."""
    c = V.cells(spark, d).select("video_name", "frame_order", F.col("x").alias("px"), F.col("y").alias("py"), "value")
    roi = B.box_cells(V.boxes(spark, d), ["bbox_index"])
    return layout.outgrown(roi).join(c, [*B.FRAME, "px", "py"]).select(*B.FRAME, "bbox_index", F.when(F.col("value") % 2 == 0, "global").otherwise("local_percentile").alias("source"),
                                                      F.floor(F.col("px") / 4).cast("int").alias("component"), "px", "py")


@query("a33_component_scores", f"""
  WITH {PARTS_SQL} SELECT video_name, frame_order, bbox_index, source, component, area, round(distance, 6) AS distance, round(area_ratio, 6) AS area_ratio, round(center_score, 6) AS center_score,
    round(area_score, 6) AS area_score, round(score, 6) AS score, eligible FROM s4""", "cells boxes")
def a33(spark, d):
    return rounded(B.component_scores(parts(spark, d), V.boxes(spark, d)).drop("mx", "my"))


@query("t11_ranked_candidates", f"""
  WITH {PARTS_SQL}, cs AS (SELECT video_name, frame_order, bbox_index, source, component, string_agg(px || ',' || py, ';' ORDER BY px, py) AS cells FROM parts GROUP BY 1, 2, 3, 4, 5),
  r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS n1, lead(distance) OVER w AS n2, lead(area_score) OVER w AS n3, lead(area) OVER w AS n4, lead(cells) OVER w AS nc FROM s4 JOIN cs USING (video_name, frame_order, bbox_index, source, component) WHERE eligible
    WINDOW w AS (PARTITION BY video_name, frame_order, bbox_index ORDER BY round(score, 12) DESC, round(distance, 12), round(area_score, 12) DESC, area DESC, source, component)),
  t AS (SELECT *, n1 IS NOT NULL AND abs(score-n1) <= 1e-12 AND abs(distance-n2) <= 1e-12 AND abs(area_score-n3) <= 1e-12 AND area = n4 AS tie FROM r WHERE r = 1)
  SELECT b.video_name, b.frame_order, b.bbox_index, coalesce(NOT tie OR cells = nc, false) AS valid, CASE WHEN r IS NULL THEN 'none' WHEN tie AND cells = nc THEN 'shared' WHEN tie THEN 'none' ELSE source END AS selected_source,
    CASE WHEN r IS NULL THEN 'no_eligible_candidate' WHEN tie AND cells = nc THEN 'identical_candidates' WHEN tie THEN 'ambiguous_equal_candidates' ELSE 'selected' END AS reason, round(score, 6) AS selected_score
  FROM (SELECT DISTINCT video_name, frame_order, bbox_index FROM s4) b LEFT JOIN t USING (video_name, frame_order, bbox_index)""", "cells boxes")
def t11(spark, d):
    p = parts(spark, d)
    scored = B.component_scores(p, V.boxes(spark, d))
    scored = scored.withColumns({c: F.round(c, 12) for c in ("score", "distance", "area_score")})
    return rounded(B.pick_ranked(scored, B.cells_digest(p)).drop("component"))


@query("a34_largest_component", f"""
  WITH {PARTS_SQL}, z AS (SELECT video_name, frame_order, bbox_index, component, count(*) AS area FROM parts GROUP BY 1, 2, 3, 4),
  m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_name, frame_order, bbox_index ORDER BY area DESC, component) AS r FROM z) WHERE r = 1),
  o AS (SELECT b.video_name, b.frame_order, b.bbox_index, valid, area, component, CASE WHEN NOT valid THEN 'invalid_bbox' WHEN area IS NULL THEN 'empty_binary_mask' WHEN area < 2 THEN 'contour_area_below_threshold' ELSE 'ok' END AS reason
    FROM boxes b LEFT JOIN m USING (video_name, frame_order, bbox_index))
  SELECT * REPLACE (CASE WHEN reason = 'ok' THEN component END AS component) FROM o""", "cells boxes")
def a34(spark, d):
    return B.largest_component(V.boxes(spark, d), parts(spark, d), 2)


@query("t12_fallback_ladder", """
  WITH a AS (SELECT l_suppkey AS video_name, CAST(l_orderkey % 40 AS INTEGER) AS frame_order, l_linenumber - 1 AS attempt, bool_or(l_returnflag <> 'A') AS valid, CAST(sum(l_quantity) AS BIGINT) AS positives FROM lineitem GROUP BY 1, 2, 3),
  g AS (SELECT *, CASE WHEN valid THEN positives ELSE 0 END AS got FROM a),
  f AS (SELECT video_name, frame_order, min(attempt) FILTER (valid AND got >= 60) AS first_ok, arg_min(attempt, -got * 100 + attempt) AS best, max(got) AS best_got, bool_or(valid) AS any_valid FROM g GROUP BY 1, 2)
  SELECT f.video_name, f.frame_order, coalesce(first_ok, best) AS attempt, CASE WHEN first_ok IS NOT NULL THEN (SELECT got FROM g WHERE g.video_name = f.video_name AND g.frame_order = f.frame_order AND attempt = first_ok) ELSE best_got END AS positives,
    first_ok IS NOT NULL AS valid, coalesce(first_ok, best) > 0 AS fallback_used, CASE WHEN first_ok IS NOT NULL THEN 'ok' WHEN any_valid THEN 'fallback_positive_points_below_threshold' ELSE 'no_valid_attempt' END AS status FROM f""")
def t12(spark, d):
    a = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("video_name"), (F.col("l_orderkey") % 40).cast("int").alias("frame_order"), (F.col("l_linenumber") - 1).alias("attempt")).agg(
        F.max(F.col("l_returnflag") != "A").alias("valid"), F.sum("l_quantity").cast("bigint").alias("positives"))
    return B.first_good_attempt(a, ["video_name", "frame_order"], 60)
