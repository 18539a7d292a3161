"""Queries over pose chains, trajectories and their errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.operators import folds, pointprep as PP, pose_errors as PE, trajectories as TR
from framelake.operators.layout import lookup
from framelake.plans import views as V
from framelake.session import cut_lineage
from framelake.plans.registry import query

R = lambda c, d=6: F.round(c, d) + F.lit(0.0)
CAL = [0.02, 0.0, 0.0, -0.5, 0.0, 0.03, 0.0, -0.2, 0.0, 0.0, 1.0, 0.0]
NAMES = [f"m{r}{c}" for r in range(3) for c in range(4)]


def mcols(c, digits=6):
    return [R(F.col(c).getItem(i), digits).alias(n) for i, n in enumerate(NAMES)]


def mul(a: str, b: str, out: str) -> str:
    """SQL for a product of two transforms held in columns a00.. and b00..."""
    parts = []
    for r in range(3):
        for c in range(4):
            s = " + ".join(f"{a}{r}{k}*{b}{k}{c}" for k in range(3)) + (f" + {a}{r}3" if c == 3 else "")
            parts.append(f"{s} AS {out}{r}{c}")
    return ", ".join(parts)


def inv(a: str, out: str) -> str:
    parts = [f"{a}{c}{r} AS {out}{r}{c}" for r in range(3) for c in range(3)]
    parts += ["-(" + " + ".join(f"{a}{k}{r}*{a}{k}3" for k in range(3)) + f") AS {out}{r}3" for r in range(3)]
    return ", ".join(parts)


def rnd(p: str, digits: int = 6) -> str:
    return ", ".join(f"round({p}{n[1:]}, {digits}) + 0.0 AS {n}" for n in NAMES)


FIRST = ", ".join(f"first_value(am{n[1:]}) OVER w AS f{n[1:]}" for n in NAMES)
LAG = ", ".join(f"lag(am{n[1:]}) OVER w AS f{n[1:]}" for n in NAMES)
LAG_B = ", ".join(f"lag(bm{n[1:]}) OVER w AS f{n[1:]}" for n in NAMES)
WIN = "WINDOW w AS (PARTITION BY video_name ORDER BY frame_order)"
EYE = {"m00": 1, "m11": 1, "m22": 1}
GLOBAL_SQL = f"""
  f AS (SELECT *, {FIRST} FROM poses {WIN}), fi AS (SELECT *, {inv('f', 'i')} FROM f), gl AS (SELECT *, {mul('i', 'am', 'g')} FROM fi)"""
LOCAL_SQL = f"""
  lf AS (SELECT *, {LAG} FROM poses {WIN}), lfi AS (SELECT *, {inv('f', 'i')} FROM lf), lo AS (SELECT *, {mul('i', 'am', 'l')} FROM lfi)"""


def euler(p: str, names: list[str]) -> str:
    e = [f"{p}03", f"{p}13", f"{p}23", f"degrees(atan2({p}21, {p}22))",
         f"degrees(asin(greatest(-1, least(1, -{p}20))))", f"degrees(atan2({p}10, {p}00))"]
    return ", ".join(f"{x} AS {n}" for x, n in zip(e, names))


@query("p13_relative_poses", f"""
  WITH i AS (SELECT *, {inv('am', 'i')} FROM poses), r AS (SELECT *, {mul('i', 'bm', 'r')} FROM i)
  SELECT video_name, frame_order, {rnd('r')} FROM r""", "poses")
def p13(spark, d):
    p = V.poses(spark, d).withColumn("r", G.relative("pose", "pred"))
    return p.select("video_name", "frame_order", *mcols("r"))


@query("p14_pose_vectors", f"""
  SELECT video_name, frame_order, round(a0, 6) + 0.0 AS x, round(a1, 6) + 0.0 AS y, round(a2, 6) + 0.0 AS z, round(a3, 6) + 0.0 AS pitch, round(a4, 6) + 0.0 AS roll,
    round(a5, 6) + 0.0 AS yaw FROM pose6""", "pose6")
def p14(spark, d):
    """Matrix to vector; the comparison is with the angles the matrices were built from."""
    return V.poses(spark, d).select("video_name", "frame_order", *[R(c).alias(n) for n, c in zip(PE.DOF, G.to_euler("pose"))])


@query("p15_quaternions", """
  WITH h AS (SELECT *, radians(a3) / 2 AS a, radians(a4) / 2 AS b, radians(a5) / 2 AS c FROM pose6),
  q AS (SELECT *, cos(a)*cos(b)*cos(c) + sin(a)*sin(b)*sin(c) AS w, sin(a)*cos(b)*cos(c) - cos(a)*sin(b)*sin(c) AS i,
    cos(a)*sin(b)*cos(c) + sin(a)*cos(b)*sin(c) AS j, cos(a)*cos(b)*sin(c) - sin(a)*sin(b)*cos(c) AS k FROM h)
  SELECT video_name, frame_order, round(a0, 6) + 0.0 AS tx, round(a1, 6) + 0.0 AS ty, round(a2, 6) + 0.0 AS tz, round(i * s, 6) + 0.0 AS qx, round(j * s, 6) + 0.0 AS qy,
    round(k * s, 6) + 0.0 AS qz, round(w * s, 6) + 0.0 AS qw FROM (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS s FROM q)""", "pose6")
def p15(spark, d):
    q = G.to_quaternion("pose")
    sign = F.when(q[3] < 0, -1).otherwise(1)
    t = G.translation("pose")
    return V.poses(spark, d).select("video_name", "frame_order", *[R(c).alias(n) for n, c in zip(("tx", "ty", "tz"), t)],
                                    *[R(c * sign).alias(n) for n, c in zip(("qx", "qy", "qz", "qw"), q)])


@query("p16_pixel_to_world", f"""
  WITH pp AS (SELECT p.video_name, p.frame_order, p.point_index, p.pixel_x * 0.02 - 0.5 AS ix, p.pixel_y * 0.03 - 0.2 AS iy, q.* EXCLUDE (video_name, frame_order)
    FROM points p LEFT JOIN poses q ON p.video_name % 10 = q.video_name AND p.frame_order = q.frame_order)
  SELECT video_name, frame_order, point_index, round(am00*ix + am01*iy + am03, 6) + 0.0 AS wx, round(am10*ix + am11*iy + am13, 6) + 0.0 AS wy,
    round(am20*ix + am21*iy + am23, 6) + 0.0 AS wz FROM pp""", "points poses")
def p16(spark, d):
    p = V.points(spark, d).select((F.col("video_name") % 10).cast("int").alias("probe"), "video_name", "frame_order", "point_index", "pixel_x", "pixel_y")
    out = PP.project(p, V.poses(spark, d).withColumnRenamed("video_name", "probe"), CAL, ["probe", "frame_order"])
    return out.select("video_name", "frame_order", "point_index", *[R(c).alias(c) for c in ("wx", "wy", "wz")])


@query("p17_frame_corners", """
  WITH c AS (SELECT * FROM poses, (VALUES (0, 0.0, 0.0), (1, 639.0, 0.0), (2, 639.0, 479.0), (3, 0.0, 479.0)) v(corner, px, py)),
  s AS (SELECT *, px * 0.02::DOUBLE - 0.5 AS ix, py * 0.03::DOUBLE - 0.2 AS iy FROM c)
  SELECT video_name, frame_order, corner, round(am00*ix + am01*iy + am03, 6) + 0.0 AS wx, round(am10*ix + am11*iy + am13, 6) + 0.0 AS wy,
    round(am20*ix + am21*iy + am23, 6) + 0.0 AS wz FROM s""", "poses")
def p17(spark, d):
    p = V.poses(spark, d).withColumn("t", G.product("pose", G.literal(CAL))).withColumn("c", F.explode(G.corners(F.lit(640), F.lit(480))))
    return p.select("video_name", "frame_order", "c.corner", *[R(v).alias(n) for n, v in zip(("wx", "wy", "wz"), G.move("t", F.col("c.x"), F.col("c.y")))])


STEPS_SQL = f"""
  n AS (SELECT video_name, frame_order, am03 AS cx, am13 AS cy, am23 AS cz, lead(am03) OVER w - am03 AS sx, lead(am13) OVER w - am13 AS sy,
    lead(am23) OVER w - am23 AS sz FROM poses {WIN}),
  st AS (SELECT *, sqrt(sx*sx + sy*sy + sz*sz) AS len FROM n WHERE sx IS NOT NULL)"""


def pose_steps(spark, d, chunk=TR.CHUNK):
    return cut_lineage(TR.steps(TR.centers(V.poses(spark, d)), chunk=chunk))


@query("w03_adjacent_steps", f"""
  WITH {STEPS_SQL} SELECT video_name, frame_order, round(sx, 6) + 0.0 AS sx, round(sy, 6) + 0.0 AS sy, round(sz, 6) + 0.0 AS sz, round(len, 6) AS length, len > 1e-8 AS valid,
    round(median(len) FILTER (len > 1e-8) OVER (PARTITION BY video_name), 6) AS median_step FROM st""", "poses")
def w03(spark, d):
    st = pose_steps(spark, d)
    out = lookup(st, TR.step_scale(st), ["video_name"], F.col("frame_order"))
    return out.select("video_name", "frame_order", *[R(c).alias(c) for c in ("sx", "sy", "sz", "length")], "valid", R("median_step").alias("median_step"))


def _axis_sql(method: str) -> str:
    if method == "start_to_end":
        return f"""WITH {STEPS_SQL}, e AS (SELECT video_name, {", ".join(f"arg_max(c{c} + s{c}, frame_order) - arg_min(c{c}, frame_order) AS m{c}" for c in "xyz")} FROM st GROUP BY 1)
          SELECT 'start_to_end' AS method, video_name, {", ".join(f"round(m{c} / sqrt(mx*mx+my*my+mz*mz), 6) + 0.0 AS a{c}" for c in "xyz")} FROM e"""
    limit = {"first_valid": "r = 1", "early_mean": "r <= 15", "global_mean": "true"}[method]
    return f"""WITH {STEPS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY frame_order) AS r FROM st WHERE len > 1e-8),
      e AS (SELECT video_name, {", ".join(f"avg(s{c} / len) AS m{c}" for c in "xyz")} FROM v WHERE {limit} GROUP BY 1)
      SELECT '{method}' AS method, video_name, {", ".join(f"round(m{c} / sqrt(mx*mx+my*my+mz*mz), 6) + 0.0 AS a{c}" for c in "xyz")} FROM e"""


AXES = ["first_valid", "early_mean", "global_mean", "start_to_end"]


@query("w04_progress_axes", " UNION ALL ".join(f"SELECT * FROM ({_axis_sql(m)})" for m in AXES), "poses")
def w04(spark, d):
    st = pose_steps(spark, d)
    parts = [TR.progress_axis(st, m).select(F.lit(m).alias("method"), "video_name", *[R(f"a{c}").alias(f"a{c}") for c in "xyz"]) for m in AXES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rebuilt(spark, d, chunk=TR.CHUNK):
    st = pose_steps(spark, d, chunk)
    return TR.rebuild_steps(st, TR.progress_axis(st, "early_mean"), TR.step_scale(st), chunk=chunk)


# The same recurrence in SQL: one row per frame, the state carried along.
REBUILD_SQL = f"""
  WITH RECURSIVE {STEPS_SQL}, md AS (SELECT video_name, median(len) AS mid FROM st WHERE len > 1e-8 GROUP BY 1),
  ax AS (SELECT video_name, mx / n AS rx, my / n AS ry, mz / n AS rz FROM (SELECT *, sqrt(mx*mx+my*my+mz*mz) AS n FROM (
    SELECT video_name, avg(sx/len) AS mx, avg(sy/len) AS my, avg(sz/len) AS mz FROM (
      SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY frame_order) AS r FROM st WHERE len > 1e-8) WHERE r <= 15 GROUP BY 1))),
  src AS (SELECT st.*, mid, CASE WHEN len <= 1e-8 THEN 0 ELSE 1 END AS ok FROM st JOIN md USING (video_name)),
  walk AS (
    SELECT video_name, -1 AS frame_order, rx, ry, rz, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 0.0::DOUBLE AS nz, '' AS kind FROM ax
    UNION ALL
    SELECT video_name, frame_order, CASE WHEN use THEN ux / un ELSE rx END, CASE WHEN use THEN uy / un ELSE ry END, CASE WHEN use THEN uz / un ELSE rz END,
      CASE WHEN use THEN sx / len * size ELSE rx * mid END, CASE WHEN use THEN sy / len * size ELSE ry * mid END, CASE WHEN use THEN sz / len * size ELSE rz * mid END,
      CASE WHEN ok = 0 THEN 'invalid' WHEN NOT use THEN 'reverse' WHEN len < 0.25 * mid THEN 'short' WHEN len > 2.0 * mid THEN 'long' ELSE 'kept' END
    FROM (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) AS un FROM (
      SELECT s.*, w.rx, w.ry, w.rz, s.ok = 1 AND (s.sx*w.rx + s.sy*w.ry + s.sz*w.rz) / s.len >= -0.1 AS use,
        least(greatest(s.len, 0.25 * mid), 2.0 * mid) AS size,
        0.8 * w.rx + 0.2 * s.sx / s.len AS ux, 0.8 * w.ry + 0.2 * s.sy / s.len AS uy, 0.8 * w.rz + 0.2 * s.sz / s.len AS uz
      FROM walk w JOIN src s ON s.video_name = w.video_name AND s.frame_order = w.frame_order + 1)))"""


@query("w05_rebuilt_steps", f"""{REBUILD_SQL}
  SELECT video_name, frame_order, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz, kind FROM walk WHERE frame_order >= 0""", "poses")
def w05(spark, d):
    return rebuilt(spark, d).select("video_name", "frame_order", *[R(f"n{c}").alias(f"n{c}") for c in "xyz"], "kind")


@query("u02_sequence_fold", """
  SELECT video_name, CAST(frame_order AS INTEGER) AS frame_order, round(sum(value) OVER (PARTITION BY video_name ORDER BY frame_order), 6) AS total FROM frames""", "frames")
def u02(spark, d):
    """A user's own fold over ordered frames: here a running total in small chunks."""
    from pyspark.sql import types as T

    f = V.frames(spark, d).select("video_name", "frame_order", "value")
    start = f.select("video_name").distinct().withColumns({"sum0": F.lit(0.0), "lost0": F.lit(0.0)})
    out = folds.chunked_fold(f, ["video_name"], "frame_order", start, ["sum0", "lost0"], folds.total("value"),
                             T.StructType([T.StructField("total", T.DoubleType())]))
    return out.withColumn("total", F.round("total", 6))


MONO_SQL = f"""
  WITH {STEPS_SQL}, ax AS (SELECT video_name, {", ".join(f"arg_min(s{c} / len, frame_order) AS a{c}" for c in "xyz")}, 0.2 * median(len) AS ms
      FROM st WHERE len > 1e-8 GROUP BY 1),
  p AS (SELECT n.*, ax, ay, az, ms, (cx - first_value(cx) OVER w) * ax + (cy - first_value(cy) OVER w) * ay + (cz - first_value(cz) OVER w) * az AS p
    FROM n JOIN ax USING (video_name) {WIN.replace("video_name ORDER", "n.video_name ORDER")}),
  m AS (SELECT *, p - frame_order * ms AS q, max(p - frame_order * ms) OVER w AS top FROM p {WIN}),
  l AS (SELECT *, CASE WHEN top > q THEN top + frame_order * ms - p ELSE 0 END AS lift FROM m)"""


def mono(spark, d, chunk=TR.CHUNK):
    st = pose_steps(spark, d, chunk)
    floor = TR.step_scale(st).select("video_name", (F.col("median_step") * 0.2).alias("min_step"))
    return TR.monotone(TR.centers(V.poses(spark, d)), TR.progress_axis(st), floor, chunk)


@query("w06_monotone_progress", f"""{MONO_SQL}
  SELECT video_name, frame_order, round(cx + lift * ax, 6) + 0.0 AS cx, round(cy + lift * ay, 6) + 0.0 AS cy, round(cz + lift * az, 6) + 0.0 AS cz, top > q AS adjusted FROM l""", "poses")
def w06(spark, d):
    return mono(spark, d).select("video_name", "frame_order", *[R(f"c{c}").alias(f"c{c}") for c in "xyz"], "adjusted")


@query("w06_monotone_summary", f"""{MONO_SQL}
  SELECT video_name, count(*) FILTER (top > q) AS adjusted, round(avg(abs(lift)), 6) AS mean_shift, round(max(abs(lift)), 6) AS max_shift FROM l GROUP BY 1""", "poses")
def w06_summary(spark, d):
    return mono(spark, d).groupBy("video_name").agg(F.count_if("adjusted").alias("adjusted"), R(F.avg("shift")).alias("mean_shift"), R(F.max("shift")).alias("max_shift"))


@query("w07_same_side_push", f"""
  WITH RECURSIVE {STEPS_SQL}, ax AS (SELECT video_name, {", ".join(f"arg_min(s{c} / len, frame_order) AS a{c}" for c in "xyz")}, 0.1 * median(len) AS ms
      FROM st WHERE len > 1e-8 GROUP BY 1),
  src AS (SELECT st.*, am02 AS qx, am12 AS qy, am22 AS qz, ms FROM st JOIN poses USING (video_name, frame_order) JOIN ax USING (video_name)),
  walk AS (
    SELECT video_name, -1 AS frame_order, ax AS nx, ay AS ny, az AS nz, false AS pushed FROM ax
    UNION ALL
    SELECT video_name, frame_order, CASE WHEN hit THEN sx + k * qx ELSE sx END, CASE WHEN hit THEN sy + k * qy ELSE sy END,
      CASE WHEN hit THEN sz + k * qz ELSE sz END, hit
    FROM (SELECT *, abs(back) > 1e-8 AND abs(ahead) > 1e-8 AND back * ahead >= 0 AS hit, -sign(back) * ms - ahead AS k FROM (
      SELECT s.*, -(w.nx*s.qx + w.ny*s.qy + w.nz*s.qz) AS back, s.sx*s.qx + s.sy*s.qy + s.sz*s.qz AS ahead
      FROM walk w JOIN src s ON s.video_name = w.video_name AND s.frame_order = w.frame_order + 1))),
  o AS (SELECT video_name, arg_min(am03, frame_order) AS ox, arg_min(am13, frame_order) AS oy, arg_min(am23, frame_order) AS oz FROM poses GROUP BY 1)
  SELECT video_name, CAST(frame_order + 1 AS INTEGER) AS frame_order, {", ".join(f"round(o{c} + sum(CASE WHEN frame_order < 0 THEN 0 ELSE n{c} END) OVER w, 6) + 0.0 AS c{c}" for c in "xyz")}, pushed
  FROM walk JOIN o USING (video_name) {WIN}""", "poses")
def w07(spark, d):
    st = pose_steps(spark, d)
    floor = TR.step_scale(st).select("video_name", (F.col("median_step") * 0.1).alias("min_step"))
    p = V.poses(spark, d)
    out = TR.push_same_side(TR.centers(p), TR.frame_normals(p), TR.progress_axis(st), floor)
    return out.select("video_name", "frame_order", *[R(f"c{c}").alias(f"c{c}") for c in "xyz"], "pushed")


@query("w08_axis_scale", f"""
  WITH {STEPS_SQL}, ax AS (SELECT video_name, {", ".join(f"arg_min(s{c} / len, frame_order) AS a{c}" for c in "xyz")} FROM st WHERE len > 1e-8 GROUP BY 1),
  p AS (SELECT n.video_name, (cx - first_value(cx) OVER w) * ax + (cy - first_value(cy) OVER w) * ay + (cz - first_value(cz) OVER w) * az AS p
    FROM n JOIN ax USING (video_name) {WIN.replace("video_name ORDER", "n.video_name ORDER")})
  SELECT video_name, round(avg(abs(p * 0.3)), 6) AS mean_shift, round(max(abs(p * 0.3)), 6) AS max_shift, round(max(p) - min(p), 6) AS extent_before,
    round((max(p) - min(p)) * 1.3, 6) AS extent_after FROM p GROUP BY 1""", "poses")
def w08(spark, d):
    out = TR.scale_along(TR.centers(V.poses(spark, d)), TR.progress_axis(pose_steps(spark, d)), 1.3)
    return out.groupBy("video_name").agg(R(F.avg("shift")).alias("mean_shift"), R(F.max("shift")).alias("max_shift"),
                                         R(F.max("p") - F.min("p")).alias("extent_before"), R(F.max("p_scaled") - F.min("p_scaled")).alias("extent_after"))


@query("w09_corrected_poses", f"""{REBUILD_SQL},
  o AS (SELECT video_name, arg_min(am03, frame_order) AS ox, arg_min(am13, frame_order) AS oy, arg_min(am23, frame_order) AS oz FROM poses GROUP BY 1),
  ps AS (SELECT video_name, frame_order + 1 AS f, {", ".join(f"o{c} + sum(CASE WHEN frame_order < 0 THEN 0 ELSE n{c} END) OVER w AS c{c}, o{c}" for c in "xyz")} FROM walk JOIN o USING (video_name) {WIN}),
  pr AS (SELECT ps.*, rx AS ax, ry AS ay, rz AS az, mid, (cx - ox) * rx + (cy - oy) * ry + (cz - oz) * rz AS p FROM ps JOIN ax USING (video_name) JOIN md USING (video_name)),
  mo AS (SELECT *, greatest(max(p - f * 0.05 * mid) OVER (PARTITION BY video_name ORDER BY f) + f * 0.05 * mid, p) AS m FROM pr)
  SELECT video_name, CAST(f AS INTEGER) AS frame_order, {", ".join(f"round(c{c} + (m - p) * a{c} + 0.1 * m * a{c}, 6) + 0.0 AS c{c}" for c in "xyz")} FROM mo""", "poses")
def w09(spark, d):
    out = TR.correct(V.poses(spark, d), method="early_mean", monotone_ratio=0.05, scale=1.1)
    return out.select("video_name", "frame_order", *[R(c).alias(n) for n, c in zip(("cx", "cy", "cz"), G.translation("pose_corr"))])


@query("w09_corrected_poses_all_stages")
def w09_all(spark, d):
    out = TR.correct(V.poses(spark, d), method="global_mean", monotone_ratio=0.05, same_side_ratio=0.1, scale=1.1)
    return out.select("video_name", "frame_order", *[R(c).alias(n) for n, c in zip(("cx", "cy", "cz"), G.translation("pose_corr"))])


@query("w09_correction_record", f"""{REBUILD_SQL},
  o AS (SELECT video_name, arg_min(am03, frame_order) AS ox, arg_min(am13, frame_order) AS oy, arg_min(am23, frame_order) AS oz FROM poses GROUP BY 1),
  ps AS (SELECT video_name, frame_order + 1 AS f, {", ".join(f"o{c} + sum(CASE WHEN frame_order < 0 THEN 0 ELSE n{c} END) OVER w AS c{c}, o{c}" for c in "xyz")} FROM walk JOIN o USING (video_name) {WIN}),
  pr AS (SELECT ps.*, mid, (cx - ox) * rx + (cy - oy) * ry + (cz - oz) * rz AS p FROM ps JOIN ax USING (video_name) JOIN md USING (video_name)),
  q AS (SELECT *, p - f * 0.05 * mid AS q FROM pr), mo AS (SELECT *, max(q) OVER (PARTITION BY video_name ORDER BY f) AS top FROM q),
  m AS (SELECT *, CASE WHEN top > q THEN top + f * 0.05 * mid - p ELSE 0 END AS lift FROM mo),
  g AS (SELECT video_name, count(*) FILTER (top > q) AS num_monotone_adjusted, round(avg(abs(lift)), 6) AS monotone_shift_mean, round(max(abs(lift)), 6) AS monotone_shift_max,
    round(max(p + lift) - min(p + lift), 6) AS extent_before, round(1.1 * (max(p + lift) - min(p + lift)), 6) AS extent_after,
    round(avg(abs(0.1 * (p + lift))), 6) AS scale_shift_mean, round(max(abs(0.1 * (p + lift))), 6) AS scale_shift_max FROM m GROUP BY 1),
  k AS (SELECT video_name, count(*) FILTER (kind = 'reverse') AS num_reverse_steps, count(*) FILTER (kind = 'short') AS num_short_steps, count(*) FILTER (kind = 'long') AS num_long_steps FROM walk GROUP BY 1),
  l AS (SELECT video_name, count(*) FILTER (len <= 1e-8) AS num_invalid_steps, round(avg(len) FILTER (len > 1e-8), 6) AS prior_length_mean FROM st GROUP BY 1)
  SELECT * EXCLUDE (mid), round(mid, 6) AS median_step FROM l JOIN md USING (video_name) JOIN k USING (video_name) JOIN g USING (video_name)""", "poses")
def w09_record(spark, d):
    _, record = TR.corrected(V.poses(spark, d), method="early_mean", monotone_ratio=0.05, scale=1.1)
    return record.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in record.dtypes])


@query("w10_step_pairs", f"""
  WITH {STEPS_SQL}, ax AS (SELECT video_name, {", ".join(f"arg_min(s{c} / len, frame_order) AS a{c}" for c in "xyz")} FROM st WHERE len > 1e-8 GROUP BY 1),
  b AS (SELECT p.video_name, p.frame_order, bm03 AS kx, bm13 AS ky, bm23 AS kz, am02 AS qx, am12 AS qy, am22 AS qz, lead(bm03) OVER w - bm03 AS tx, lead(bm13) OVER w - bm13 AS ty,
    lead(bm23) OVER w - bm23 AS tz FROM poses p {WIN}),
  j AS (SELECT st.*, ax, ay, az, tx, ty, tz, qx, qy, qz, CASE WHEN qx*ax + qy*ay + qz*az >= 0 THEN 1 ELSE -1 END AS sg
    FROM st JOIN b USING (video_name, frame_order) JOIN ax USING (video_name))
  SELECT video_name, frame_order AS frame_i, frame_order + 1 AS frame_j, round(len, 6) AS prior_len, round(sqrt(tx*tx+ty*ty+tz*tz), 6) AS corr_len,
    round(sx*ax+sy*ay+sz*az, 6) + 0.0 AS prior_axis_delta, round(tx*ax+ty*ay+tz*az, 6) + 0.0 AS corr_axis_delta, tx*ax+ty*ay+tz*az < -1e-8 AS is_reverse,
    tx*ax+ty*ay+tz*az + 1e-8 < 0.02 AS violates_min_step, sg AS normal_sign, round((sx*qx+sy*qy+sz*qz)*sg, 6) + 0.0 AS prior_normal_delta,
    round((tx*qx+ty*qy+tz*qz)*sg, 6) + 0.0 AS corr_normal_delta, (tx*qx+ty*qy+tz*qz)*sg < -1e-8 AS is_normal_reverse FROM j""", "poses")
def w10(spark, d):
    p = V.poses(spark, d)
    out = TR.step_pairs(TR.centers(p), TR.centers(p, "pred"), TR.frame_normals(p), TR.progress_axis(TR.steps(TR.centers(p))), min_step=0.02)
    return out.select(*[R(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("w11_global_and_local_poses", f"""
  WITH {GLOBAL_SQL}, {LOCAL_SQL}
  SELECT video_name, frame_order, 'global' AS kind, {rnd('g')} FROM gl
  UNION ALL SELECT video_name, frame_order, 'local', {", ".join(f"coalesce(round(l{n[1:]}, 6) + 0.0, {float(EYE.get(n, 0))})" for n in NAMES)} FROM lo""", "poses")
def w11(spark, d):
    p = V.poses(spark, d)
    g = TR.global_poses(p).select("video_name", "frame_order", F.lit("global").alias("kind"), *mcols("pose_global"))
    l = TR.local_poses(p).select("video_name", "frame_order", F.lit("local").alias("kind"), *mcols("pose_local"))
    return g.unionByName(l)


@query("w12_cumulative_poses", f"""
  WITH {GLOBAL_SQL} SELECT video_name, frame_order, {rnd('g', 5)} FROM gl""", "poses")
def w12(spark, d):
    """Multiplying the local poses back up must give the global ones."""
    loc = TR.local_poses(V.poses(spark, d))
    return folds.scan_products(loc, ["video_name"], "frame_order", "pose_local").select("video_name", "frame_order", *mcols("total", 5))


@query("w12_cumulative_poses_left", f"""
  WITH RECURSIVE {LOCAL_SQL.replace("lo AS (", "lo AS MATERIALIZED (")}, walk AS (
    SELECT video_name, frame_order, {", ".join(f"{float(EYE.get(n, 0))}::DOUBLE AS t{n[1:]}" for n in NAMES)} FROM lo WHERE frame_order = 0
    UNION ALL SELECT l.video_name, l.frame_order, {mul('l.l', 'w.t', 't')} FROM walk w JOIN lo l ON l.video_name = w.video_name AND l.frame_order = w.frame_order + 1)
  SELECT video_name, frame_order, {rnd('t', 4)} FROM walk""", "poses")
def w12_left(spark, d):
    loc = TR.local_poses(V.poses(spark, d))
    return folds.scan_products(loc, ["video_name"], "frame_order", "pose_local", reverse=True).select("video_name", "frame_order", *mcols("total", 4))


@query("w13_moving_average", """
  WITH n AS (SELECT video_name, count(*) AS n FROM frames GROUP BY 1),
  idx AS (SELECT f.video_name, f.frame_order, n, f.frame_order + o AS p FROM frames f JOIN n USING (video_name), generate_series(-2, 2) g(o)),
  src AS (SELECT video_name, frame_order, CASE WHEN p < 0 THEN -1 - p WHEN p >= n THEN 2 * n - 1 - p ELSE p END AS s FROM idx)
  SELECT i.video_name, i.frame_order, round(avg(f.value), 6) AS value_mean FROM src i JOIN frames f ON f.video_name = i.video_name AND f.frame_order = i.s GROUP BY 1, 2""", "frames")
def w13(spark, d):
    return TR.moving_average(V.frames(spark, d), ["value"], 5).withColumn("value_mean", F.round("value_mean", 6))


@query("w14_reverse_falling", f"""
  WITH {GLOBAL_SQL}, e AS (SELECT video_name, arg_max(g23, frame_order) - arg_min(g23, frame_order) AS dz, count(*) AS n FROM gl GROUP BY 1)
  SELECT p.video_name, CAST(CASE WHEN dz < 0 THEN n - 1 - frame_order ELSE frame_order END AS INTEGER) AS frame_order, dz < 0 AS flipped, round(am03, 6) + 0.0 AS x, round(am23, 6) + 0.0 AS z
  FROM poses p JOIN e USING (video_name)""", "poses")
def w14(spark, d):
    out = TR.reverse_falling(V.poses(spark, d))
    t = G.translation("pose")
    return out.select("video_name", "frame_order", "flipped", R(t[0]).alias("x"), R(t[2]).alias("z"))


@query("w14_turn_falling", f"""
  WITH {GLOBAL_SQL}, e AS (SELECT video_name, arg_max(g23, frame_order) - arg_min(g23, frame_order) AS dz FROM gl GROUP BY 1)
  SELECT p.video_name, p.frame_order, dz < 0 AS flipped, round(CASE WHEN dz < 0 THEN -am00 ELSE am00 END, 6) + 0.0 AS m00, round(CASE WHEN dz < 0 THEN -am22 ELSE am22 END, 6) + 0.0 AS m22,
    round(am11, 6) + 0.0 AS m11, round(am03, 6) + 0.0 AS m03 FROM poses p JOIN e USING (video_name)""", "poses")
def w14_turn(spark, d):
    out = TR.reverse_falling(V.poses(spark, d), turn=True)
    return out.select("video_name", "frame_order", "flipped", *[R(F.col("pose").getItem(i)).alias(n) for i, n in ((0, "m00"), (10, "m22"), (5, "m11"), (3, "m03"))])


@query("a19_step_report", f"""{REBUILD_SQL},
  v AS (SELECT DISTINCT label AS video_name FROM embeddings UNION ALL SELECT DISTINCT label + 1000 FROM embeddings),
  c AS (SELECT video_name, count(*) AS steps, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("reverse", "short", "long", "invalid"))} FROM walk WHERE frame_order >= 0 GROUP BY 1)
  SELECT video_name, CASE WHEN steps IS NULL THEN 'missing_tracking_correction' ELSE 'ok' END AS status, steps,
    {", ".join(f"round({k} / steps::DOUBLE, 6) AS {k}_ratio" for k in ("reverse", "short", "long", "invalid"))} FROM v LEFT JOIN c USING (video_name)""", "poses")
def a19(spark, d):
    lab = V.table(spark, d, "embeddings").select(F.col("label").alias("video_name")).distinct()
    out = TR.step_report(rebuilt(spark, d), lab.union(lab.select(F.col("video_name") + 1000)))
    return out.select("video_name", "status", "steps", *[R(c).alias(c) for c in out.columns if c.endswith("_ratio")])


@query("a20_dof_errors", """
  SELECT video_name, round(avg(abs(a0-b0)), 6) AS x, round(avg(abs(a1-b1)), 6) AS y, round(avg(abs(a2-b2)), 6) AS z, round(avg(abs(a3-b3)), 6) AS pitch,
    round(avg(abs(a4-b4)), 6) AS roll, round(avg(abs(a5-b5)), 6) AS yaw FROM pose6 GROUP BY 1""", "pose6")
def a20(spark, d):
    return PE.dof_errors(V.poses(spark, d)).select("video_name", *[R(c).alias(c) for c in PE.DOF])


@query("a21_drift", f"""
  WITH {GLOBAL_SQL}, d AS (SELECT video_name, frame_order, sqrt((am03-bm03)**2 + (am13-bm13)**2 + (am23-bm23)**2) AS dr, sqrt(g03**2 + g13**2 + g23**2) AS far FROM gl),
  r AS (SELECT *, CASE WHEN frame_order = 0 THEN 'inf'::DOUBLE ELSE dr / far * 100 END AS rate FROM d)
  SELECT video_name, round(arg_max(rate, frame_order), 4) AS final_drift_rate, round(avg(rate) FILTER (frame_order > 0), 4) AS avg_finite_rate, round(max(dr), 6) AS max_drift,
    round(sum(dr), 6) AS sum_of_drift FROM r GROUP BY 1""", "poses")
def a21(spark, d):
    """Both chains start at the first measured pose here, so frame 0 is 0/0 and leaves the mean."""
    p = V.poses(spark, d)
    same = F.when(F.col("frame_order") == 0, F.col("pose")).otherwise(F.col("pred"))
    out = PE.drift(p.withColumn("_p", same), pred="_p")
    off = PE.drift(p)
    return out.select("video_name", R("final_drift_rate", 4).alias("final_drift_rate"), R("avg_drift_rate", 4).alias("avg_finite_rate")).join(
        off.select("video_name", R("max_drift").alias("max_drift"), R("sum_of_drift").alias("sum_of_drift")), "video_name")


DDF_SQL = f"""
  WITH f AS (SELECT *, {FIRST}, {", ".join(f"first_value(bm{n[1:]}) OVER w AS h{n[1:]}, lag(am{n[1:]}) OVER w AS u{n[1:]}, lag(bm{n[1:]}) OVER w AS v{n[1:]}" for n in NAMES)} FROM poses {WIN}),
  i AS (SELECT *, {inv('f', 'fi')}, {inv('h', 'hi')}, {inv('u', 'ui')}, {inv('v', 'vi')} FROM f),
  m AS (SELECT *, {mul('fi', 'am', 'g')}, {mul('hi', 'bm', 'k')}, {mul('ui', 'am', 'l')}, {mul('vi', 'bm', 'o')} FROM i WHERE frame_order > 0),
  p AS (SELECT *, px * 0.02::DOUBLE - 0.5 AS ix, py * 0.03::DOUBLE - 0.2 AS iy FROM m, POINTS),
  e AS (SELECT *, sqrt({" + ".join(f"((g{r}0-k{r}0)*ix + (g{r}1-k{r}1)*iy + g{r}3-k{r}3)**2" for r in range(3))}) AS ge,
    sqrt({" + ".join(f"((l{r}0-o{r}0)*ix + (l{r}1-o{r}1)*iy + l{r}3-o{r}3)**2" for r in range(3))}) AS le,
    sqrt((g00*ix + g01*iy + g03 - ix)**2 + (g10*ix + g11*iy + g13 - iy)**2 + (g20*ix + g21*iy + g23)**2) AS gr FROM p),
  fr AS (SELECT video_name, frame_order, avg(ge) AS g, avg(le) AS l, avg(ge / gr) AS r FROM e GROUP BY 1, 2)
  SELECT video_name, round(avg(g), 6) AS avg_global_displacement_error, round(max(g), 6) AS max_global_displacement_error, round(avg(l), 6) AS avg_local_displacement_error,
    round(max(l), 6) AS max_local_displacement_error, round(avg(r), 6) AS relative_global_error FROM fr GROUP BY 1"""
MODES = {
    "five": "(VALUES (0.0, 0.0), (32.0, 0.0), (0.0, 24.0), (32.0, 24.0), (16.0, 12.0)) v(px, py)",
    "corners": "(VALUES (0.0, 0.0), (32.0, 0.0), (0.0, 24.0), (32.0, 24.0)) v(px, py)",
    "all": "(SELECT CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py FROM generate_series(0, 31) a(x), generate_series(0, 23) b(y)) v",
}


def _ddf(mode):
    def run(spark, d):
        out = PE.displacement_errors(V.poses(spark, d), CAL, 32, 24, mode)
        return out.select("video_name", *[R(c).alias(c) for c in out.columns if c != "video_name"])
    return run


for _m, _pts in MODES.items():
    query(f"a22_displacement_{_m}", DDF_SQL.replace("POINTS", _pts), "poses")(_ddf(_m))


@query("a24_step_statistics", f"""
  WITH {LOCAL_SQL}, v AS (SELECT {euler('l', PE.DOF)} FROM lo WHERE frame_order > 0)
  {" UNION ALL ".join(f"SELECT '{n}' AS dof, round(avg({n}), 6) + 0.0 AS mean, round(stddev_pop({n}), 6) AS std FROM v" for n in PE.DOF)}""", "poses")
def a24_steps(spark, d):
    return PE.step_statistics(V.poses(spark, d)).select("dof", R("mean").alias("mean"), R("std").alias("std"))


@query("a24_end_deltas", f"""
  WITH {GLOBAL_SQL}, v AS (SELECT video_name, frame_order, {euler('g', PE.DOF)} FROM gl)
  SELECT video_name, {", ".join(f"round(arg_max({n}, frame_order) - arg_min({n}, frame_order), 6) + 0.0 AS delta_{n}" for n in PE.DOF)} FROM v GROUP BY 1""", "poses")
def a24_deltas(spark, d):
    out = PE.end_deltas(V.poses(spark, d))
    return out.select("video_name", *[R(c).alias(c) for c in out.columns if c != "video_name"])


@query("a24_pixel_statistics", """
  SELECT round(avg(m), 9) AS pixel_mean, round(avg(s), 9) AS pixel_std FROM (SELECT video_name, avg(value / 255.0::DOUBLE) AS m, stddev_pop(value / 255.0::DOUBLE) AS s FROM cells GROUP BY 1)""", "cells")
def a24_pixels(spark, d):
    return PE.pixel_statistics(V.cells(spark, d), ["video_name"]).select(R("pixel_mean", 9).alias("pixel_mean"), R("pixel_std", 9).alias("pixel_std"))


@query("a25_sweep_extent", """
  SELECT video_name, count(*) AS num_frames, round(sqrt((arg_max(am03, frame_order) - arg_min(am03, frame_order))**2 + (arg_max(am13, frame_order) - arg_min(am13, frame_order))**2
    + (arg_max(am23, frame_order) - arg_min(am23, frame_order))**2), 6) AS displacement FROM poses GROUP BY 1""", "poses")
def a25(spark, d):
    return PE.sweep_extent(V.poses(spark, d)).withColumn("displacement", R("displacement"))


@query("j12_landmark_displacement", f"""
  WITH {GLOBAL_SQL}, lm AS (SELECT p_partkey AS landmark, CAST(p_partkey % 10 AS INTEGER) AS video_name, CAST(1 + p_size % 40 AS INTEGER) AS frame_order, CAST(p_size AS DOUBLE) AS px, CAST(p_partkey % 24 AS DOUBLE) AS py FROM part),
  p AS (SELECT *, px * 0.02::DOUBLE - 0.5 AS ix, py * 0.03::DOUBLE - 0.2 AS iy FROM lm JOIN gl USING (video_name, frame_order))
  SELECT landmark, video_name, frame_order, px, py, round(g00*ix + g01*iy + g03 - ix, 6) + 0.0 AS dx, round(g10*ix + g11*iy + g13 - iy, 6) + 0.0 AS dy, round(g20*ix + g21*iy + g23, 6) + 0.0 AS dz FROM p""", "poses")
def j12(spark, d):
    lm = V.table(spark, d, "part").select(
        F.col("p_partkey").alias("landmark"), (F.col("p_partkey") % 10).cast("int").alias("video_name"), (1 + F.col("p_size") % 40).cast("int").alias("frame_order"),
        F.col("p_size").cast("double").alias("px"), (F.col("p_partkey") % 24).cast("double").alias("py"))
    out = PE.landmark_displacement(V.poses(spark, d), lm, CAL)
    return out.select("landmark", "video_name", "frame_order", "px", "py", *[R(c).alias(c) for c in ("dx", "dy", "dz")])


@query("j13_hausdorff", """
  WITH x AS (SELECT a.video_name, a.frame_order AS i, b.frame_order AS j, (a.am03-b.bm03)**2 + (a.am13-b.bm13)**2 + (a.am23-b.bm23)**2 AS d FROM poses a JOIN poses b USING (video_name)),
  f AS (SELECT video_name, max(m) AS m FROM (SELECT video_name, i, min(d) AS m FROM x GROUP BY 1, 2) GROUP BY 1),
  g AS (SELECT video_name, max(m) AS m FROM (SELECT video_name, j, min(d) AS m FROM x GROUP BY 1, 2) GROUP BY 1)
  SELECT video_name, round(sqrt(f.m), 6) AS forward, round(sqrt(g.m), 6) AS backward, round(sqrt(greatest(f.m, g.m)), 6) AS hausdorff FROM f JOIN g USING (video_name)""", "poses")
def j13(spark, d):
    p = V.poses(spark, d)
    out = PE.hausdorff(TR.centers(p), TR.centers(p, "pred"))
    return out.select("video_name", *[R(c).alias(c) for c in ("forward", "backward", "hausdorff")])
