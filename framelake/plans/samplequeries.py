"""Queries over sampling, splits, set operations and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import flags as FL
from framelake.operators import compare as C, metrics as M, sampling as SA
from framelake.plans import views as V
from framelake.plans.boxqueries import rounded
from framelake.plans.registry import query
from framelake.plans.voting import COUNTS_SQL, votes


def videos(spark, d):
    return V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("video_name"))


@query("t04_train_validation", """
  WITH r AS (SELECT s_suppkey AS video_name, row_number() OVER (ORDER BY sha256('split:' || s_suppkey), s_suppkey) AS p, count(*) OVER () AS n FROM supplier)
  SELECT video_name, CASE WHEN p <= least(greatest(round_even(n * 0.15::DOUBLE, 0), 1), n - 1) THEN 'validation' ELSE 'train' END AS split FROM r""")
def t04(spark, d):
    return SA.train_validation(videos(spark, d), 0.15, "split")


@query("t05_fixed_and_random", """
  WITH f AS (SELECT url AS path FROM pages WHERE contains(url, '/825?') UNION ALL SELECT NULL WHERE false),
  fx AS (SELECT min(url) AS path, 'fixed' AS role, 0::BIGINT AS place FROM pages WHERE page_id = 0),
  r AS (SELECT url AS path, row_number() OVER (ORDER BY sha256('pick:' || url), url) - 1 AS place FROM (SELECT DISTINCT url FROM pages) WHERE url NOT IN (SELECT path FROM fx))
  SELECT * FROM fx UNION ALL SELECT path, 'random', place FROM r WHERE place < 25""")
def t05(spark, d):
    p = V.table(spark, d, "pages").select(F.col("url").alias("path")).distinct()
    token = V.table(spark, d, "pages").filter("page_id = 0").select("url").first()[0]
    return SA.fixed_and_random(p, [token], 25, "pick")


@query("t06_exact_samples", """
  WITH p AS (SELECT video_name, count(*) FILTER (point_label = 1) AS pos FROM points GROUP BY 1),
  d AS (SELECT video_name, count(DISTINCT CAST('0x' || substr(sha256('draw:positive:draw:' || video_name || ':' || i), 1, 13) AS BIGINT) % pos) AS k FROM p, generate_series(1, 175) g(i) WHERE pos > 0 GROUP BY 1)
  SELECT video_name, 700::BIGINT AS rows, 175::BIGINT AS positive_rows, CASE WHEN pos >= 175 THEN 175 ELSE k END AS distinct_positive, true AS all_in_video FROM p JOIN d USING (video_name)""", "points")
def t06(spark, d):
    """Sizes and repetition of the samples; members are repeatable by hash."""
    s = SA.exactly(V.points(spark, d), ["video_name"], 700, "draw", positive_share=0.25)
    pos = F.col("drawn_as") == "positive"
    agg = s.groupBy("video_name").agg(F.count(F.lit(1)).alias("rows"), F.count_if(pos).alias("positive_rows"),
                                      F.count_distinct(F.when(pos, F.col("point_index"))).alias("distinct_positive"))
    return agg.withColumn("all_in_video", F.col("rows") == 700)


@query("t06_sample_members", """
  SELECT video_name, point_index FROM (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY sha256('draw:any:' || video_name || ':' || point_index), point_index) AS r FROM points) WHERE r <= 200""", "points")
def t06_members(spark, d):
    return SA.exactly(V.points(spark, d), ["video_name"], 200, "draw").select("video_name", "point_index")


@query("t07_random_frame_window", """
  WITH f AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY frame_order) - 1 AS i, count(*) OVER (PARTITION BY video_name) AS n FROM (SELECT DISTINCT video_name, frame_order FROM points)),
  s AS (SELECT *, CASE WHEN n > 10 THEN CAST('0x' || substr(sha256('win:' || video_name), 1, 13) AS BIGINT) % (n - 10 + 1) ELSE 0 END AS st FROM f)
  SELECT video_name, frame_order, count(*) AS n FROM points WHERE (video_name, frame_order) IN (SELECT (video_name, frame_order) FROM s WHERE i >= st AND i < st + 10) GROUP BY 1, 2""", "points")
def t07(spark, d):
    return SA.random_frame_window(V.points(spark, d), 10, "win").groupBy("video_name", "frame_order").agg(F.count(F.lit(1)).alias("n"))


@query("t08_cap_per_frame", """
  SELECT video_name, frame_order, point_index FROM (SELECT *, row_number() OVER (PARTITION BY video_name, frame_order ORDER BY sha256('cap:' || video_name || ':' || frame_order || ':' || point_index), point_index) AS r FROM points) WHERE r <= 8""", "points")
def t08(spark, d):
    return SA.cap_per_group(V.points(spark, d), ["video_name", "frame_order"], 8, "cap").select("video_name", "frame_order", "point_index")


@query("t09_evenly_spaced", """
  WITH n AS (SELECT video_name, count(*) AS n FROM frames GROUP BY 1), w AS (SELECT DISTINCT video_name, CAST(round_even(i * ((n - 1) / 11.0::DOUBLE), 0) AS INTEGER) AS frame_order FROM n, generate_series(0, 11) g(i) WHERE n > 12)
  SELECT video_name, frame_order, frame_index FROM frames JOIN w USING (video_name, frame_order)""", "frames")
def t09(spark, d):
    f = V.frames(spark, d)
    return SA.evenly_spaced(f.withColumn("frame_order", F.col("frame_order").cast("bigint")), ["video_name"], "frame_order", 12).select(
        "video_name", F.col("frame_order").cast("int").alias("frame_order"), "frame_index")


@query("t10_sparse_frames", """
  SELECT video_name, frame_order FROM (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY sha256('sp:' || video_name || ':' || frame_order), frame_order) AS r FROM frames) WHERE r <= 32""", "frames")
def t10(spark, d):
    return SA.sparse_frames(V.frames(spark, d), 32, "sp").select("video_name", "frame_order")


@query("t10_dropped_frames", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY sha256('dr:' || video_name || ':' || frame_order), frame_order) AS r, count(*) OVER (PARTITION BY video_name) AS n,
    CAST('0x' || substr(sha256('dr:gate:' || video_name), 1, 13) AS BIGINT) % 1000000 < 500000 AS gate FROM frames)
  SELECT video_name, frame_order FROM r WHERE NOT gate OR r <= floor(n * 0.9::DOUBLE)""", "frames")
def t10_drop(spark, d):
    return SA.drop_frames(V.frames(spark, d), 0.1, 0.5, "dr").select("video_name", "frame_order")


@query("t13_top_frames", "SELECT video_name, frame_order, count(*) AS n FROM points GROUP BY 1, 2 ORDER BY n DESC, video_name, frame_order LIMIT 20", "points")
def t13(spark, d):
    n = V.points(spark, d).groupBy("video_name", "frame_order").agg(F.count(F.lit(1)).alias("n"))
    return SA.top_k(n, [F.desc("n"), F.asc("video_name"), F.asc("frame_order")], 20)


@query("f03_frame_stride", "SELECT video_name, frame_order FROM frames WHERE frame_order >= 2 AND (frame_order - 2) % 5 = 0 AND (frame_order - 2) / 5 < 6", "frames")
def f03(spark, d):
    return SA.stride_frames(V.frames(spark, d), 5, 2, 6).select("video_name", "frame_order")


@query("f04_missing_numbers", """
  WITH l AS (SELECT DISTINCT l_suppkey AS video_name, l_partkey AS n FROM lineitem WHERE l_partkey > 0), m AS (SELECT video_name, max(n) AS m FROM l GROUP BY 1),
  a AS (SELECT video_name, i FROM m, generate_series(1, (SELECT max(n) FROM l)) g(i) WHERE i <= m AND NOT EXISTS (SELECT 1 FROM l WHERE l.video_name = m.video_name AND l.n = i)),
  r AS (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY i) AS r FROM a)
  SELECT video_name, count(*) AS missing, string_agg(i, ',' ORDER BY i) FILTER (r <= 10) AS first_missing FROM r GROUP BY 1""")
def f04(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("video_name"), F.col("l_partkey").alias("n"))
    return SA.missing_numbers(li, "n")


@query("f09_temporal_sample", """
  WITH o AS (SELECT *, CAST('0x' || substr(sha256('off:' || video_name), 1, 13) AS BIGINT) % 8 AS off FROM frames)
  SELECT 'fixed' AS kind, video_name, frame_order FROM frames WHERE frame_order % 8 = 0 UNION ALL SELECT 'random', video_name, frame_order FROM o WHERE frame_order >= off AND (frame_order - off) % 8 = 0""", "frames")
def f09(spark, d):
    f = V.frames(spark, d).select("video_name", "frame_order")
    return SA.temporal_sample(f, 8).select(F.lit("fixed").alias("kind"), "*").unionByName(SA.temporal_sample(f, 8, "off").select(F.lit("random").alias("kind"), "*"))


@query("f10_systematic_sample", """
  SELECT video_name, point_index FROM (SELECT *, row_number() OVER (PARTITION BY video_name ORDER BY point_index) - 1 AS p FROM points WHERE point_label = 1) WHERE p % 7 = 0 AND p < 7 * 20""", "points")
def f10(spark, d):
    pos = V.points(spark, d).filter("point_label = 1").select("video_name", "point_index")
    return SA.systematic_sample(pos, ["video_name"], "point_index", V.point_bucket(), 7, 20)


@query("o01_union_of_metrics", """
  SELECT 'orders' AS method, o_custkey AS id, round(avg(o_totalprice), 6) AS price, NULL::DOUBLE AS quantity FROM orders GROUP BY 2
  UNION ALL SELECT 'lines', l_suppkey, NULL, round(avg(l_quantity), 6) FROM lineitem GROUP BY 2""")
def o01(spark, d):
    a = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.avg("o_totalprice"), 6).alias("price"))
    b = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.avg("l_quantity"), 6).alias("quantity"))
    return C.stack({"orders": a, "lines": b}, "method")


RECON_SQL = "SELECT coalesce(a.k, b.k) AS video_name, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey <> 3) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL"


@query("j08_manifest_reconcile", RECON_SQL)
def j08(spark, d):
    exp = V.table(spark, d, "customer").filter("c_nationkey <> 3").select(F.col("c_custkey").alias("video_name"))
    return C.reconcile(exp, V.table(spark, d, "orders").select(F.col("o_custkey").alias("video_name")), "video_name")


@query("o02_missing_and_extra", RECON_SQL.replace("c_nationkey <> 3", "c_nationkey <> 7"))
def o02(spark, d):
    exp = V.table(spark, d, "customer").filter("c_nationkey <> 7").select(F.col("c_custkey").alias("video_name"))
    return C.reconcile(exp, V.table(spark, d, "orders").select(F.col("o_custkey").alias("video_name")), "video_name")


@query("o03_overlap", "SELECT video_name FROM (SELECT DISTINCT p_partkey AS video_name FROM part WHERE p_size < 20 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def o03(spark, d):
    a = V.table(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("video_name"))
    return C.overlap(a, V.table(spark, d, "lineitem").filter("l_quantity = 1").select(F.col("l_partkey").alias("video_name")), "video_name")


@query("j09_split_overlap", "SELECT (SELECT count(*) FROM (SELECT video_name FROM video_split WHERE split = 'train' INTERSECT SELECT video_name FROM video_split WHERE split = 'validation')) AS overlapping, (SELECT count(*) FROM video_split WHERE split = 'validation' AND video_name % 2 = 0) AS not_in_train", "video_split")
def j09(spark, d):
    s = V.video_split(spark, d)
    tr, va = s.filter("split = 'train'"), s.filter("split = 'validation'")
    chosen = s.filter("split = 'validation' AND video_name % 2 = 0")
    n = C.overlap(tr, va, "video_name").agg(F.count(F.lit(1)).alias("overlapping"))
    return n.withColumn("not_in_train", C.not_within(chosen, tr, "video_name").agg(F.count(F.lit(1))).scalar())


@query("o04_unexpected_values", "SELECT DISTINCT source_flags FROM points WHERE source_flags NOT IN (1, 2, 3, 4, 5, 6, 7)", "points")
def o04(spark, d):
    return C.unexpected_values(V.points(spark, d), "source_flags", [1, 2, 3, 4, 5, 6, 7])


@query("q04_table_equality", "SELECT video_name, frame_order, n, CASE WHEN side = 'a' THEN 1::BIGINT ELSE -1::BIGINT END AS surplus FROM (SELECT 'a' AS side, * FROM (SELECT video_name, frame_order, count(*) AS n FROM points GROUP BY 1, 2 EXCEPT SELECT video_name, frame_order, count(*) FILTER (source_flags <> 8) FROM points GROUP BY 1, 2) UNION ALL SELECT 'b', * FROM (SELECT video_name, frame_order, count(*) FILTER (source_flags <> 8) AS n FROM points GROUP BY 1, 2 EXCEPT SELECT video_name, frame_order, count(*) FROM points GROUP BY 1, 2))", "points")
def q04(spark, d):
    g = V.points(spark, d).groupBy("video_name", "frame_order")
    return C.table_difference(g.agg(F.count(F.lit(1)).alias("n")), g.agg(F.count_if(F.col("source_flags") != 8).alias("n")))


@query("q05_tolerance_compare", """
  SELECT count(*) AS compared, 0::BIGINT AS one_sided, 'x' AS column, count(*) FILTER (abs(l_quantity - (l_quantity + l_tax * 1e-3)) > 1e-8 + 1e-6 * abs(l_quantity + l_tax * 1e-3)) AS mismatches FROM lineitem
  UNION ALL SELECT count(*), 0, 'y', count(*) FILTER (l_linenumber = 3) FROM lineitem""")
def q05(spark, d):
    li = V.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), "l_tax", "l_linenumber")
    other = li.withColumns({"x": F.col("x") + F.col("l_tax") * 1e-3, "y": F.when(F.col("l_linenumber") != 3, F.col("y"))})
    return C.tolerance_compare(li, other, ["l_suppkey", "l_orderkey", "l_partkey", "q"], ["x", "y"], 1e-6, 1e-8)


@query("q01_expectations", """
  SELECT 'confidence_in_range' AS rule, count(*) FILTER (NOT (confidence BETWEEN 0 AND 0.6)) AS violations FROM points UNION ALL SELECT 'frame_not_negative', count(*) FILTER (frame_order < 0) FROM points
  UNION ALL SELECT 'non_empty', 0 FROM (SELECT 1) UNION ALL SELECT 'unique_video_name_frame_order', CAST(count(*) - count(DISTINCT (video_name, frame_order)) AS BIGINT) FROM points""", "points")
def q01(spark, d):
    return C.expect(V.points(spark, d), {"confidence_in_range": F.col("confidence").between(0, 0.6), "frame_not_negative": F.col("frame_order") >= 0}, ["video_name", "frame_order"])


@query("q07_flag_audit", """
  SELECT count(*) FILTER (f & ~15 <> 0) AS undefined_bits, count(*) FILTER (f = 0) AS zero_flags, count(*) FILTER (CASE WHEN f & 1 <> 0 THEN 1 WHEN f & 2 <> 0 THEN 2 WHEN f & 4 <> 0 THEN 3 WHEN f & 8 <> 0 THEN 4 ELSE 0 END <> 1) AS type_mismatch, count(*) AS points
  FROM (SELECT part_key % 19 AS f FROM points)""", "points")
def q07(spark, d):
    return C.flag_audit(V.points(spark, d).select((F.col("part_key") % 19).cast("int").alias("source_flags"), F.lit(1).alias("source_type")))


@query("j11_retention_check", """
  WITH o AS (SELECT *, source_flags & 1 <> 0 AS old FROM points) SELECT count(*) FILTER (old AND part_key % 97 = 0) AS lost, count(*) FILTER (old AND part_key % 97 <> 0 AND part_key % 89 = 0) AS changed, 0::BIGINT AS moved,
    0::BIGINT AS unflagged, count(*) FILTER (old AND part_key % 97 <> 0) AS kept FROM o""", "points")
def j11(spark, d):
    p = V.points(spark, d)
    new = p.filter("part_key % 97 <> 0").withColumn("intensity", F.when(F.col("part_key") % 89 == 0, F.col("intensity") + 1).otherwise(F.col("intensity"))).withColumn("x", F.col("x") + 1e-9)
    return C.retention_check(p.filter("source_flags & 1 <> 0"), new, ["video_name", "point_index"], ["intensity", "point_label"], ["x", "y"], FL.has_source("source_flags", "global"))


METHODS = ["1-URGENT", "2-HIGH", "5-LOW"]


@query("j10_method_comparison", """
  SELECT * FROM (PIVOT method_scores ON method IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') USING first(metric) GROUP BY sweep_id)
  WHERE "1-URGENT" IS NOT NULL AND "2-HIGH" IS NOT NULL AND "3-MEDIUM" IS NOT NULL AND "4-NOT SPECIFIED" IS NOT NULL AND "5-LOW" IS NOT NULL""", "method_scores")
def j10(spark, d):
    return C.by_method(V.method_scores(spark, d), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("a28_signed_rank", """
  WITH d AS (SELECT round(a.metric, -4) - round(b.metric, -4) AS d FROM method_scores a JOIN method_scores b USING (sweep_id) WHERE a.method = '1-URGENT' AND b.method = '2-HIGH'),
  n AS (SELECT count(*) AS n FROM d), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM d WHERE d <> 0),
  s AS (SELECT sum(r) FILTER (d > 0) AS wp, sum(r) FILTER (d < 0) AS wm, count(*) AS m, sum(t * t - 1) AS ties FROM r), q AS (SELECT *, least(wp, wm) AS st FROM s, n)
  SELECT round(st, 6) AS statistic, n, m AS n_nonzero, round((st - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE), 6) AS z_reference,
    round((st - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE) / sqrt(n), 6) AS effect_size,
    round((st - m * (m + 1) / 4.0::DOUBLE) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE), 6) AS z FROM q""", "method_scores")
def a28(spark, d):
    w = C.by_method(V.method_scores(spark, d), METHODS[:2])
    return rounded(C.signed_rank(w.select(*[F.round(m, -4).alias(m) for m in METHODS[:2]]), "1-URGENT", "2-HIGH"))


# The normal tail by Simpson's rule, twelve deviations far.
TAIL_SQL = """list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-((x + 12 * i / 2000.0::DOUBLE) ** 2) / 2)))
    * (12 / 2000.0::DOUBLE / 3) * 2 / sqrt(2 * pi())"""


@query("a28_signed_rank_p", f"""
  WITH d AS (SELECT a.method AS left_method, round(a.metric, -4) - round(b.metric, -4) AS d FROM method_scores a JOIN method_scores b USING (sweep_id) WHERE a.method IN ('1-URGENT', '2-HIGH') AND b.method = '5-LOW'),
  r AS (SELECT left_method, d, rank() OVER (PARTITION BY left_method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY left_method, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY left_method, abs(d)) AS t FROM d WHERE d <> 0),
  s AS (SELECT left_method, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS st, count(*) AS m, sum(t * t - 1) AS ties FROM r GROUP BY 1),
  z AS (SELECT left_method, abs((st - m * (m + 1) / 4.0::DOUBLE) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE)) AS x FROM s)
  SELECT left_method, round({TAIL_SQL}, 5) AS p FROM z""", "method_scores")
def a28_p(spark, d):
    scores = V.method_scores(spark, d)
    parts = []
    for m in METHODS[:2]:
        w = C.by_method(scores, [m, "5-LOW"])
        report = C.signed_rank(w.select(*[F.round(c, -4).alias(c) for c in (m, "5-LOW")]), m, "5-LOW")
        parts.append(report.select(F.lit(m).alias("left_method"), F.round(C.two_sided_p(F.col("z")), 5).alias("p")))
    return parts[0].unionByName(parts[1])


@query("a23_mean_metric", "SELECT method, round(avg(metric), 5) AS mean, count(*) AS scans FROM method_scores GROUP BY 1", "method_scores")
def a23(spark, d):
    return rounded(C.mean_metric(V.method_scores(spark, d), ["method"], "metric"), 5)


@query("a29_checkpoint_comparison", f"""
  SELECT checkpoint, split, count(*) AS selected, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, true AS same_selection
  FROM (SELECT checkpoint, video_name, {COUNTS_SQL} FROM votes GROUP BY 1, 2) JOIN video_split USING (video_name) GROUP BY 1, 2""", "votes video_split")
def a29(spark, d):
    m = M.confusion(votes(spark, d), ["checkpoint", "video_name"]).join(V.video_split(spark, d), "video_name")
    return C.checkpoint_comparison(m, ["tp", "fp", "fn"])


@query("u03_renamed_metrics", "SELECT method AS \"Method\", printf('%.2f', avg(metric)) AS \"Mean score\" FROM method_scores GROUP BY 1", "method_scores")
def u03(spark, d):
    out = C.mean_metric(V.method_scores(spark, d), ["method"], "metric").drop("scans")
    return C.renamed(C.renamed(out, {"method": "Method"}), {"mean": "Mean score"}, 2)


@query("u01_window_scorer", """
  SELECT video_name, window_id, count(*) AS points, round(sum(p), 5) AS prob_sum FROM (
    SELECT video_name, window_id, exp(confidence * 2) / (exp(confidence * 2) + exp(1 - pixel_x / 50)) AS p FROM point_windows) GROUP BY 1, 2""", "point_windows")
def u01(spark, d):
    """A plug-in model on windows of points, in Arrow batches; softmax stays in columns."""
    from framelake.operators.scoring import score_rows
    from framelake.operators.windows import into_windows

    def model(pdf):
        return pdf.assign(logit0=1 - pdf["pixel_x"] / 50.0, logit1=pdf["confidence"] * 2.0)

    rows = into_windows(V.points(spark, d), 12, 6).select("video_name", "window_id", "pixel_x", "confidence")
    out = score_rows(rows, model)
    return rounded(out.groupBy("video_name", "window_id").agg(F.count(F.lit(1)).alias("points"), F.sum("p1").alias("prob_sum")), 5)
