"""Queries over windows, votes and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import metrics as M, scoring as SC, windows as WI
from framelake.plans import views as V
from framelake.plans.registry import query


def scored_windows(spark, d, keep=None):
    return V.scores(WI.into_windows(V.points(spark, d), 12, 6, keep=keep)).withColumns(
        {"p1": F.round("p1", 9), "p0": F.round("p0", 9)})


def votes(spark, d):
    return M.vote(scored_windows(spark, d), ["checkpoint", "video_name", "point_index"], ["point_label", "valid_mask"])


METRICS_SQL = """
    tp, fp, tn, fn, total_points, valid_points, valid_positive, valid_background, ignore_points, ignore_predicted_positive,
    round(ignore_prob_sum, 6) AS ignore_prob_sum,
    round(coalesce((tp+tn)/nullif(tp+fp+tn+fn,0)::DOUBLE, 0), 9) AS accuracy,
    round(coalesce(tp/nullif(tp+fp,0)::DOUBLE, 0), 9) AS precision,
    round(coalesce(tp/nullif(tp+fn,0)::DOUBLE, 0), 9) AS recall,
    round(coalesce(2*(coalesce(tp/nullif(tp+fp,0)::DOUBLE,0))*(coalesce(tp/nullif(tp+fn,0)::DOUBLE,0))
      / nullif(coalesce(tp/nullif(tp+fp,0)::DOUBLE,0)+coalesce(tp/nullif(tp+fn,0)::DOUBLE,0),0), 0), 9) AS f1,
    round(coalesce(tp/nullif(tp+fp+fn,0)::DOUBLE, 0), 9) AS iou_positive,
    round(coalesce(tn/nullif(tn+fp+fn,0)::DOUBLE, 0), 9) AS iou_background,
    round((coalesce(tp/nullif(tp+fp+fn,0)::DOUBLE, 0) + coalesce(tn/nullif(tn+fp+fn,0)::DOUBLE, 0)) / 2, 9) AS mean_iou,
    round(coalesce(fp/nullif(fp+tn,0)::DOUBLE, 0), 9) AS false_positive_rate,
    round(coalesce(fn/nullif(fn+tp,0)::DOUBLE, 0), 9) AS false_negative_rate,
    round(coalesce(valid_points/nullif(total_points,0)::DOUBLE, 0), 9) AS valid_ratio,
    round(coalesce(valid_positive/nullif(valid_points,0)::DOUBLE, 0), 9) AS valid_positive_ratio,
    round(coalesce(valid_background/nullif(valid_points,0)::DOUBLE, 0), 9) AS valid_background_ratio,
    round(coalesce(ignore_predicted_positive/nullif(ignore_points,0)::DOUBLE, 0), 9) AS ignore_predicted_positive_ratio,
    round(ignore_prob_sum/nullif(ignore_points,0)::DOUBLE, 9) AS ignore_mean_prob
"""
COUNTS_SQL = """
    count(*) FILTER (valid_mask AND point_label = 1 AND pred_label = 1) AS tp,
    count(*) FILTER (valid_mask AND point_label <> 1 AND pred_label = 1) AS fp,
    count(*) FILTER (valid_mask AND point_label <> 1 AND pred_label <> 1) AS tn,
    count(*) FILTER (valid_mask AND point_label = 1 AND pred_label <> 1) AS fn,
    count(*) AS total_points, count(*) FILTER (valid_mask) AS valid_points,
    count(*) FILTER (valid_mask AND point_label = 1) AS valid_positive,
    count(*) FILTER (valid_mask AND point_label <> 1) AS valid_background,
    count(*) FILTER (NOT valid_mask) AS ignore_points,
    count(*) FILTER (NOT valid_mask AND pred_label = 1) AS ignore_predicted_positive,
    coalesce(sum(prob) FILTER (NOT valid_mask), 0) AS ignore_prob_sum
"""

query("w01_frame_windows", "SELECT video_name, window_id, start_frame, end_frame FROM windows", "windows")(V.windows)


@query("w01_frame_windows_no_tail", """
  SELECT video_name, CAST(k AS BIGINT) AS window_id, CAST(lo + 9 * k AS INTEGER) AS start_frame,
    CAST(least(lo + 9 * k + 15, hi) AS INTEGER) AS end_frame
  FROM (SELECT video_name, min(frame_order) lo, max(frame_order) hi FROM points GROUP BY 1), generate_series(0, 99) g(k)
  WHERE k = 0 OR lo + 9 * k + 15 <= hi""", "points")
def windows_no_tail(spark, d):
    return WI.frame_windows(V.points(spark, d), 16, 9, tail=False)


@query("j01_points_in_windows", """
  SELECT video_name, window_id, count(*) AS num_points, CAST(sum(part_key) % 1000003 AS BIGINT) AS checksum, min(frame_order) AS lo,
    max(frame_order) AS hi FROM point_windows GROUP BY 1, 2""", "point_windows")
def points_in_windows(spark, d):
    rows = WI.into_windows(V.points(spark, d), 12, 6)
    return rows.groupBy("video_name", "window_id").agg(
        F.count(F.lit(1)).alias("num_points"), (F.sum("part_key") % 1000003).cast("bigint").alias("checksum"),
        F.min("frame_order").alias("lo"), F.max("frame_order").alias("hi"))


@query("a04_overlap_vote", """
  SELECT checkpoint, video_name, point_index, round(prob, 9) AS prob, vote_count, pred_label FROM votes""", "votes")
def overlap_vote(spark, d):
    return votes(spark, d).select("checkpoint", "video_name", "point_index", F.round("prob", 9).alias("prob"), "vote_count", "pred_label")


@query("a04_points_without_vote", "SELECT 0::BIGINT AS missing", "")
def points_without_vote(spark, d):
    p = V.points(spark, d).select("video_name", "point_index")
    v = WI.into_windows(V.points(spark, d), 12, 6)
    return M.without_vote(p, v, ["video_name", "point_index"]).agg(F.count(F.lit(1)).alias("missing"))


@query("a04_planted_gaps", "SELECT video_name, count(*) AS missing FROM points WHERE video_name % 2 = 1 AND frame_order BETWEEN 13 AND 20 GROUP BY 1", "points")
def planted_gaps(spark, d):
    """Every other video loses the votes of some frames."""
    p = V.points(spark, d).select("video_name", "point_index", "frame_order")
    v = WI.into_windows(p, 12, 6).filter("NOT (video_name % 2 = 1 AND frame_order BETWEEN 13 AND 20)")
    return M.without_vote(p, v, ["video_name", "point_index"]).groupBy("video_name").agg(F.count(F.lit(1)).alias("missing"))


@query("a01_confusion_counts", f"""
  SELECT checkpoint, video_name, * EXCLUDE (checkpoint, video_name) REPLACE (round(ignore_prob_sum, 6) AS ignore_prob_sum)
  FROM (SELECT checkpoint, video_name, {COUNTS_SQL} FROM votes GROUP BY 1, 2)""", "votes")
def confusion_counts(spark, d):
    return M.confusion(votes(spark, d), ["checkpoint", "video_name"]).withColumn("ignore_prob_sum", F.round("ignore_prob_sum", 6))


@query("a02_segmentation_metrics", f"""
  SELECT checkpoint, {METRICS_SQL} FROM (SELECT checkpoint, {COUNTS_SQL} FROM votes GROUP BY 1)""", "votes")
def segmentation(spark, d):
    return M.segmentation_metrics(M.confusion(votes(spark, d), ["checkpoint"]))


@query("a02_item_labels", f"""
  SELECT lang, {METRICS_SQL} FROM (SELECT lang, {COUNTS_SQL} FROM (
    SELECT d.lang, l.quality AS point_label, true AS valid_mask, 1 - l.toxic AS pred_label, 0.0::DOUBLE AS prob
    FROM labels l JOIN documents d USING (doc_id)) GROUP BY 1)""", "")
def item_labels(spark, d):
    rows = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(
        "lang", F.col("quality").alias("point_label"), F.lit(True).alias("valid_mask"), (1 - F.col("toxic")).alias("pred_label"))
    return M.segmentation_metrics(M.confusion(rows, ["lang"], prob=None))


@query("a03_multi_level_metrics", f"""
  WITH win AS (SELECT checkpoint, video_name, window_id, {COUNTS_SQL} FROM (
      SELECT *, CASE WHEN round(p1, 9) > round(p0, 9) THEN 1 ELSE 0 END AS pred_label, round(p1, 9) AS prob FROM window_probs)
    GROUP BY 1, 2, 3),
  fil AS (SELECT checkpoint, video_name, {COUNTS_SQL} FROM votes GROUP BY 1, 2),
  spl AS (SELECT checkpoint, split, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in M.COUNTS[:-1])},
      sum(ignore_prob_sum) AS ignore_prob_sum FROM fil JOIN video_split USING (video_name) GROUP BY 1, 2),
  alls AS (SELECT * FROM (SELECT 'window' AS level, split, win.* FROM win JOIN video_split USING (video_name))
    UNION ALL BY NAME SELECT 'file' AS level, split, fil.* FROM fil JOIN video_split USING (video_name)
    UNION ALL BY NAME SELECT 'split' AS level, * FROM spl)
  SELECT level, checkpoint, split, video_name, window_id, {METRICS_SQL} FROM alls""", "votes video_split")
def multi_level(spark, d):
    out = M.multi_level(scored_windows(spark, d), votes(spark, d), V.video_split(spark, d))
    return out.select("level", "checkpoint", "split", "video_name", "window_id", *M.COUNTS, *M.metric_columns())


@query("a05_window_summary", """
  SELECT w.video_name, w.window_id, w.start_frame, w.end_frame, count(p.point_index) AS num_points
  FROM windows w LEFT JOIN points p
    ON p.video_name = w.video_name AND p.frame_order BETWEEN w.start_frame AND w.end_frame GROUP BY 1, 2, 3, 4""", "windows")
def window_summary(spark, d):
    p = V.points(spark, d)
    return WI.window_summary(WI.into_windows(p, 12, 6), WI.frame_windows(p, 12, 6))


@query("a06_class_weights", """
  WITH n AS (SELECT c AS class_id, count(p.point_label) AS n FROM (VALUES (0), (1)) v(c)
      LEFT JOIN (SELECT * FROM points WHERE valid_mask) p ON p.point_label = c GROUP BY 1),
    r AS (SELECT class_id, n, 1 / (n / (SELECT sum(n) FROM n) + 0.02) AS raw FROM n)
  SELECT class_id, n, round(raw * 2 / (SELECT sum(raw) FROM r), 9) AS weight FROM r""", "points")
def class_weights(spark, d):
    return M.class_weights(V.points(spark, d), 2).withColumn("weight", F.round("weight", 9))


@query("a07_sample_diagnostics", """
  WITH s AS (SELECT checkpoint, video_name, window_id, count(*) AS slots, count(*) FILTER (valid_mask) AS valid,
      count(*) FILTER (valid_mask AND point_label = 1) AS positive, count(*) FILTER (valid_mask AND p1 > p0) AS pred_positive,
      coalesce(sum(p0) FILTER (valid_mask), 0) AS l0, coalesce(sum(p1) FILTER (valid_mask), 0) AS l1,
      coalesce(sum(p1) FILTER (valid_mask AND point_label = 0), 0) AS pb, coalesce(sum(p1) FILTER (valid_mask AND point_label = 1), 0) AS pp
    FROM (SELECT * REPLACE (round(p1, 9) AS p1, round(p0, 9) AS p0) FROM window_probs) GROUP BY 1, 2, 3),
  t AS (SELECT checkpoint, CAST(sum(slots) AS BIGINT) AS total_points, CAST(sum(valid) AS BIGINT) AS valid_points, count(*) AS num_samples,
    count(*) FILTER (valid = 0) AS empty_valid_samples, min(valid) AS min_valid, avg(valid) AS mean_valid, max(valid) AS max_valid,
    CAST(sum(positive) AS BIGINT) AS positive, CAST(sum(pred_positive) AS BIGINT) AS pred_positive,
    sum(l0) AS l0, sum(l1) AS l1, sum(pb) AS pb, sum(pp) AS pp FROM s GROUP BY 1)
  SELECT checkpoint, total_points, valid_points, num_samples, empty_valid_samples, min_valid, round(mean_valid, 6) AS mean_valid, max_valid,
    positive, pred_positive, round((total_points - valid_points) / total_points, 6) AS ignore_ratio, 0.0::DOUBLE AS padding_ratio,
    round(positive / valid_points, 6) AS positive_ratio, round(pred_positive / valid_points, 6) AS pred_positive_ratio,
    round(l0 / valid_points, 6) AS mean_logit_background, round(l1 / valid_points, 6) AS mean_logit_positive,
    round((l1 - l0) / valid_points, 6) AS mean_logit_margin, round(l1 / valid_points, 6) AS mean_prob,
    round(pb / (valid_points - positive), 6) AS mean_prob_on_background, round(pp / positive, 6) AS mean_prob_on_positive FROM t""",
    "window_probs")
def sample_diagnostics(spark, d):
    rows = scored_windows(spark, d).withColumns({"logit0": F.col("p0"), "logit1": F.col("p1"), "is_padding": F.lit(False)})
    out = M.sample_diagnostics(rows, ["checkpoint"], ["video_name", "window_id"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("u01_group_scorer", """
  WITH c AS (SELECT video_name, point_index, intensity, (row_number() OVER (PARTITION BY video_name ORDER BY point_index) - 1) // 128 AS chunk FROM points)
  SELECT video_name, point_index, round(1 / (1 + exp(-(intensity - avg(intensity) OVER (PARTITION BY video_name, chunk)) / 32)), 6) AS p1 FROM c""", "points")
def group_scorer(spark, d):
    """A model that compares a point with all others of its chunk, so it needs the chunk as a whole."""
    def model(chunk):
        return chunk.assign(logit0=0.0, logit1=(chunk["intensity"] - chunk["intensity"].mean()) / 32)

    points = V.points(spark, d).select("video_name", "point_index", "intensity")
    chunks = WI.scoring_chunks(points, ["video_name"], "point_index", V.point_bucket(), 128)
    return SC.score_groups(chunks, ["video_name", "chunk"], model).select("video_name", "point_index", F.round("p1", 6).alias("p1"))


@query("a07_sample_confusion", """
  WITH s AS (SELECT checkpoint, video_name, window_id, count(*) FILTER (frame_order % 5 <> 4) AS points, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND point_label = 1 AND p1 > p0) AS tp,
      count(*) FILTER (ok AND point_label = 0 AND p1 > p0) AS fp, count(*) FILTER (ok AND point_label = 0 AND p1 <= p0) AS tn, count(*) FILTER (ok AND point_label = 1 AND p1 <= p0) AS fn
    FROM (SELECT *, valid_mask AND window_id % 7 <> 3 AS ok FROM window_probs) GROUP BY 1, 2, 3)
  SELECT checkpoint, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn, min(points) AS min_points,
    round(avg(points), 6) AS mean_points, max(points) AS max_points, round(count(*) FILTER (valid = 0) / count(*), 6) AS empty_valid_ratio FROM s GROUP BY 1""", "window_probs")
def sample_confusion(spark, d):
    """Every fifth frame is padding and whole windows are without a valid point."""
    rows = scored_windows(spark, d).withColumns({"logit0": F.col("p0"), "logit1": F.col("p1"), "is_padding": F.col("frame_order") % 5 == 4,
                                                 "valid_mask": F.col("valid_mask") & (F.col("window_id") % 7 != 3)})
    out = M.sample_diagnostics(rows, ["checkpoint"], ["video_name", "window_id"], counts=True)
    return out.select("checkpoint", "tp", "fp", "tn", "fn", "min_points", F.round("mean_points", 6).alias("mean_points"), "max_points", F.round("empty_valid_ratio", 6).alias("empty_valid_ratio"))


@query("w02_subsequences", """
  WITH n AS (SELECT video_name, count(*) AS num_frames FROM frames GROUP BY 1)
  SELECT video_name, CAST(s AS BIGINT) AS start FROM n, generate_series(0, 1000) g(s) WHERE s <= num_frames - 20""", "frames")
def subsequences(spark, d):
    n = V.frames(spark, d).groupBy("video_name").agg(F.count(F.lit(1)).alias("num_frames"))
    return WI.subsequences(n, 20)


@query("w02_one_subsequence", """
  WITH n AS (SELECT video_name, count(*) AS num_frames FROM frames GROUP BY 1)
  SELECT video_name, CAST(CAST('0x' || substr(sha256('seed:' || video_name), 1, 13) AS BIGINT) % (num_frames - 20) AS BIGINT) AS start
  FROM n WHERE num_frames > 20""", "frames")
def one_subsequence(spark, d):
    n = V.frames(spark, d).groupBy("video_name").agg(F.count(F.lit(1)).alias("num_frames"))
    return WI.one_subsequence(n, 20, "seed")


@query("w19_scoring_chunks", """
  SELECT video_name, point_index, CAST(floor(p / 128.0) AS BIGINT) AS chunk, CAST(p % 128 AS BIGINT) AS slot FROM (
    SELECT video_name, point_index, row_number() OVER (PARTITION BY video_name ORDER BY point_index) - 1 AS p FROM points)""", "points")
def scoring_chunks(spark, d):
    bucket = V.point_bucket()
    return WI.scoring_chunks(V.points(spark, d).select("video_name", "point_index"), ["video_name"], "point_index", bucket, 128)


@query("w20_padded_batches", """
  WITH s AS (SELECT video_name, frame_order, count(*) AS n FROM points GROUP BY 1, 2),
    b AS (SELECT *, max(n) OVER (PARTITION BY video_name) AS m FROM s)
  SELECT video_name, frame_order, n AS real_points, m - n AS pad_points, (m - n) * -1 AS label_sum_of_padding FROM b""", "points")
def padded_batches(spark, d):
    p = V.points(spark, d).select("video_name", "frame_order", "point_index", "point_label", "intensity")
    slots = WI.with_position(p, ["video_name", "frame_order"], ["point_index"], V.point_bucket(), "slot")
    out = WI.padded(slots, "video_name", "frame_order", "slot", {"point_label": -1, "intensity": 0})
    return out.groupBy("video_name", "frame_order").agg(
        F.count_if(~F.col("is_padding")).alias("real_points"), F.count_if("is_padding").alias("pad_points"),
        F.coalesce(F.sum(F.when(F.col("is_padding"), F.col("point_label"))), F.lit(0)).alias("label_sum_of_padding"))
