"""Queries that run a file stream to its end; their SQL is the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import metrics as M, trajectories as TR
from framelake.plans import views as V
from framelake.plans.boxqueries import rounded
from framelake.plans.posequeries import R, REBUILD_SQL, pose_steps
from framelake.plans.registry import query
from framelake.plans.voting import COUNTS_SQL, METRICS_SQL
from framelake.session import scratch_path
from framelake.sources.commits import CommittedTable
from framelake.streaming import sequences as ST


def event_stream(spark, d):
    """The events in seven files without any order, two to a batch."""
    at = scratch_path(spark, "arrivals")
    e = V.table(spark, d, "events")
    e.repartition(7, F.xxhash64("event_id")).write.parquet(at)
    return ST.file_stream(spark, at, e.schema, files_per_batch=2).withColumn("ts", F.col("ts").cast("timestamp"))


# Any file may hold the oldest event, so nothing within this span is late.
SPAN = "60 days"


@query("r01_running_metrics", f"""
  SELECT event_type, {METRICS_SQL} FROM (SELECT event_type, {COUNTS_SQL} FROM (
    SELECT event_type, CASE WHEN event_id % 7 = 0 THEN -1 WHEN value > 20 THEN 1 ELSE 0 END AS point_label, event_id % 7 <> 0 AS valid_mask, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS pred_label, value / 1000 AS prob FROM events) GROUP BY 1)""")
def r01(spark, d):
    e, i = event_stream(spark, d), F.col("event_id")
    rows = e.select("event_type", F.when(i % 7 == 0, -1).when(F.col("value") > 20, 1).otherwise(0).alias("point_label"), (i % 7 != 0).alias("valid_mask"),
                    F.when(F.col("user_id") % 2 == 0, 1).otherwise(0).alias("pred_label"), (F.col("value") / 1000).alias("prob"))
    at = scratch_path(spark, "running")
    table = CommittedTable(spark, f"{at}/out")
    ST.drain(ST.running_metrics(rows, ["event_type"], table, f"{at}/log"))
    return spark.read.parquet(*[f"{at}/out/{p}" for p in table.parts().values()])


@query("r02_event_windows", """
  WITH w AS (SELECT CAST(k AS BIGINT) * 10800 AS start_s, user_id, value FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) // 10800 AS b FROM events), LATERAL (SELECT unnest([b, b - 1]) AS k))
  SELECT start_s, start_s + 21600 AS end_s, user_id, count(*) AS num_points, round(sum(value), 6) AS total FROM w GROUP BY 1, 2, 3""")
def r02(spark, d):
    events, end = ST.with_end(event_stream(spark, d), spark, "ts")
    got = ST.run_to_files(ST.event_windows(events, "6 hours", "3 hours", SPAN, ["user_id"]), spark, "windows", end)
    return got.select(F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "user_id", "num_points", F.round("total", 6).alias("total"))


@query("r02_event_sessions", """
  WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
  SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS num_points FROM s GROUP BY user_id, s""")
def r02_sessions(spark, d):
    events, end = ST.with_end(event_stream(spark, d), spark, "ts")
    got = ST.run_to_files(ST.event_sessions(events, "12 hours", SPAN, ["user_id"]), spark, "sessions", end)
    return got.select("user_id", F.unix_timestamp("start").alias("start_s"), "num_points")


@query("r03_stateful_correction", f"""{REBUILD_SQL}
  SELECT video_name, frame_order, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz, kind FROM walk WHERE frame_order >= 0""", "poses")
def r03(spark, d):
    """Steps arrive in ten files without any order; early ones wait in the state for their turn."""
    st = pose_steps(spark, d)
    rows = st.join(TR.step_scale(st), "video_name").join(TR.progress_axis(st, "early_mean").select("video_name", "ax", "ay", "az"), "video_name")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("frame_order")))
    at = scratch_path(spark, "steps")
    rows.repartition(10, F.xxhash64("video_name", "frame_order")).write.parquet(at)
    spark.conf.set(*ST.STATE_STORE)
    arriving, end = ST.with_end(ST.file_stream(spark, at, rows.schema, files_per_batch=5), spark, "ts")
    got = ST.run_to_files(ST.corrected_steps(arriving, "ts", SPAN), spark, "corrected", end)
    return got.select("video_name", "frame_order", *[R(f"n{c}").alias(f"n{c}") for c in "xyz"], "kind")


@query("r04_unseen_videos", "SELECT DISTINCT user_id AS video_name FROM events")
def r04(spark, d):
    e = event_stream(spark, d).select(F.col("user_id").alias("video_name"), "ts")
    at = scratch_path(spark, "unseen")
    table = CommittedTable(spark, f"{at}/out")
    ST.drain(ST.unseen(e, "video_name", "ts", table, f"{at}/log"))
    return table.read(e.schema).select("video_name")


@query("r04_unseen_after_earlier_runs", """
  WITH early AS (SELECT DISTINCT user_id FROM events WHERE user_id % 4 = 0), listed AS (SELECT DISTINCT user_id FROM events WHERE user_id % 4 = 1)
  SELECT user_id AS video_name, min(ts) AS first_seen FROM events WHERE user_id NOT IN (FROM early) AND user_id NOT IN (FROM listed) GROUP BY user_id""")
def r04_earlier(spark, d):
    """A first stream publishes some videos, others are listed as finished; a second stream over the same table adds the rest.

    Batches of the second stream come in any order, so the first arrival of a
    video is not its first event; that is taken from the events.
    """
    e = V.table(spark, d, "events")
    at = scratch_path(spark, "unseen")
    table = CommittedTable(spark, f"{at}/out")
    arriving = event_stream(spark, d).select(F.col("user_id").alias("video_name"), "ts")
    ST.drain(ST.unseen(arriving.filter("video_name % 4 = 0"), "video_name", "ts", table, f"{at}/first"))
    before = table.read("video_name bigint, ts timestamp").select("video_name")
    listed = e.filter("user_id % 4 = 1").select(F.col("user_id").alias("video_name")).distinct()
    ST.drain(ST.unseen(arriving, "video_name", "ts", table, f"{at}/second", listed))
    added = table.read("video_name bigint, ts timestamp").select("video_name").join(before, "video_name", "left_anti")
    return added.join(e.groupBy(F.col("user_id").alias("video_name")).agg(F.min("ts").cast("timestamp").alias("first_seen")), "video_name")
