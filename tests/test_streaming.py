"""Streams in many batches, in any order, and repeated: the answer is that of one batch."""

import datetime as dt
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.operators.trajectories import _rebuild
from framelake.session import scratch_path
from framelake.sources.commits import CommittedTable
from framelake.sources.sinks import run_incremental
from framelake.streaming import sequences as ST
from tests.conftest import SF


@pytest.fixture(scope="module")
def events(spark):
    at = scratch_path(spark, "events")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(6, F.xxhash64("event_id")).write.parquet(at)
    return spark.read.parquet(at), lambda: ST.file_stream(spark, at, e.schema, files_per_batch=1)


def test_windows_of_many_shuffled_batches_lose_nothing(spark, events):
    table, stream = events
    arriving, end = ST.with_end(stream(), spark, "ts")
    got = ST.run_to_files(ST.event_windows(arriving, "6 hours", "3 hours", "60 days", ["user_id"]), spark, "w", end)
    want = table.groupBy(F.window("ts", "6 hours", "3 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    assert Counter(map(tuple, got.select("start", "end", "user_id", "num_points").collect())) == Counter(map(tuple, want.select("w.start", "w.end", "user_id", "n").collect()))


def test_a_part_enters_once_and_at_once(spark):
    t = CommittedTable(spark, scratch_path(spark, "parts"))
    assert t.read("k int").count() == 0 and t.parts() == {}
    t.commit("a", spark.range(3).selectExpr("cast(id as int) k"))
    t.commit("b", spark.range(2).selectExpr("cast(id as int) k"))
    spark.range(9).selectExpr("cast(id as int) k").write.parquet(f"{t.path}/parts/killed")  # written, never published
    t.commit("a", spark.range(3).selectExpr("cast(id as int) k"))
    assert t.read("k int").count() == 5 and t.read("k int", without="a").count() == 2
    t.clean()
    assert t.read("k int").count() == 5 and CommittedTable(spark, t.path).parts() == t.parts()
    assert not t._fs.exists(t._at("parts/killed")) and len(t._entries()) == 1


def test_repeated_runs_change_nothing(spark):
    t = CommittedTable(spark, scratch_path(spark, "runs"))
    items = spark.createDataFrame([(i, i * i) for i in range(20)], "item int, x int")
    for run, some in (("r1", items.filter("item < 8")), ("r1", items.filter("item < 8")), ("r2", items), ("r1", items.filter("item < 8")), ("r2", items)):
        run_incremental(some, "item", lambda x: x, t, items.schema, run)
    assert sorted(t.read(items.schema).collect()) == sorted(items.collect())


def test_unseen_keys_come_once_whatever_is_repeated(spark, events):
    table, stream = events
    t, at = CommittedTable(spark, scratch_path(spark, "seen")), scratch_path(spark, "log")
    listed = spark.createDataFrame([(3,), (None,)], "user_id bigint")
    stored = t.commit
    killed = {"left": 2}

    def commit(name, part):
        stored(name, part)
        if killed["left"]:  # the batch is published, but the stream dies before it notes that
            killed["left"] -= 1
            raise RuntimeError("killed")

    t.commit = commit
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            ST.drain(ST.unseen(stream(), "user_id", "ts", t, at, listed))
    ST.drain(ST.unseen(stream(), "user_id", "ts", t, at, listed))
    want = {r[0] for r in table.select("user_id").distinct().collect()} - {3}
    got = [r[0] for r in t.read("user_id bigint, ts timestamp").select("user_id").collect()]
    assert Counter(got) == Counter(want) and len(t.parts()) == 6
    ST.drain(ST.unseen(stream(), "user_id", "ts", t, at + "-again", listed))  # a later run
    assert t.read("user_id bigint, ts timestamp").count() == len(want)


def test_running_metrics_of_the_last_batch_count_everything(spark, events):
    table, stream = events
    cols = ["event_type", (F.col("event_id") % 2).cast("int").alias("point_label"), F.lit(True).alias("valid_mask"), (F.col("user_id") % 2).cast("int").alias("pred_label"), F.lit(0.5).alias("prob")]
    t = CommittedTable(spark, scratch_path(spark, "running"))
    ST.drain(ST.running_metrics(stream().select(*cols), ["event_type"], t, scratch_path(spark, "log")))
    from framelake.operators.metrics import confusion, segmentation_metrics

    want = segmentation_metrics(confusion(table.select(*cols), ["event_type"]))
    got = spark.read.parquet(*[f"{t.path}/{p}" for p in t.parts().values()])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_frames_in_any_order_and_with_gaps_are_corrected_in_order(spark):
    rng, rows = random.Random(6), []
    for v in range(3):
        for i in range(60):
            if (v, i) in ((1, 17), (1, 18), (2, 0)):
                continue  # frames that never come
            s = [rng.gauss(0.3, 1) for _ in range(3)]
            rows.append((v, i, *s, sum(x * x for x in s) ** 0.5, rng.random() > 0.1, 1.0, 1.0, 0.0, 0.0, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=i)))
    cols = ["video_name", "frame_order", "sx", "sy", "sz", "length", "valid", "median_step", "ax", "ay", "az", "ts"]
    schema = "video_name int, frame_order int, sx double, sy double, sz double, length double, valid boolean, median_step double, ax double, ay double, az double, ts timestamp"
    at = scratch_path(spark, "frames")
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(at)
    spark.conf.set(*ST.STATE_STORE)
    arriving, end = ST.with_end(ST.file_stream(spark, at, spark.read.parquet(at).schema, files_per_batch=1), spark, "ts")
    got = ST.run_to_files(ST.corrected_steps(arriving, "ts", "10 days"), spark, "fixed", end).toPandas()
    fold = _rebuild(-0.1, 0.25, 2.0, 0.2, 1e-8)
    all_rows = pd.DataFrame(rows, columns=cols)
    assert len(got) == len(rows)
    for v in range(3):
        mine = all_rows[all_rows.video_name == v].sort_values("frame_order", ignore_index=True)
        want, _ = fold(mine, (1.0, 0.0, 0.0))
        have = got[got.video_name == v].sort_values("frame_order", ignore_index=True)
        assert (have.frame_order == mine.frame_order).all() and (have.kind == want.kind).all()
        assert (abs(have[["nx", "ny", "nz"]] - want[["nx", "ny", "nz"]]) < 1e-12).all().all()
