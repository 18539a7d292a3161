"""Structured Streaming forms: running metrics, event-time windows, stateful correction, skip filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framelake.operators.metrics import confusion, segmentation_metrics
from framelake.operators.trajectories import EPS, REBUILT, _rebuild
from framelake.session import scratch_path
from framelake.sources.commits import CommittedTable


def file_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream, oldest first."""
    r = spark.readStream.schema(schema)
    if glob is not None:
        r = r.option("pathGlobFilter", glob)
    if files_per_batch is not None:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def running_metrics(points: DataFrame, keys: list[str], table: CommittedTable, checkpoint: str) -> DataStreamWriter:
    """Keep the metrics of everything seen so far in ``table``, published anew after each batch.

    The state is the counts per key; ratios are taken when the table is
    written.  Readers see the metrics of one batch or of the next, never parts.
    """
    counts = confusion(points, keys)

    def publish(batch: DataFrame, _: int) -> None:
        table.commit("metrics", segmentation_metrics(batch))

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)


END = "2200-01-01 00:00:00"  # later than any data, and still a time for pandas


def with_end(events: DataFrame, spark: SparkSession, ts: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a second, empty source, and a function that puts an end mark there.

    A drained stream stops with its last windows open.  The mark, one row of
    nulls far in the future, moves the watermark past them.  It must be read
    after all data, or it would make what follows late: drain the stream, put
    the mark, run the stream again from its checkpoint.  The mark's own window
    never closes.
    """
    at = scratch_path(spark, "end")
    mark = [F.lit(END).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.createDataFrame([], events.schema).write.parquet(at)

    def end() -> None:
        spark.range(1).select(*mark).write.mode("append").parquet(at)

    return events.union(spark.readStream.schema(events.schema).parquet(at)), end


def event_windows(events: DataFrame, size: str, slide: str, delay: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Points per overlapping event-time window; late rows beyond ``delay`` are dropped."""
    w = F.window(ts, size, slide).alias("w")
    out = events.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("num_points"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "num_points", "total")


def event_sessions(events: DataFrame, gap: str, delay: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Runs of events with no pause longer than ``gap``."""
    w = F.session_window(ts, gap).alias("w")
    out = events.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("num_points"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "num_points")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StepCorrection(StatefulProcessor):
    """State of a video: the next frame, the reference direction, and steps that came before their turn."""

    def __init__(self, fold, rows: T.StructType, out: T.StructType, ts: str):
        self.fold, self.rows, self.out, self.ts = fold, rows, out, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "next long, rx double, ry double, rz double")
        self.waiting = handle.getListState("waiting", self.rows)

    def _waiting(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=self.rows.names)

    def _folded(self, key: tuple, ready: pd.DataFrame) -> pd.DataFrame:
        """Fold rows whose turn it is and move the state on."""
        state = self.turn.get()
        ref = tuple(state[1:]) if state else tuple(float(ready[c].iloc[0]) for c in ("ax", "ay", "az"))
        new, ref = self.fold(ready, ref)
        self.turn.update((int(ready["frame_order"].iloc[-1]) + 1, *[float(v) for v in ref]))
        head = ready[["frame_order"]].astype("int32").reset_index(drop=True)
        head.insert(0, "video_name", key[0])
        return pd.concat([head, new], axis=1)[self.out.names]

    def _keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.waiting.put([tuple(r) for r in rows.itertuples(index=False)])
        else:
            self.waiting.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [self._waiting()]
        last = None
        for batch in rows:
            batch = batch[self.rows.names].dropna(subset=["frame_order"])  # the end mark has none
            if not len(batch):
                continue
            last = batch[self.ts].max() if last is None else max(last, batch[self.ts].max())
            all_rows = pd.concat([h for h in [*held, batch] if len(h)], ignore_index=True).sort_values("frame_order", ignore_index=True)
            state = self.turn.get()
            begin = state[0] if state else 0
            frames = all_rows["frame_order"].to_numpy()
            n = int((frames == begin + np.arange(len(frames))).cumprod().sum())  # an unbroken row from the next frame on
            if n:
                yield self._folded(key, all_rows.iloc[:n])
            held = [all_rows.iloc[n:]]
        if last is not None:
            self._keep(held[0])
        if last is not None and len(held[0]):
            self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed: frames that are still missing will not come, so what waited goes on without them."""
        held = self._waiting().sort_values("frame_order", ignore_index=True)
        seen = pd.to_datetime(held[self.ts], utc=True) <= pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms", tz="UTC") if len(held) else []
        ready = held[seen] if len(held) else held
        if len(ready):
            last = ready["frame_order"].iloc[-1]
            due = held["frame_order"] <= last
            out = self._folded(key, held[due])
            self._keep(held[~due])
            yield out


def corrected_steps(steps: DataFrame, ts: str, delay: str, min_cos: float = -0.1, min_ratio: float = 0.25, max_ratio: float = 2.0, alpha: float = 0.2, eps: float = EPS) -> DataFrame:
    """Step correction on a stream whose frames may arrive in any order, across batches too.

    Rows bring the static values of their video: median_step and the initial
    direction ax, ay, az; frames count from 0.  A frame is corrected as soon as
    all before it are; frames behind a gap wait until the watermark, ``delay``
    behind the newest ``ts``, has passed them.  Only waiting frames are kept,
    in the state store.
    """
    fold = _rebuild(min_cos, min_ratio, max_ratio, alpha, eps)
    kept = ["frame_order", "sx", "sy", "sz", "length", "valid", "median_step", "ax", "ay", "az", ts]
    rows = T.StructType([steps.schema[c] for c in kept])
    schema = T.StructType([T.StructField("video_name", steps.schema["video_name"].dataType), T.StructField("frame_order", T.IntegerType()), *REBUILT.fields])
    some = steps.select("video_name", *kept).withWatermark(ts, delay)
    return some.groupBy("video_name").transformWithStateInPandas(StepCorrection(fold, rows, schema, ts), schema, "Append", "EventTime")


def unseen(items: DataFrame, key: str, ts: str, table: CommittedTable, checkpoint: str, finished: DataFrame | None = None) -> DataStreamWriter:
    """Publish each key of the stream once: at its first arrival, unless an earlier run has it.

    Keys of earlier runs are those already in ``table`` and those of
    ``finished``; nothing is forgotten, however long the stream runs.  Each
    batch is a part of ``table`` under its number and checkpoint, so a batch
    that is repeated after a kill publishes the same keys.  Rows without a key
    are left out.
    """
    schema = T.StructType([items.schema[key], items.schema[ts]])

    def publish(batch: DataFrame, number: int) -> None:
        name = f"{checkpoint}#{number}"
        fresh = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(ts).alias(ts)).join(table.read(schema, without=name), key, "left_anti")
        if finished is not None:
            fresh = fresh.join(finished, key, "left_anti")
        table.commit(name, fresh)

    return items.select(key, ts).writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)


def drain(writer: DataStreamWriter) -> None:
    """Run a stream until it has read what is there."""
    writer.trigger(availableNow=True).start().awaitTermination()


def run_to_files(df: DataFrame, spark: SparkSession, name: str, end: Callable[[], None] | None = None) -> DataFrame:
    """Drain the stream into Parquet files and read them back; with ``end``, once more from the checkpoint after the end mark."""
    at = scratch_path(spark, name)
    for mark in [None] if end is None else [None, end]:
        if mark is not None:
            mark()
        drain(df.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log"))
    return spark.read.schema(df.schema).parquet(f"{at}/out")
