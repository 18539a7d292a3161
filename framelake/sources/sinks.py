"""Writers and incremental runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from framelake.sources.commits import CommittedTable


def write_ragged_csv(tables: Sequence[DataFrame], path: str) -> None:
    """Tables with differing columns as one CSV; columns in first-seen order, missing values empty."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(voted: DataFrame, summary: DataFrame, path: str, part: str | None = None) -> None:
    """Predictions partitioned by checkpoint and split, sorted by video inside files; the window table beside them.

    Videos are a sort column, not a folder each, so a run over millions of
    videos does not make millions of files.  ``part`` names a column of the
    few parts of each video that already lie together; then rows are sorted
    where they are and the column is left out.
    """
    keys = ["checkpoint", "split"]
    placed = voted.drop(part) if part else voted.repartition(*keys, "video_name", F.pmod(F.xxhash64("point_index"), F.lit(16)))
    out = placed.sortWithinPartitions(*keys, "video_name", "point_index")
    out.write.mode("overwrite").partitionBy(*keys).option("compression", "zstd").parquet(f"{path}/predictions")
    summary.write.mode("overwrite").parquet(f"{path}/windows")


def append_json_lines(records: DataFrame, path: str) -> None:
    """Add records as JSON lines to what ``path`` already holds; Spark's commit leaves nothing of a failed run."""
    records.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])).alias("value")).write.mode("append").text(path)


def write_id_lists(ids: DataFrame, path: str) -> None:
    """The ids of each split, one per line in id order, in a folder per split: ``ids (split, id)``.

    A large split goes to several files; their names are in id order.
    """
    out = ids.select("split", "id", F.col("id").cast("string").alias("value")).repartitionByRange("split", "id").sortWithinPartitions("split", "id")
    out.select("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary of one row as a JSON file; more rows stop the write."""
    n = summary.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
    bad = F.raise_error(F.lit("a summary has one row")).cast("boolean")
    n.filter(F.when(F.col("_n") > 1, bad).otherwise(F.lit(True))).drop("_n").coalesce(1).write.mode("overwrite").json(path)


def collect_status(sources: DataFrame, existing: DataFrame, dry_run: bool = False, overwrite: bool = False) -> DataFrame:
    """What a collection run does with each source (path, name): copied, skipped_exists or dry_run.

    Two sources with one destination stop the query.
    """
    n = sources.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    have = existing.select("name").distinct().withColumn("_have", F.lit(True))
    j = sources.join(n, "name").join(have, "name", "left")
    bad = F.raise_error(F.concat(F.lit("duplicate destination "), "name"))
    skip = F.col("_have").isNotNull() & F.lit(not overwrite)
    status = F.when(F.col("_n") > 1, bad).when(skip, "skipped_exists").when(F.lit(dry_run), "dry_run").otherwise("copied")
    return j.select("path", "name", status.alias("status"))


def incremental(items: DataFrame, finished: DataFrame, key: str, check: Column, error: Column) -> DataFrame:
    """One row per item: skipped if finished, failed with its error text if the check fails, else ok.

    A failing item never stops the others.
    """
    done = finished.select(key).distinct().withColumn("_done", F.lit(True))
    j = items.join(done, key, "left")
    ok = F.coalesce(check, F.lit(False))
    status = F.when(F.col("_done"), "skipped").when(ok, "ok").otherwise("failed")
    return j.withColumn("status", status).withColumn("error", F.when(F.col("status") == "failed", error)).drop("_done")


def run_incremental(items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], table: CommittedTable, schema: T.StructType, run: str) -> DataFrame:
    """Process the items no other run has finished and publish their results under ``run``.

    A run that is repeated, after a kill or by mistake, replaces its own
    results and nothing else.  Items without a key never count as finished.
    """
    finished = table.read(schema, without=run).select(key).distinct()
    table.commit(run, work(items.join(finished, key, "left_anti")))
    return table.read(schema)
