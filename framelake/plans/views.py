"""Library tables derived from the given tables, whole and without a driver step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framelake.functions import geometry as G
from framelake.operators import layout
from framelake.operators.windows import frame_windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows as labelled points: a narrow projection, no shuffle.

    ``point_index`` spells out the unique key of a row inside its video, so it
    holds keys of any size.
    """
    li = table(spark, sf_dir, "lineitem")
    parts = ["l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint")]
    label = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    return li.select(
        F.col("l_suppkey").alias("video_name"),
        F.concat_ws("-", *parts).alias("point_index"),
        (F.col("l_orderkey") % 40).cast("int").alias("frame_order"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_orderkey") % 40).cast("double").alias("z"),
        F.col("l_quantity").alias("pixel_x"), F.round(F.col("l_discount") * 100).alias("pixel_y"),
        (F.col("l_partkey") % 256).cast("int").alias("intensity"),
        ((F.col("l_partkey") * 3) % 256).cast("int").alias("alpha"),
        (F.col("l_tax") * 10).alias("confidence"),
        (1 + F.col("l_partkey") % 15).cast("int").alias("source_flags"),
        F.col("l_partkey").alias("part_key"),
        label.cast("int").alias("point_label"), (label != -1).alias("valid_mask"),
    )


def point_bucket() -> Column:
    """Buckets that grow with ``point_index``: about eighty a video, so their counts stay far fewer than the points."""
    return F.substring("point_index", 1, 2)


def windows(spark: SparkSession, sf_dir: str, size: int = 12, stride: int = 6) -> DataFrame:
    return frame_windows(points(spark, sf_dir).select("video_name", "frame_order"), size, stride)


def scores(exploded: DataFrame) -> DataFrame:
    """A deterministic scorer for two checkpoints on point-window rows."""
    p1 = lambda k: ((F.col("part_key") * k + F.col("window_id") * 13) % 101) / F.lit(100.0)
    both = F.array(*[F.struct(F.lit(n).alias("checkpoint"), p1(k).alias("p1")) for n, k in (("ckpt_a", 7), ("ckpt_b", 11))])
    return (exploded.withColumn("_s", F.explode(both)).withColumn("checkpoint", F.col("_s.checkpoint"))
            .withColumn("p1", F.col("_s.p1")).withColumn("p0", 1 - F.col("_s.p1")).drop("_s"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per part, twenty per video; the first frames of a video hold two."""
    p = table(spark, sf_dir, "part")
    slot = F.col("p_partkey") % 20
    xmin = (F.col("p_size") % 25).cast("double")
    ymin = (F.col("p_partkey") % 5).cast("double")
    return p.select(
        F.floor(F.col("p_partkey") / 20).cast("bigint").alias("video_name"),
        (slot % 15).cast("int").alias("frame_order"),
        F.floor(slot / 15).cast("int").alias("bbox_index"),
        F.col("p_brand").alias("object_name"),
        xmin.alias("xmin"), ymin.alias("ymin"), (xmin + 10).alias("xmax"), (ymin + 4).alias("ymax"),
        ((F.col("p_size") % 7) != 0).alias("valid"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a user's sequence, numbered in time order."""
    e = table(spark, sf_dir, "events")
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    numbered = layout.with_position(e, ["user_id"], ["ts", "event_id"], hour, "frame_order")
    return numbered.select(F.col("user_id").alias("video_name"), F.col("frame_order").cast("int").alias("frame_order"),
                           F.col("event_id").alias("frame_index"), F.col("event_type").alias("source"), "value", "ts")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as two pose chains per label: measured and predicted."""
    e = table(spark, sf_dir, "embeddings")
    numbered = layout.with_position(e, ["label"], ["vec_id"], F.floor(F.col("vec_id") / 4096), "frame_order")
    v = lambda i: F.col("embedding").getItem(i).cast("double")
    step = F.col("frame_order") * 0.1

    def pose(at: int) -> Column:
        return G.from_euler(v(at), v(at + 1), v(at + 2) + step, v(at + 3) * 90, v(at + 4) * 90, v(at + 5) * 90)

    return numbered.select(F.col("label").alias("video_name"), F.col("frame_order").cast("int").alias("frame_order"),
                           pose(0).alias("pose"), pose(6).alias("pred"))


def video_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("video_name"),
                    F.when(F.col("s_suppkey") % 5 == 0, "validation").otherwise("train").alias("split"))


def method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average order value per customer (sweep) and priority (method)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("sweep_id"), F.col("o_orderpriority").alias("method")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("metric"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightest value per pixel of a frame; at most one row per image cell."""
    return points(spark, sf_dir).groupBy("video_name", "frame_order", F.col("pixel_x").cast("int").alias("x"),
                                         F.col("pixel_y").cast("int").alias("y")).agg(F.max("intensity").alias("value"))
