"""Per-video scaling, schema back-fill, candidate choice and source counts of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelake.functions import features as FE, flags as FL
from framelake.functions.ratios import NAN, finite, ratio
from framelake.operators.layout import lookup


def with_video_ranges(points: DataFrame, key: str = "video_name", spread: str = "point_index") -> DataFrame:
    """Frame and pixel ranges of the whole video on every point, taken before any windowing."""
    ranges = points.groupBy(key).agg(F.min("frame_order").alias("min_frame"), F.max("frame_order").alias("max_frame"),
                                     F.max("pixel_x").alias("max_x"), F.max("pixel_y").alias("max_y"))
    return lookup(points, ranges, [key], F.col(spread), "inner")


def normalize_xyz(points: DataFrame, key: str = "video_name", spread: str = "point_index") -> DataFrame:
    """Centre each video's points and divide by the largest radius (1 where that is no use)."""
    centre = points.groupBy(key).agg(*[F.avg(c).alias(f"_m{c}") for c in "xyz"])
    moved = lookup(points, centre, [key], F.col(spread), "inner").withColumns({f"{c}n": F.col(c) - F.col(f"_m{c}") for c in "xyz"})
    reach = moved.groupBy(key).agg(F.max(F.sqrt(F.col("xn") ** 2 + F.col("yn") ** 2 + F.col("zn") ** 2)).alias("_r"))
    usable = finite("_r")
    scale = F.when(usable >= 1e-6, usable).otherwise(1.0)
    out = lookup(moved, reach, [key], F.col(spread), "inner").withColumn("_r", scale)
    return out.withColumns({f"{c}n": F.col(f"{c}n") / F.col("_r") for c in "xyz"}).drop("_r", "_mx", "_my", "_mz")


def backfill_sources(points: DataFrame, point_mode: str | Column = "foreground") -> DataFrame:
    """Add source columns an older table lacks, and say that they were inferred."""
    mode = F.lit(point_mode) if isinstance(point_mode, str) else point_mode
    out = points
    no_flags, no_conf = "source_flags" not in points.columns, "sampling_confidence" not in points.columns
    if no_flags:
        bit = F.when(mode == "foreground", FL.SOURCE_BITS["global"]).otherwise(FL.SOURCE_BITS["context"])
        out = out.withColumn("source_flags", bit)
    if no_conf:
        out = out.withColumn("sampling_confidence", F.col("confidence").cast("double"))
    return out.withColumns({"source_flags_inferred": F.lit(no_flags), "sampling_confidence_inferred": F.lit(no_conf)})


def candidates(points: DataFrame, key: str = "video_name", spread: str = "point_index") -> DataFrame:
    """Counted points of each video; a video with none keeps all its points."""
    any_ok = points.groupBy(key).agg(F.max(FE.counted()).alias("_any"))
    return lookup(points, any_ok, [key], F.col(spread), "inner").filter(FE.counted() | ~F.col("_any")).drop("_any")


def label_counts(points: DataFrame, keys: Sequence[str], label: str = "point_label") -> DataFrame:
    """Selected points per label with ratios; a label outside -1, 0, 1 stops the query."""
    lab = F.col(label)
    ok = F.when(lab.isin(-1, 0, 1), lab).otherwise(F.raise_error(F.lit("unexpected label")).cast("int"))
    out = points.withColumn("_l", ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_l") == 1).alias("positive"),
        F.count_if(F.col("_l") == 0).alias("background"), F.count_if(F.col("_l") == -1).alias("ignored"))
    return out.withColumns({
        "positive_ratio": ratio("positive", "total"), "background_ratio": ratio("background", "total"),
        "ignore_ratio": ratio("ignored", "total"), "useful_ratio": ratio(F.col("positive") + F.col("background"), "total")})


def source_label_counts(points: DataFrame, keys: Sequence[str], flags: str = "source_flags", label: str = "point_label") -> DataFrame:
    """Points per source bit and label, and those picked by the context grid alone; one wide pass."""
    groups = {s: FL.has_source(flags, s) for s in FL.SOURCE_BITS} | {"context_only": FL.context_only(flags)}
    labels = {"selected": F.lit(True), "positive": F.col(label) == 1, "background": F.col(label) == 0, "ignored": F.col(label) == -1}
    return points.groupBy(*keys).agg(*[
        F.count_if(g & l).alias(f"{gn}_{ln}") for gn, g in groups.items() for ln, l in labels.items()])


def source_summary(points: DataFrame, keys: Sequence[str], flags: str = "source_flags") -> DataFrame:
    """Totals per source, evidence points, overlaps, and total over global points."""
    out = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(FL.has_source(flags, s)).alias(f"{s}_points") for s in FL.SOURCE_BITS],
        F.count_if(FL.any_of([FL.has_source(flags, s) for s in ("global", "local", "tophat")])).alias("evidence_points"),
        F.count_if(FL.source_overlap(flags)).alias("overlap_points"), F.count_if(FL.context_only(flags)).alias("context_only_points"))
    return out.withColumn("multiplier", ratio("total", "global_points", NAN))


def frame_counts(points: DataFrame, spine: DataFrame, keys: Sequence[str] = ("video_name", "frame_order")) -> DataFrame:
    """Points per frame with zeros for frames of the spine that have none."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_points"))
    return spine.join(n, list(keys), "left").withColumn("num_points", F.coalesce("num_points", F.lit(0)))


def project(points: DataFrame, poses: DataFrame, pixel_to_image: list[float],
            keys: Sequence[str] = ("video_name", "frame_order"), pose: str = "pose") -> DataFrame:
    """Pixels to world positions.  Pose and calibration are multiplied once per frame.

    A point whose frame has no pose keeps its row with null positions.
    """
    from framelake.functions import geometry as G

    ready = poses.select(*keys, G.product(pose, G.literal(pixel_to_image)).alias("_t"))
    out = lookup(points, ready, keys, F.col("point_index"), "left")
    x, y, z = G.move("_t", F.col("pixel_x"), F.col("pixel_y"))
    return out.withColumns({"wx": x, "wy": y, "wz": z}).drop("_t")
