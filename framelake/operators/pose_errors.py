"""Errors between measured and predicted pose chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelake.functions import geometry as G
from framelake.functions.ratios import nan_to_null
from framelake.operators.layout import lookup
from framelake.operators.trajectories import KEY, POS, global_poses, local_poses

DOF = ["x", "y", "z", "pitch", "roll", "yaw"]


def dof_errors(poses: DataFrame, pose: str = "pose", pred: str = "pred") -> DataFrame:
    """Mean absolute error per degree of freedom; angles are not wrapped."""
    a, b = G.to_euler(pose), G.to_euler(pred)
    return poses.groupBy(KEY).agg(*[F.avg(F.abs(p - q)).alias(n) for n, p, q in zip(DOF, a, b)])


def _distance(a: list[Column], b: list[Column]) -> Column:
    return G.norm(G.minus(a, b))


def drift(poses: DataFrame, pose: str = "pose", pred: str = "pred") -> DataFrame:
    """Distance per frame and its share of the distance from the start, in percent.

    Only 0/0 is left out of the mean; x/0 stays infinite.
    """
    glob = global_poses(poses, pose, "_g")
    d = _distance(G.translation(pose), G.translation(pred))
    far = G.norm(G.translation("_g"))
    rate = F.when(far != 0, d / far * 100).when(d == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    rows = glob.select(KEY, POS, d.alias("drift"), rate.alias("rate"))
    return rows.groupBy(KEY).agg(F.max_by("rate", POS).alias("final_drift_rate"), F.avg(nan_to_null("rate")).alias("avg_drift_rate"),
                                 F.max("drift").alias("max_drift"), F.sum("drift").alias("sum_of_drift"))


def image_points(width: int, height: int, mode: str = "five") -> Column:
    """Pixels at which displacement is measured, as an array of (x, y)."""
    ends = [(0, 0), (width, 0), (0, height), (width, height)]
    if mode == "all":
        return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.struct(
            F.floor(i / height).cast("double").alias("px"), (i % height).cast("double").alias("py")))
    chosen = {"five": [*ends, (width // 2, height // 2)], "corners": ends}[mode]
    return F.array(*[F.struct(F.lit(float(x)).alias("px"), F.lit(float(y)).alias("py")) for x, y in chosen])


def displacement_errors(poses: DataFrame, calibration: Sequence[float], width: int, height: int, mode: str = "five",
                        pose: str = "pose", pred: str = "pred") -> DataFrame:
    """Average and largest displacement-field error per video, first frame left out.

    Global fields are taken from the first frame, local ones from the frame
    before.  The points are generated per row; nothing is joined.
    """
    g = global_poses(global_poses(poses, pose, "_g"), pred, "_gp")
    both = local_poses(local_poses(g, pose, "_l"), pred, "_lp").filter(F.col(POS) > 0)
    rows = both.select(KEY, POS, "_g", "_gp", "_l", "_lp", F.explode(image_points(width, height, mode)).alias("_pt"))
    at = G.move(G.literal(list(calibration)), F.col("_pt.px"), F.col("_pt.py"))
    rows = rows.select(KEY, POS, "_g", "_gp", "_l", "_lp", *[c.alias(n) for n, c in zip(("ix", "iy", "iz"), at)])
    p = [F.col("ix"), F.col("iy"), F.col("iz")]
    seen = {t: G.move(t, *p) for t in ("_g", "_gp", "_l", "_lp")}
    reach = _distance(seen["_g"], p)
    err = _distance(seen["_g"], seen["_gp"])
    per_frame = rows.groupBy(KEY, POS).agg(F.avg(err).alias("g"), F.avg(_distance(seen["_l"], seen["_lp"])).alias("l"),
                                           F.avg(err / F.when(reach != 0, reach)).alias("r"))
    return per_frame.groupBy(KEY).agg(
        F.avg("g").alias("avg_global_displacement_error"), F.max("g").alias("max_global_displacement_error"),
        F.avg("l").alias("avg_local_displacement_error"), F.max("l").alias("max_local_displacement_error"),
        F.avg("r").alias("relative_global_error"))


def landmark_displacement(poses: DataFrame, landmarks: DataFrame, calibration: Sequence[float], pose: str = "pose") -> DataFrame:
    """Displacement of landmarks (video_name, frame_order, px, py) by the pose of their own frame."""
    joined = landmarks.join(global_poses(poses, pose, "_g").select(KEY, POS, "_g"), [KEY, POS])
    at = G.move(G.literal(list(calibration)), F.col("px"), F.col("py"))
    rows = joined.select(*landmarks.columns, "_g", *[c.alias(n) for n, c in zip(("ix", "iy", "iz"), at)])
    p = [F.col("ix"), F.col("iy"), F.col("iz")]
    return rows.select(*landmarks.columns, *[d.alias(n) for n, d in zip(("dx", "dy", "dz"), G.minus(G.move("_g", *p), p))])


def sweep_extent(poses: DataFrame, pose: str = "pose") -> DataFrame:
    """Frames and distance between the first and last translation."""
    ends = poses.groupBy(KEY).agg(F.count(F.lit(1)).alias("num_frames"), F.min_by(pose, POS).alias("a"), F.max_by(pose, POS).alias("b"))
    return ends.select(KEY, "num_frames", _distance(G.translation("b"), G.translation("a")).alias("displacement"))


def step_statistics(poses: DataFrame, pose: str = "pose") -> DataFrame:
    """Pooled mean and population deviation of relative steps, one row per degree of freedom."""
    loc = local_poses(poses, pose, "_l").filter(F.col(POS) > 0)
    vals = G.to_euler("_l")
    agg = loc.agg(*[F.avg(v).alias(f"m_{n}") for n, v in zip(DOF, vals)], *[F.stddev_pop(v).alias(f"s_{n}") for n, v in zip(DOF, vals)])
    rows = F.array(*[F.struct(F.lit(n).alias("dof"), F.col(f"m_{n}").alias("mean"), F.col(f"s_{n}").alias("std")) for n in DOF])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def end_deltas(poses: DataFrame, pose: str = "pose") -> DataFrame:
    """Last minus first degree of freedom of the poses seen from the first frame."""
    glob = global_poses(poses, pose, "_g").groupBy(KEY).agg(F.max_by("_g", POS).alias("b"), F.min_by("_g", POS).alias("a"))
    return glob.select(KEY, *[(q - p).alias(f"delta_{n}") for n, p, q in zip(DOF, G.to_euler("a"), G.to_euler("b"))])


def pixel_statistics(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Unweighted mean over sweeps of each sweep's brightness mean and deviation (0..1)."""
    v = F.col(value) / 255.0
    per = cells.groupBy(*keys).agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
    return per.agg(F.avg("m").alias("pixel_mean"), F.avg("s").alias("pixel_std"))


BLOCK = 256


def _blocks(points: DataFrame, side: str) -> DataFrame:
    """Bounding boxes of runs of positions, with their parent run."""
    b = F.floor(F.col(POS) / BLOCK).cast("bigint")
    lims = [f(f"c{c}").alias(f"{n}{c}_{side}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(KEY, b.alias(f"block_{side}")).agg(*lims)


def _parents(blocks: DataFrame, side: str) -> DataFrame:
    lims = [f(f"{n}{c}_{side}").alias(f"{n}{c}_{side}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    return blocks.groupBy(KEY, F.floor(F.col(f"block_{side}") / BLOCK).cast("bigint").alias(f"parent_{side}")).agg(*lims)


def _bounds() -> tuple[Column, Column]:
    """Squared lower bound and upper bound on the distance from any left to some right position of two boxes."""
    low, high = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        gap = F.greatest(F.lit(0.0), F.col(f"lo{c}_r") - F.col(f"hi{c}_l"), F.col(f"lo{c}_l") - F.col(f"hi{c}_r"))
        wide = F.greatest(F.abs(F.col(f"hi{c}_r") - F.col(f"lo{c}_l")), F.abs(F.col(f"hi{c}_l") - F.col(f"lo{c}_r")))
        low, high = low + gap * gap, high + wide * wide
    return low, high


def _close_pairs(left: DataFrame, right: DataFrame, on: list[str], mine: str, other: str) -> DataFrame:
    """Pairs of boxes that can hold a nearest neighbour, by bounds alone."""
    low, high = _bounds()
    pairs = left.join(right, on).select(*on, mine, other, low.alias("_low"), high.alias("_high"))
    best = pairs.groupBy(*on, mine).agg(F.min("_high").alias("_best"))
    return pairs.join(best, [*on, mine]).filter(F.col("_low") <= F.col("_best") * (1 + 1e-12)).select(*on, mine, other)


def directed_hausdorff(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Largest distance from a position of ``a`` to its nearest position of ``b``, exactly.

    Positions are grouped into runs and runs into parents; bounding boxes rule
    out far runs level by level, so rows only meet rows of near runs.
    """
    lb, rb = _blocks(a, "l"), _blocks(b, "r")
    near = _close_pairs(_parents(lb, "l"), _parents(rb, "r"), [KEY], "parent_l", "parent_r")
    par = lambda df, s: df.withColumn(f"parent_{s}", F.floor(F.col(f"block_{s}") / BLOCK).cast("bigint"))
    # A parent's best bound holds for all its runs, so pruning continues inside the kept parents.
    cand = near.join(par(lb, "l"), [KEY, "parent_l"]).join(par(rb, "r"), [KEY, "parent_r"])
    low, high = _bounds()
    cand = cand.select(KEY, "block_l", "block_r", low.alias("_low"), high.alias("_high"))
    best = cand.groupBy(KEY, "block_l").agg(F.min("_high").alias("_best"))
    pairs = cand.join(best, [KEY, "block_l"]).filter(F.col("_low") <= F.col("_best") * (1 + 1e-12)).select(KEY, "block_l", "block_r")
    blk = F.floor(F.col(POS) / BLOCK).cast("bigint")
    l = a.select(KEY, POS, blk.alias("block_l"), "cx", "cy", "cz")
    # A run of the other side is one array of at most BLOCK positions, so rows are not paired up.
    r = b.groupBy(KEY, blk.alias("block_r")).agg(F.collect_list(F.struct("cx", "cy", "cz")).alias("_run"))
    rows = pairs.join(l, [KEY, "block_l"]).join(r, [KEY, "block_r"])
    x, y, z = F.col("cx"), F.col("cy"), F.col("cz")
    d = F.array_min(F.transform("_run", lambda q: (x - q["cx"]) * (x - q["cx"]) + (y - q["cy"]) * (y - q["cy"]) + (z - q["cz"]) * (z - q["cz"])))
    nearest = rows.groupBy(KEY, POS).agg(F.min(d).alias("_d"))
    return nearest.groupBy(KEY).agg(F.sqrt(F.max("_d")).alias(name))


def hausdorff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Larger of the two directed distances per video."""
    both = directed_hausdorff(a, b, "forward").join(directed_hausdorff(b, a, "backward"), KEY)
    return both.withColumn("hausdorff", F.greatest("forward", "backward"))
