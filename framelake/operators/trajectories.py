"""Steps, progress axes and corrections of pose chains.

Frames count 0, 1, 2 ... inside a video; ``pose`` is a transform column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from framelake.functions import geometry as G
from framelake.functions.ratios import NAN, ratio
from framelake.operators.folds import chunked_fold, composed, states
from framelake.operators.layout import CHUNK, lookup, neighbourhood, percentiles, running, running_totals
from framelake.session import cut_lineage

KEY, POS = "video_name", "frame_order"
EPS = 1e-8


def centers(poses: DataFrame, pose: str = "pose") -> DataFrame:
    x, y, z = G.translation(pose)
    return poses.select(KEY, POS, x.alias("cx"), y.alias("cy"), z.alias("cz"))


def steps(points: DataFrame, eps: float = EPS, chunk: int = CHUNK) -> DataFrame:
    """Step from every frame to the next: vector, length, and whether it can be trusted."""
    nxt = neighbourhood(points, [KEY], POS, 0, 1, lambda w: {f"_n{c}": F.lead(f"c{c}").over(w) for c in "xyz"} | {
        "_next": F.lead(POS).over(w)}, chunk)
    out = nxt.filter(F.col("_next").isNotNull()).withColumns({f"s{c}": F.col(f"_n{c}") - F.col(f"c{c}") for c in "xyz"})
    big = float("inf")
    ok = [F.coalesce(~F.isnan(f"s{c}") & (F.abs(F.col(f"s{c}")) < big), F.lit(False)) for c in "xyz"]
    out = out.withColumn("finite", ok[0] & ok[1] & ok[2])
    length = F.when(F.col("finite"), G.norm([F.col("sx"), F.col("sy"), F.col("sz")])).otherwise(0.0)
    out = out.withColumn("length", length).withColumn("valid", F.col("finite") & (F.col("length") > eps))
    return out.select(KEY, POS, "cx", "cy", "cz", "sx", "sy", "sz", "length", "finite", "valid")


def step_scale(st: DataFrame) -> DataFrame:
    """Median length of the valid steps per video, and how many there are."""
    return percentiles(st.filter("valid"), [KEY], "length", {"median_step": 0.5})


def progress_axis(st: DataFrame, method: str = "first_valid", window: int = 15, strict: bool = False, eps: float = EPS) -> DataFrame:
    """Unit travel direction per video.

    A degenerate mean falls back to the first valid step, or stops the query
    when ``strict``.  ``start_to_end`` uses the first and last centre.
    """
    if method == "start_to_end":
        ends = st.groupBy(KEY).agg(*[F.min_by(f"c{c}", POS).alias(f"b{c}") for c in "xyz"],
                                   *[F.max_by(F.col(f"c{c}") + F.col(f"s{c}"), POS).alias(f"e{c}") for c in "xyz"])
        mean = [F.col(f"e{c}") - F.col(f"b{c}") for c in "xyz"]
        n = G.norm(mean)
        return ends.select(KEY, *[(m / n).alias(f"a{c}") for c, m in zip("xyz", mean)], F.lit(1).cast("bigint").alias("candidates"),
                           n.alias("mean_norm"), F.lit(False).alias("fell_back"))
    unit = st.filter("valid").select(KEY, POS, *[(F.col(f"s{c}") / F.col("length")).alias(f"u{c}") for c in "xyz"])
    if method == "first_valid":
        used = unit
        n_used = 1
    elif method == "early_mean":
        if window < 1:
            raise ValueError("window must be at least 1")
        # A limit on the row number is applied before the shuffle, so few rows per video move.
        used = unit.withColumn("_r", F.row_number().over(W.partitionBy(KEY).orderBy(POS))).filter(F.col("_r") <= window)
        n_used = None
    elif method == "global_mean":
        used, n_used = unit, None
    else:
        raise ValueError(f"unknown method {method}")
    agg = used.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f"u{c}").alias(f"m{c}") for c in "xyz"],
                                *[F.min_by(f"u{c}", POS).alias(f"f{c}") for c in "xyz"])
    first = [F.col(f"f{c}") for c in "xyz"]
    if n_used == 1:
        return agg.select(KEY, *[v.alias(f"a{c}") for c, v in zip("xyz", first)], F.lit(1).cast("bigint").alias("candidates"),
                          F.lit(1.0).alias("mean_norm"), F.lit(False).alias("fell_back"))
    mean = [F.col(f"m{c}") for c in "xyz"]
    n = G.norm(mean)
    bad = n <= eps
    if strict:
        n = F.when(bad, F.raise_error(F.lit("degenerate progress axis")).cast("double")).otherwise(n)
    return agg.select(KEY, *[F.when(bad, f).otherwise(m / n).alias(f"a{c}") for c, f, m in zip("xyz", first, mean)],
                      F.col("_n").alias("candidates"), n.alias("mean_norm"), bad.alias("fell_back"))


def _rebuild(min_cos: float, min_ratio: float, max_ratio: float, alpha: float, eps: float):
    """Fold for one chunk of steps; the state is the unit reference direction."""
    alpha = min(1.0, max(0.0, alpha))

    def fold(pdf: pd.DataFrame, ref: tuple) -> tuple[pd.DataFrame, tuple]:
        s = pdf[["sx", "sy", "sz"]].to_numpy(float)
        length, valid, mid = pdf["length"].to_numpy(float), pdf["valid"].to_numpy(bool), pdf["median_step"].to_numpy(float)
        new, kind = np.empty_like(s), []
        rx, ry, rz = ref
        for i in range(len(s)):
            m = mid[i]
            unit = s[i] / length[i] if valid[i] else None
            if unit is None or unit[0] * rx + unit[1] * ry + unit[2] * rz < min_cos:
                new[i] = (rx * m, ry * m, rz * m)
                kind.append("invalid" if unit is None else "reverse")
                continue
            lo, hi = min_ratio * m, max_ratio * m
            size = min(max(length[i], lo), hi)
            kind.append("short" if length[i] < lo else "long" if length[i] > hi else "kept")
            new[i] = unit * size
            shrink = size / max(size, eps)
            ux, uy, uz = ((1 - alpha) * r + alpha * u * shrink for r, u in zip((rx, ry, rz), unit))
            n = math.sqrt(ux * ux + uy * uy + uz * uz)
            if n > eps and math.isfinite(n):
                rx, ry, rz = ux / n, uy / n, uz / n
        return pd.DataFrame({"nx": new[:, 0], "ny": new[:, 1], "nz": new[:, 2], "kind": kind}), (rx, ry, rz)

    return fold


REBUILT = T.StructType([T.StructField(f"n{c}", T.DoubleType()) for c in "xyz"] + [T.StructField("kind", T.StringType())])


def rebuild_steps(st: DataFrame, axis: DataFrame, scale: DataFrame, min_cos: float = -0.1, min_ratio: float = 0.25,
                  max_ratio: float = 2.0, alpha: float = 0.2, eps: float = EPS, chunk: int = CHUNK) -> DataFrame:
    """Replace backward and broken steps by the reference direction, clip the others' length.

    The reference direction is a running average of the accepted directions,
    so this is a true recurrence; see ``folds``.
    """
    rows = lookup(st.select(KEY, POS, "sx", "sy", "sz", "length", "valid"), scale, [KEY], F.col(POS), "inner")
    start = axis.select(KEY, F.col("ax").alias("rx"), F.col("ay").alias("ry"), F.col("az").alias("rz"))
    # Later stages read the steps more than once; the Python fold should run once.
    return cut_lineage(chunked_fold(rows, [KEY], POS, start, ["rx", "ry", "rz"], _rebuild(min_cos, min_ratio, max_ratio, alpha, eps), REBUILT, chunk))


def positions(first: DataFrame, new_steps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Centres from the first centre of each video and its steps."""
    tot = running_totals(new_steps, [KEY], POS, {f"t{c}": F.col(f"n{c}") for c in "xyz"}, chunk)
    tot = tot.select(KEY, (F.col(POS) + 1).cast("int").alias(POS), "tx", "ty", "tz")
    zero = first.select(KEY, F.lit(0).cast("int").alias(POS), *[F.lit(0.0).alias(f"t{c}") for c in "xyz"])
    joined = lookup(tot.unionByName(zero), first, [KEY], F.col(POS), "inner")
    return joined.select(KEY, POS, *[(F.col(f"o{c}") + F.col(f"t{c}")).alias(f"c{c}") for c in "xyz"])


def origins(points: DataFrame) -> DataFrame:
    return points.groupBy(KEY).agg(*[F.min_by(f"c{c}", POS).alias(f"o{c}") for c in "xyz"])


def _along(points: DataFrame, axis: DataFrame) -> DataFrame:
    """Progress ``p`` of every centre along the axis, from the first centre."""
    base = lookup(points, origins(points).join(axis.select(KEY, "ax", "ay", "az"), KEY), [KEY], F.col(POS), "inner")
    rel = [F.col(f"c{c}") - F.col(f"o{c}") for c in "xyz"]
    return base.withColumn("p", G.dot(rel, [F.col("ax"), F.col("ay"), F.col("az")]))


def monotone(points: DataFrame, axis: DataFrame, min_step: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Never step back along the axis: progress is at least the previous one plus ``min_step``.

    Closed form: with q = p - i*s the answer is max(q up to i) + i*s.
    """
    a = lookup(_along(points, axis), min_step, [KEY], F.col(POS), "inner")
    a = a.withColumn("_q", F.col("p") - F.col(POS) * F.col("min_step"))
    r = running(a, [KEY], POS, {"_top": ("max", F.col("_q"))}, chunk)
    r = r.withColumn("adjusted", F.col("_top") > F.col("_q"))
    lift = F.when(F.col("adjusted"), F.col("_top") + F.col(POS) * F.col("min_step") - F.col("p")).otherwise(0.0)
    return r.withColumn("lift", lift).select(
        KEY, POS, *[(F.col(f"c{c}") + F.col("lift") * F.col(f"a{c}")).alias(f"c{c}") for c in "xyz"], "adjusted",
        F.abs("lift").alias("shift"))


def frame_normals(poses: DataFrame, pose: str = "pose") -> DataFrame:
    m = G.cells(pose)
    v = [m[2], m[6], m[10]]
    n = G.norm(v)
    return poses.select(KEY, POS, *[(c / n).alias(f"q{a}") for a, c in zip("xyz", v)])


def push_same_side(points: DataFrame, normals: DataFrame, axis: DataFrame, min_step: DataFrame, eps: float = EPS,
                   chunk: int = CHUNK) -> DataFrame:
    """Move the rest of the sequence when both neighbours lie on one side of a frame.

    The reversed travel direction stands in for the neighbour before frame 0.
    A step is either kept or pushed to one known other place, so whether it is
    pushed depends only on whether the step before was: a table of two states,
    and the tables of all steps compose.
    """
    def dot(a: str, b: str) -> Column:
        return sum((F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in "yz"), F.col(f"{a}x") * F.col(f"{b}x"))

    st = steps(points, eps, chunk).select(KEY, POS, "sx", "sy", "sz")
    rows = lookup(st.join(normals, [KEY, POS]), min_step, [KEY], F.col(POS), "inner")
    rows = lookup(rows, axis.select(KEY, "ax", "ay", "az"), [KEY], F.col(POS), "inner").withColumn("ahead", dot("s", "q"))
    far = -F.signum("ahead") * F.col("min_step") - F.col("ahead")  # a pushed step has both neighbours on the side that ``ahead`` names
    rows = rows.withColumns({f"p{c}": F.col(f"s{c}") + far * F.col(f"q{c}") for c in "xyz"})
    before = {f"{b}{c}": F.lag(f"{b}{c}") for b in "sp" for c in "xyz"}
    rows = neighbourhood(rows, [KEY], POS, 1, 0, lambda w: {f"b{n}": v.over(w) for n, v in before.items()}, chunk)
    rows = rows.withColumns({f"b{b}{c}": F.coalesce(f"b{b}{c}", f"a{c}") for b in "sp" for c in "xyz"})

    def pushed(b: str) -> Column:
        back = -dot(f"b{b}", "q")
        return ((F.abs(back) > eps) & (F.abs("ahead") > eps) & (back * F.col("ahead") >= 0)).cast("double")

    rows = cut_lineage(rows.select(KEY, POS, "sx", "sy", "sz", "px", "py", "pz", F.array(pushed("s"), pushed("p")).alias("_table")))
    state = composed(rows, [KEY], POS, "_table", states, "_state", chunk)
    hit = F.col("_state")[0] == 1  # the step before the first counts as not pushed
    moved = cut_lineage(rows.join(state, [KEY, POS]).select(KEY, POS, *[F.when(hit, F.col(f"p{c}")).otherwise(F.col(f"s{c}")).alias(f"n{c}") for c in "xyz"], hit.alias("pushed")))
    flags = moved.select(KEY, (F.col(POS) + 1).cast("int").alias(POS), "pushed")
    return positions(origins(points), moved, chunk).join(flags, [KEY, POS], "left").withColumn("pushed", F.coalesce("pushed", F.lit(False)))


def scale_along(points: DataFrame, axis: DataFrame, scale: float) -> DataFrame:
    """Stretch the trajectory along the axis only."""
    if not (math.isfinite(scale) and scale > 0):
        raise ValueError("scale must be finite and positive")
    a = _along(points, axis)
    return a.select(KEY, POS, *[(F.col(f"c{c}") + (scale - 1) * F.col("p") * F.col(f"a{c}")).alias(f"c{c}") for c in "xyz"],
                    F.abs((scale - 1) * F.col("p")).alias("shift"), "p", (F.col("p") * scale).alias("p_scaled"))


def corrected(poses: DataFrame, pose: str = "pose", method: str = "first_valid", window: int = 15, min_cos: float = -0.1,
              min_ratio: float = 0.25, max_ratio: float = 2.0, alpha: float = 0.2, monotone_ratio: float | None = None,
              same_side_ratio: float | None = None, scale: float = 1.0, eps: float = EPS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Rebuild, make monotone, push, stretch; rotations are kept.  Returns the poses and one record per video.

    Videos without a usable step keep their poses.  Every stage reads the one
    before it several times, so the narrow centre and step tables are written
    out in between instead of being computed again.  The record counts steps by
    kind and moved frames by stage, with mean and largest shift of each stage
    over all its frames; a stage that did not run, and a video that was not
    corrected, has zeros.
    """
    c = cut_lineage(centers(poses, pose))
    st = cut_lineage(steps(c, eps, chunk))
    mid = step_scale(st).filter(F.col("median_step") > eps)
    mid, axis = cut_lineage(mid), cut_lineage(progress_axis(st, method, window, eps=eps))
    new = rebuild_steps(st, axis, mid, min_cos, min_ratio, max_ratio, alpha, eps, chunk)
    first = origins(c).join(mid, KEY, "left_semi")
    out = positions(first, new, chunk)
    kinds = new.groupBy(KEY).agg(*[F.count_if(F.col("kind") == k).alias(f"num_{k}_steps") for k in ("reverse", "short", "long")])
    lengths = st.groupBy(KEY).agg(F.count_if(~F.col("valid")).alias("num_invalid_steps"), F.avg(F.when(F.col("valid"), F.col("length"))).alias("prior_length_mean"))
    parts = [lengths, mid.select(KEY, "median_step"), kinds]

    def moved(df: DataFrame, name: str, *counts: Column) -> DataFrame:
        return df.groupBy(KEY).agg(*counts, F.avg("shift").alias(f"{name}_shift_mean"), F.max("shift").alias(f"{name}_shift_max"))

    if monotone_ratio is not None:
        done = cut_lineage(monotone(cut_lineage(out), axis, mid.select(KEY, (F.col("median_step") * monotone_ratio).alias("min_step")), chunk))
        parts.append(moved(done, "monotone", F.count_if("adjusted").alias("num_monotone_adjusted")))
        out = done.select(KEY, POS, "cx", "cy", "cz")
    if same_side_ratio is not None:
        before = cut_lineage(out)
        done = cut_lineage(push_same_side(before, frame_normals(poses, pose), axis, mid.select(KEY, (F.col("median_step") * same_side_ratio).alias("min_step")), eps, chunk))
        both = done.join(before.select(KEY, POS, *[F.col(f"c{x}").alias(f"o{x}") for x in "xyz"]), [KEY, POS])
        shifts = both.withColumn("shift", G.norm([F.col(f"c{x}") - F.col(f"o{x}") for x in "xyz"]))
        parts.append(moved(shifts, "same_side", F.count_if("pushed").alias("num_same_side_corrected")))
        out = done.select(KEY, POS, "cx", "cy", "cz")
    if abs(scale - 1) > eps:
        done = cut_lineage(scale_along(cut_lineage(out), axis, scale))
        parts.append(moved(done, "scale", (F.max("p") - F.min("p")).alias("extent_before"), (F.max("p_scaled") - F.min("p_scaled")).alias("extent_after")))
        out = done.select(KEY, POS, "cx", "cy", "cz")
    m = G.cells(pose)
    fixed = [F.coalesce(F.col({3: "cx", 7: "cy", 11: "cz"}[i]), m[i]) if i in (3, 7, 11) else m[i] for i in range(12)]
    whole = poses.join(out, [KEY, POS], "left").withColumn("pose_corr", F.array(*fixed)).drop("cx", "cy", "cz")
    record = poses.select(KEY).distinct()
    for p in parts:
        record = record.join(p, KEY, "left")
    return whole, record.na.fill(0)


def correct(poses: DataFrame, pose: str = "pose", **options) -> DataFrame:
    """The poses of ``corrected``, with its options."""
    return corrected(poses, pose, **options)[0]


def step_report(new_steps: DataFrame, videos: DataFrame) -> DataFrame:
    """Shares of reversed, short, long and broken steps; videos without a correction say so."""
    agg = new_steps.groupBy(KEY).agg(F.count(F.lit(1)).alias("steps"), *[
        F.count_if(F.col("kind") == k).alias(f"{k}_steps") for k in ("reverse", "short", "long", "invalid")])
    out = videos.join(agg, KEY, "left")
    return out.select(KEY, F.when(F.col("steps").isNull(), "missing_tracking_correction").otherwise("ok").alias("status"), "steps",
                      *[F.when(F.col("steps").isNotNull(), ratio(f"{k}_steps", "steps")).alias(f"{k}_ratio")
                        for k in ("reverse", "short", "long", "invalid")])


def step_pairs(prior: DataFrame, corrected: DataFrame, normals: DataFrame, axis: DataFrame, pairs: DataFrame | None = None,
               min_step: float = 0.0, eps: float = EPS, chunk: int = CHUNK) -> DataFrame:
    """Prior and corrected step of frame pairs against the axis and the frame's normal.

    Without ``pairs`` (video_name, frame_i, frame_j) every frame is paired with the next.
    """
    both = prior.join(corrected.select(KEY, POS, *[F.col(f"c{c}").alias(f"k{c}") for c in "xyz"]), [KEY, POS]).join(normals, [KEY, POS])
    names = [f"{p}{c}" for p in "ck" for c in "xyz"]
    if pairs is None:
        two = neighbourhood(both, [KEY], POS, 0, 1, lambda w: {f"j{n}": F.lead(n).over(w) for n in names} | {"frame_j": F.lead(POS).over(w)}, chunk)
        two = two.filter(F.col("frame_j").isNotNull()).withColumnRenamed(POS, "frame_i")
    else:
        i = both.withColumnRenamed(POS, "frame_i")
        j = both.select(KEY, F.col(POS).alias("frame_j"), *[F.col(n).alias(f"j{n}") for n in names])
        two = pairs.join(i, [KEY, "frame_i"]).join(j, [KEY, "frame_j"])
    two = lookup(two, axis.select(KEY, "ax", "ay", "az"), [KEY], F.col("frame_i"), "inner")
    a, q = [F.col(f"a{c}") for c in "xyz"], [F.col(f"q{c}") for c in "xyz"]
    s = {p: [F.col(f"j{p}{c}") - F.col(f"{p}{c}") for c in "xyz"] for p in "ck"}
    sign = F.when(G.dot(q, a) >= 0, 1).otherwise(-1)
    corr_axis, corr_normal = G.dot(s["k"], a), G.dot(s["k"], q) * sign
    return two.select(
        KEY, "frame_i", "frame_j", G.norm(s["c"]).alias("prior_len"), G.norm(s["k"]).alias("corr_len"),
        G.dot(s["c"], a).alias("prior_axis_delta"), corr_axis.alias("corr_axis_delta"), (corr_axis < -eps).alias("is_reverse"),
        (corr_axis + eps < min_step).alias("violates_min_step"), sign.alias("normal_sign"),
        (G.dot(s["c"], q) * sign).alias("prior_normal_delta"), corr_normal.alias("corr_normal_delta"),
        (corr_normal < -eps).alias("is_normal_reverse"))


def global_poses(poses: DataFrame, pose: str = "pose", name: str = "pose_global") -> DataFrame:
    """Every pose seen from the first one of its video."""
    first = poses.groupBy(KEY).agg(F.min_by(pose, POS).alias("_first"))
    return lookup(poses, first, [KEY], F.col(POS), "inner").withColumn(name, G.relative("_first", pose)).drop("_first")


def local_poses(poses: DataFrame, pose: str = "pose", name: str = "pose_local", chunk: int = CHUNK) -> DataFrame:
    """Every pose seen from the one before; the first is the identity."""
    out = neighbourhood(poses, [KEY], POS, 1, 0, lambda w: {"_prev": F.lag(pose).over(w)}, chunk)
    return out.withColumn(name, F.when(F.col("_prev").isNull(), G.literal(G.IDENTITY)).otherwise(G.relative("_prev", pose))).drop("_prev")


def moving_average(df: DataFrame, values: Sequence[str], size: int, chunk: int = CHUNK) -> DataFrame:
    """Centred mean over ``size`` rows with mirrored ends (edge row repeated)."""
    left, right = size // 2, size - 1 - size // 2
    n = df.groupBy(KEY).agg((F.max(POS) + 1).alias("_n"))
    rows = lookup(df.select(KEY, POS, *values), n, [KEY], F.col(POS), "inner")
    turns = F.sequence(F.lit(0) - F.ceil(F.lit(size) / (2 * F.col("_n"))) - 1, F.ceil(F.lit(size) / (2 * F.col("_n"))) + 1)
    spots = F.flatten(F.transform(turns, lambda t: F.array(F.col(POS) + 2 * F.col("_n") * t, -1 - F.col(POS) + 2 * F.col("_n") * t)))
    spots = F.filter(spots, lambda p: (p >= -left) & (p < F.col("_n") + right))
    wide = rows.withColumn("_spot", F.explode(spots)).withColumn("_spot", F.col("_spot") + left)

    def means(w):
        frame = w.rowsBetween(-left, right)
        return {f"{v}_mean": F.avg(v).over(frame) for v in values}

    out = neighbourhood(wide.drop(POS), [KEY], "_spot", left, right, means, chunk)
    out = out.withColumn(POS, (F.col("_spot") - left).cast("int")).filter((F.col(POS) >= 0) & (F.col(POS) < F.col("_n")))
    return out.select(KEY, POS, *[f"{v}_mean" for v in values])


def reverse_falling(poses: DataFrame, pose: str = "pose", turn: bool = False) -> DataFrame:
    """Make sequences rise in z: reversed in time, or turned half way about y with x mirrored."""
    glob = global_poses(poses, pose, "_g")
    z = F.col("_g").getItem(11)
    ends = glob.groupBy(KEY).agg((F.max_by(z, POS) - F.min_by(z, POS)).alias("dz"), (F.max(POS) + 1).alias("_n"))
    out = lookup(poses, ends, [KEY], F.col(POS), "inner").withColumn("flipped", F.col("dz") < 0)
    if turn:
        half = G.literal([-1, 0, 0, 0, 0, 1, 0, 0, 0, 0, -1, 0])
        return out.withColumn(pose, F.when(F.col("flipped"), G.product(pose, half)).otherwise(F.col(pose))).drop("_n", "dz")
    return out.withColumn(POS, F.when(F.col("flipped"), F.col("_n") - 1 - F.col(POS)).otherwise(F.col(POS)).cast("int")).drop("_n", "dz")
