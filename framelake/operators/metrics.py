"""Overlap voting, confusion counts and segmentation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelake.functions.features import counted
from framelake.functions.ratios import NULL, ratio

COUNTS = ["tp", "fp", "tn", "fn", "total_points", "valid_points", "valid_positive", "valid_background",
          "ignore_points", "ignore_predicted_positive", "ignore_prob_sum"]


def vote(scored: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), p0: str = "p0", p1: str = "p1") -> DataFrame:
    """Mean class probability over the windows of each point; a tie goes to class 0."""
    aggs = [F.avg(p0).alias("_a0"), F.avg(p1).alias("prob"), F.count(F.lit(1)).alias("vote_count")]
    out = scored.groupBy(*keys).agg(*aggs, *[F.first(c).alias(c) for c in carry])
    return out.withColumn("pred_label", F.when(F.col("prob") > F.col("_a0"), 1).otherwise(0)).drop("_a0")


def without_vote(points: DataFrame, voted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points no window covered; a complete run has none."""
    return points.join(voted.select(*keys), list(keys), "left_anti")


def confusion(df: DataFrame, keys: Sequence[str], label="point_label", valid="valid_mask", pred="pred_label",
              prob: str | None = "prob", ignore: int = -1) -> DataFrame:
    """One pass over the points: outcome counts inside and outside the mask.

    A counted label other than 0 or 1 stops the query.
    """
    ok = counted(label, valid, ignore)
    pos, hit = F.col(label) == 1, F.col(pred) == 1
    odd = ok & ~F.col(label).isin(0, 1)
    ok = F.when(odd, F.raise_error(F.lit("counted labels must be 0 or 1")).cast("boolean")).otherwise(ok)
    rows = df.select(*keys, ok.alias("_ok"), pos.alias("_pos"), hit.alias("_hit"),
                     (F.col(prob) if prob else F.lit(0.0)).cast("double").alias("_prob"))
    c = lambda cond: F.count_if(F.expr(cond))
    return rows.groupBy(*keys).agg(
        c("_ok AND _pos AND _hit").alias("tp"), c("_ok AND NOT _pos AND _hit").alias("fp"),
        c("_ok AND NOT _pos AND NOT _hit").alias("tn"), c("_ok AND _pos AND NOT _hit").alias("fn"),
        F.count(F.lit(1)).alias("total_points"), c("_ok").alias("valid_points"),
        c("_ok AND _pos").alias("valid_positive"), c("_ok AND NOT _pos").alias("valid_background"),
        c("NOT _ok").alias("ignore_points"), c("NOT _ok AND _hit").alias("ignore_predicted_positive"),
        F.coalesce(F.sum(F.expr("CASE WHEN NOT _ok THEN _prob END")), F.lit(0.0)).alias("ignore_prob_sum"))


def metric_columns() -> dict[str, Column]:
    """Ratios over summed counts; an empty denominator gives 0, the ignore mean NULL."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    iou1, iou0 = ratio(tp, tp + fp + fn), ratio(tn, tn + fp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall),
        "iou_positive": iou1, "iou_background": iou0, "mean_iou": (iou1 + iou0) / 2,
        "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp),
        "valid_ratio": ratio("valid_points", "total_points"),
        "valid_positive_ratio": ratio("valid_positive", "valid_points"),
        "valid_background_ratio": ratio("valid_background", "valid_points"),
        "ignore_predicted_positive_ratio": ratio("ignore_predicted_positive", "ignore_points"),
        "ignore_mean_prob": ratio("ignore_prob_sum", "ignore_points", NULL),
    }


def segmentation_metrics(counts: DataFrame, digits: int = 9) -> DataFrame:
    return counts.withColumns({n: F.round(e, digits) for n, e in metric_columns().items()}).withColumn(
        "ignore_prob_sum", F.round("ignore_prob_sum", 6))


def add_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Micro totals: counts are summed, ratios are taken afterwards."""
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def multi_level(scored: DataFrame, voted: DataFrame, split: DataFrame) -> DataFrame:
    """Metrics per window, file and split in one table.

    Window rows judge each window's own prediction, file and split rows the
    voted one, so window counts do not add up to file counts.
    """
    own = scored.withColumn("pred_label", F.when(F.col("p1") > F.col("p0"), 1).otherwise(0))
    per_window = confusion(own, ["checkpoint", "video_name", "window_id"], prob="p1").withColumn("level", F.lit("window"))
    per_file = confusion(voted, ["checkpoint", "video_name"])
    with_split = per_file.join(split, "video_name")
    per_split = add_counts(with_split, ["checkpoint", "split"]).withColumn("level", F.lit("split"))
    out = per_window.join(split, "video_name").unionByName(with_split.withColumn("level", F.lit("file")), True)
    return segmentation_metrics(out.unionByName(per_split, True))


def class_weights(df: DataFrame, classes: int, label="point_label", valid="valid_mask", eps: float = 0.02) -> DataFrame:
    """Counted labels per class and weights 1/(share + eps), scaled to sum to the class count."""
    kept = df.filter(counted(label, valid))
    lab = F.col(label)
    checked = F.when((lab >= 0) & (lab < classes), lab).otherwise(F.raise_error(F.lit("label out of range")).cast("int"))
    got = kept.groupBy(checked.alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    wide = got.agg(*[F.coalesce(F.max(F.when(F.col("class_id") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(classes)])
    total = sum((F.col(f"n{i}") for i in range(1, classes)), F.col("n0"))
    raw = [1 / (F.col(f"n{i}") / total + eps) for i in range(classes)]
    whole = sum(raw[1:], raw[0])
    rows = F.array(*[F.struct(F.lit(i).alias("class_id"), F.col(f"n{i}").alias("n"), (raw[i] * classes / whole).alias("weight"))
                     for i in range(classes)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def sample_diagnostics(df: DataFrame, keys: Sequence[str], sample: Sequence[str], label="point_label",
                       valid="valid_mask", logit0="logit0", logit1="logit1", prob="p1", padding="is_padding", counts: bool = False) -> DataFrame:
    """Per-epoch health figures, combined per sample first and then per epoch.

    ``counts`` adds the confusion counts of the stronger logit, the smallest,
    mean and largest sample without its padding, and the share of samples with
    no valid point.
    """
    ok = counted(label, valid)
    hit = F.col(logit1) > F.col(logit0)
    pos = F.col(label) == 1
    num = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    per_sample = df.groupBy(*keys, *sample).agg(
        F.count(F.lit(1)).alias("slots"), F.count_if(~F.col(padding)).alias("points"), F.count_if(ok).alias("valid"),
        F.count_if(ok & pos).alias("positive"), F.count_if(ok & hit).alias("pred_positive"), F.count_if(ok & pos & hit).alias("tp"),
        num(ok, F.col(logit0)).alias("l0"), num(ok, F.col(logit1)).alias("l1"), num(ok, F.col(prob)).alias("p"),
        num(ok & ~pos, F.col(prob)).alias("p_bg"), num(ok & pos, F.col(prob)).alias("p_pos"))
    s = lambda c: F.sum(c)
    out = per_sample.groupBy(*keys).agg(
        s("slots").alias("total_points"), s("valid").alias("valid_points"), F.count(F.lit(1)).alias("num_samples"),
        F.count_if(F.col("valid") == 0).alias("empty_valid_samples"),
        F.min("valid").alias("min_valid"), F.avg("valid").alias("mean_valid"), F.max("valid").alias("max_valid"),
        s("points").alias("real_points"), F.min("points").alias("min_points"), F.avg("points").alias("mean_points"), F.max("points").alias("max_points"), s("tp").alias("tp"), s("positive").alias("positive"), s("pred_positive").alias("pred_positive"),
        s("l0").alias("l0"), s("l1").alias("l1"), s("p").alias("p"), s("p_bg").alias("p_bg"), s("p_pos").alias("p_pos"))
    v, pos_n = F.col("valid_points"), F.col("positive")
    tp, pred = F.col("tp"), F.col("pred_positive")
    more = [tp, (pred - tp).alias("fp"), (v - pos_n - pred + tp).alias("tn"), (pos_n - tp).alias("fn"), "min_points", "mean_points", "max_points",
            ratio("empty_valid_samples", "num_samples").alias("empty_valid_ratio")] if counts else []
    return out.select(
        *keys, "total_points", "valid_points", "num_samples", "empty_valid_samples", "min_valid", "mean_valid", "max_valid",
        "positive", "pred_positive", ratio(F.col("total_points") - v, "total_points").alias("ignore_ratio"),
        ratio(F.col("total_points") - F.col("real_points"), "total_points").alias("padding_ratio"),
        ratio(pos_n, v).alias("positive_ratio"), ratio("pred_positive", v).alias("pred_positive_ratio"),
        ratio("l0", v).alias("mean_logit_background"), ratio("l1", v).alias("mean_logit_positive"),
        ratio(F.col("l1") - F.col("l0"), v).alias("mean_logit_margin"), ratio("p", v).alias("mean_prob"),
        ratio("p_bg", v - pos_n).alias("mean_prob_on_background"), ratio("p_pos", pos_n).alias("mean_prob_on_positive"), *more)
