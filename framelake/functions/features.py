"""Per-point features: scaling, assembly into vectors, masks and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .ratios import col

IGNORE = -1


def scale_byte(c: Column | str) -> Column:
    return col(c).cast("double") / 255.0


def scale_order(c, lo, hi) -> Column:
    """Position of a frame inside its whole video, 0..1."""
    return (col(c) - col(lo)) / F.greatest(col(hi) - col(lo), F.lit(1))


def scale_pixel(c, hi) -> Column:
    return col(c) / F.greatest(col(hi), F.lit(1.0))


def feature_exprs() -> dict[str, list[Column]]:
    """Feature name to its channel expressions (a pixel position has two)."""
    return {
        "intensity": [scale_byte("intensity")],
        "alpha": [scale_byte("alpha")],
        "confidence": [F.col("confidence").cast("double")],
        "frame_order": [F.col("frame_order").cast("double")],
        "normalized_frame_order": [scale_order("frame_order", "min_frame", "max_frame")],
        "pixel_xy": [scale_pixel("pixel_x", "max_x"), scale_pixel("pixel_y", "max_y")],
    }


def feature_vector(names: Sequence[str]) -> Column:
    """Array of the named channels; an unknown name is an error, no name gives an empty array."""
    known = feature_exprs()
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown features {unknown}, known are {sorted(known)}")
    channels = [c.cast("double") for n in names for c in known[n]]
    return F.array(*channels) if channels else F.array().cast("array<double>")


def counted(label="point_label", valid="valid_mask", ignore: int = IGNORE) -> Column:
    """True where a point takes part in the metrics."""
    return col(valid) & (col(label) != ignore)


def outcome_category(label="point_label", valid="valid_mask", pred="pred_label") -> Column:
    """0 TP, 1 FP, 2 FN, 3 TN, 4 ignored but predicted positive, 5 other ignored."""
    ok, pos, hit = counted(label, valid), col(label) == 1, col(pred) == 1
    return (
        F.when(ok & pos & hit, 0).when(ok & ~pos & hit, 1).when(ok & pos & ~hit, 2)
        .when(ok, 3).when(hit, 4).otherwise(5)
    )


def grid_mask(x, y, stride: int, phase: str = "origin") -> Column:
    """Regular grid over the image: from the origin, from half a step, or both."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    starts = {"origin": [0], "centered": [stride // 2], "dual": [0, stride // 2]}
    if phase not in starts:
        raise ValueError(f"unknown phase {phase}")
    x, y = col(x), col(y)
    hits = [
        (x >= o) & (y >= o) & ((x - o) % stride == 0) & ((y - o) % stride == 0) for o in starts[phase]
    ]
    return hits[0] if len(hits) == 1 else hits[0] | hits[1]


def foreground(mode: str = "alpha", minimum: float = 1, stride: int = 1,
               alpha="alpha", intensity="intensity", x="pixel_x", y="pixel_y") -> Column:
    """Which pixels become points."""
    rule = {
        "alpha": col(alpha) >= minimum,
        "all": F.lit(True),
        "nonzero": col(intensity) > 0,
        "intensity": col(intensity) >= minimum,
    }
    if mode not in rule:
        raise ValueError(f"unknown mode {mode}")
    return rule[mode] & grid_mask(x, y, stride) if stride > 1 else rule[mode]


def in_labels(labels: Sequence[int], valid_only: bool = True, label="point_label", valid="valid_mask") -> Column:
    keep = col(label).isin(list(labels))
    return keep & col(valid) if valid_only else keep


def softmax(logits: Sequence[Column]) -> list[Column]:
    """Class probabilities, shifted by the largest logit."""
    top = F.greatest(*logits)
    e = [F.exp(v - top) for v in logits]
    total = e[0]
    for v in e[1:]:
        total = total + v
    return [v / total for v in e]
