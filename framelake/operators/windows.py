"""Overlapping frame windows and the rows that fall into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelake.functions.names import hash_number, hash_order
from framelake.operators.layout import lookup, with_position


def frame_spans(df: DataFrame, keys: Sequence[str] = ("video_name",), frame: str = "frame_order") -> DataFrame:
    """First and last frame of each video; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min(frame).alias("min_frame"), F.max(frame).alias("max_frame"))


def _window_count(size: int, stride: int, tail: bool) -> Column:
    """How many windows a span needs: one more than the strides to reach its end.

    Without a tail a short last window is left out, unless it is the only one.
    """
    span = F.col("max_frame") - F.col("min_frame") + 1
    full = F.floor((span - size) / stride) if not tail else F.ceil((span - size) / stride)
    return (1 + F.greatest(F.lit(0), full)).cast("bigint")


def frame_windows(df: DataFrame, size: int, stride: int, tail: bool = True,
                  keys: Sequence[str] = ("video_name",), frame: str = "frame_order") -> DataFrame:
    """Windows of ``size`` frames every ``stride`` frames, last one clipped to the end."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be at least 1")
    spans = frame_spans(df, keys, frame)
    w = spans.withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("bigint"), _window_count(size, stride, tail) - 1)))
    start = F.col("min_frame") + F.col("window_id") * stride
    out = w.select(*keys, "window_id", start.cast("int").alias("start_frame"),
                   F.least(start + size - 1, F.col("max_frame")).cast("int").alias("end_frame"))
    return out.filter(F.col("start_frame") <= F.col("end_frame"))


def into_windows(df: DataFrame, size: int, stride: int, tail: bool = True, keys: Sequence[str] = ("video_name",),
                 frame: str = "frame_order", spread: str = "point_index", keep: str | None = None) -> DataFrame:
    """Each row once per window that covers its frame.

    The covering ids follow from arithmetic on the frame, so there is no range
    join: only the video's span is looked up, salted against hot videos; ``keep``
    names a column for the salt.
    """
    joined = lookup(df, frame_spans(df, keys, frame), keys, F.col(spread), "inner", keep=keep)
    rel = F.col(frame) - F.col("min_frame")
    lo = F.greatest(F.lit(0), F.ceil((rel - size + 1) / stride))
    hi = F.least(_window_count(size, stride, tail) - 1, F.floor(rel / stride))
    ids = F.when(lo <= hi, F.sequence(lo.cast("bigint"), hi.cast("bigint")))
    out = joined.withColumn("window_id", F.explode(ids))
    start = F.col("min_frame") + F.col("window_id") * stride
    return out.withColumn("start_frame", start.cast("int")).withColumn(
        "end_frame", F.least(start + size - 1, F.col("max_frame")).cast("int")).drop("min_frame", "max_frame")


def window_summary(rows: DataFrame, windows: DataFrame, keys: Sequence[str] = ("video_name", "window_id")) -> DataFrame:
    """Points per window, empty windows included."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_points"))
    return windows.join(counts, list(keys), "left").withColumn("num_points", F.coalesce("num_points", F.lit(0)))


def subsequences(lengths: DataFrame, length: int, key: str = "video_name", n: str = "num_frames") -> DataFrame:
    """Every start of a fixed-length run inside each sequence."""
    ok = lengths.filter(F.col(n) >= length)
    return ok.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - length)).alias("start"))


def one_subsequence(lengths: DataFrame, length: int, seed: str, key: str = "video_name", n: str = "num_frames") -> DataFrame:
    """One repeatable random start per sequence; needs strictly more frames than ``length``."""
    ok = lengths.filter(F.col(n) > length)
    return ok.select(key, F.pmod(hash_number(hash_order(seed, key)), F.col(n) - length).cast("bigint").alias("start"))


def scoring_chunks(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, size: int) -> DataFrame:
    """Fixed-size chunks of rows in order, for a scorer with bounded memory."""
    numbered = with_position(df, keys, [order], bucket, "_pos")
    return numbered.withColumn("chunk", F.floor(F.col("_pos") / size)).withColumn("slot", F.col("_pos") % size).drop("_pos")


def padded(df: DataFrame, batch: str, sample: str, slot: str, fills: dict[str, object]) -> DataFrame:
    """Pad every sample to the longest of its batch, one row per slot.

    Rows stay rows: padding is generated from the missing length and no sample
    is gathered into one array.  ``is_padding`` marks the fill rows.
    """
    sizes = df.groupBy(batch, sample).agg(F.count(F.lit(1)).alias("num_points"))
    longest = sizes.groupBy(batch).agg(F.max("num_points").alias("padded_to"))
    both = sizes.join(longest, batch)
    short = both.filter(F.col("num_points") < F.col("padded_to"))
    pad = short.select(batch, sample, F.explode(F.sequence(F.col("num_points"), F.col("padded_to") - 1)).alias(slot),
                       *[F.lit(v).alias(c) for c, v in fills.items()], F.lit(True).alias("is_padding"))
    real = df.select(batch, sample, F.col(slot).cast("bigint").alias(slot), *fills, F.lit(False).alias("is_padding"))
    return real.unionByName(pad)
