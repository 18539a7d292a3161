"""Repeatable sampling, splits and selections.

Randomness is a hash of seed and key, so a run can be repeated and a lost task
gives the same rows again.  Members differ from a random generator's, sizes do
not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framelake.functions.names import hash_number, hash_order
from framelake.functions.ratios import col
from framelake.operators.layout import lookup, with_hash_position, with_position

KEY, POS = "video_name", "frame_order"
GROUP_LIMIT = 1000


def train_validation(df: DataFrame, fraction: float, seed: str, key: str = KEY) -> DataFrame:
    """Split by hash order; the validation part has round(n * fraction) rows, at least one, never all."""
    if fraction >= 1:
        raise ValueError("fraction must be below 1")
    if fraction <= 0:
        return df.withColumn("split", F.lit("train"))
    placed = with_hash_position(df.withColumn("_h", hash_order(seed, key)), [], "_h", [key], "_p")
    n = df.agg(F.count(F.lit(1)))
    size = F.least(F.greatest(F.rint(F.col("_n") * fraction), F.lit(1)), F.col("_n") - 1)
    return placed.withColumn("_n", n.scalar()).withColumn("split", F.when(F.col("_p") < size, "validation").otherwise("train")).drop("_h", "_p", "_n")


def fixed_and_random(df: DataFrame, tokens: Sequence[str], n: int, seed: str, path: str = "path") -> DataFrame:
    """Rows named by the tokens, then ``n`` more by hash order.

    A token must match exactly one row; otherwise the query stops naming it.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("token")) for i, t in enumerate(tokens)])
    hits = df.select(path, F.explode(F.filter(listed, lambda t: F.contains(F.col(path), t["token"]))).alias("_t")).select(path, "_t.*")
    found = hits.groupBy("ordinal", "token").agg(F.count(F.lit(1)).alias("_n"), F.min(path).alias(path))
    asked = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(tokens)], "ordinal int, token string")
    found = asked.join(found, ["ordinal", "token"], "left")
    one = F.when(F.col("_n") == 1, F.col(path)).otherwise(F.raise_error(F.concat(F.lit("token must match one row: "), "token")))
    fixed = found.select(one.alias(path), F.lit("fixed").alias("role"), F.col("ordinal").cast("bigint").alias("place"))
    rest = df.select(path).join(fixed.select(path), path, "left_anti").withColumn("_h", hash_order(seed, path))
    more = with_hash_position(rest, [], "_h", [path], "place").filter(F.col("place") < n)
    return fixed.unionByName(more.select(path, F.lit("random").alias("role"), "place"))


def _with_rank(df: DataFrame, keys: Sequence[str], seed: str, row: str, most: int | None = None) -> DataFrame:
    """0-based place in hash order; with ``most`` only the rows before it.

    For a short list Spark keeps only ``most`` rows per key and task before the
    shuffle (up to GROUP_LIMIT, its default threshold for that); a longer one
    is numbered in even hash buckets.
    """
    ident = F.concat_ws(":", *[F.col(k).cast("string") for k in [*keys, row]])
    if most is not None and most <= GROUP_LIMIT:
        hashed = df.select(*keys, row, F.unhex(hash_order(seed, ident)).alias("_h"))
        ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_h", row))).filter(F.col("_r") <= most)
        return ranked.select(*keys, row, (F.col("_r") - 1).cast("bigint").alias("_p"))
    return with_hash_position(df.withColumn("_h", hash_order(seed, ident)), keys, "_h", [row], "_p")


def _take(cand: DataFrame, keys: Sequence[str], want: Column, seed: str, row: str, tag: str, most: int) -> DataFrame:
    """Exactly ``want`` rows per key: the first in hash order, or drawn with repetition if there are too few.

    Neither takes a place from ``most`` on, the largest ``want`` there is.

    A draw picks a rank by hash and joins on it; nothing is gathered.
    """
    ranked = _with_rank(cand, keys, f"{seed}:{tag}", row, most)
    sizes = cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).withColumn("_want", want)
    few = sizes.filter(F.col("_size") < F.col("_want"))
    draws = few.select(*keys, "_size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_want").cast("bigint"))).alias("_d"))
    ident = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("_d").cast("string"))
    draws = draws.withColumn("_p", F.pmod(hash_number(hash_order(f"{seed}:{tag}:draw", ident)), F.col("_size")))
    enough = lookup(ranked, sizes.filter(F.col("_size") >= F.col("_want")), keys, F.col(row), "inner").filter(F.col("_p") < F.col("_want"))
    plain = enough.select(*keys, row, F.lit(tag).alias("drawn_as"), F.col("_p").alias("draw"))
    again = draws.join(ranked.select(*keys, row, "_p"), [*keys, "_p"]).select(*keys, row, F.lit(tag).alias("drawn_as"), F.col("_d").alias("draw"))
    return plain.unionByName(again)


def exactly(df: DataFrame, keys: Sequence[str], n: int, seed: str, row: str = "point_index", positive_share: float = 0.0,
            label: str = "point_label") -> DataFrame:
    """``n`` rows per key, without repetition where there are enough.

    ``positive_share`` of them (rounded half to even) come from the positive
    rows first, the remainder from all rows.  ``n`` <= 0 keeps everything.
    """
    if n <= 0:
        return df.select(*keys, row, F.lit("all").alias("drawn_as"), F.lit(0).cast("bigint").alias("draw"))
    share = min(1.0, max(0.0, positive_share))
    quota = min(round(n * share), n)
    if quota == 0:
        return _take(df, keys, F.lit(n), seed, row, "any", n)
    pos = df.filter(F.col(label) == 1)
    has = pos.select(*keys).distinct().withColumn("_has", F.lit(True))
    marked = lookup(df, has, keys, F.col(row))
    left = F.when(F.col("_has"), n - quota).otherwise(n)
    # The number still to draw depends on whether the key has positives at all.
    rest = _take(marked.withColumn("_has", F.coalesce("_has", F.lit(False))), [*keys, "_has"], left, seed, row, "any", n).drop("_has")
    return _take(pos, keys, F.lit(quota), seed, row, "positive", quota).unionByName(rest)


def random_frame_window(df: DataFrame, size: int, seed: str) -> DataFrame:
    """Rows of one random run of ``size`` distinct frames per video; short videos stay whole."""
    if size < 1:
        raise ValueError("size must be at least 1")
    frames = df.select(KEY, POS).distinct()
    ranked = with_position(frames, [KEY], [POS], F.floor(F.col(POS) / 65_536), "_i")
    n = frames.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    r = lookup(ranked, n, [KEY], F.col(POS), "inner")
    start = F.when(F.col("_n") > size, F.pmod(hash_number(hash_order(seed, KEY)), F.col("_n") - size + 1)).otherwise(0)
    kept = r.filter((F.col("_i") >= start) & (F.col("_i") < start + size)).select(KEY, POS)
    return df.join(kept, [KEY, POS], "left_semi")


def _first(df: DataFrame, keys: Sequence[str], n: int, seed: str, row: str) -> DataFrame:
    """The first ``n`` rows per key in hash order.

    For a short list Spark keeps only ``n`` rows per key and task before the
    shuffle (up to GROUP_LIMIT, its default threshold for that); a longer one
    is numbered in even hash buckets.
    """
    if n > GROUP_LIMIT:
        return _with_rank(df, keys, seed, row).filter(F.col("_p") < n).drop("_h", "_p")
    w = W.partitionBy(*keys).orderBy("_h", row)
    hashed = df.withColumn("_h", hash_order(seed, F.concat_ws(":", *[F.col(k).cast("string") for k in (*keys, row)])))
    return hashed.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= n).drop("_h", "_p")


def cap_per_group(df: DataFrame, keys: Sequence[str], cap: int, seed: str, row: str = "point_index") -> DataFrame:
    """All rows of a small group, else ``cap`` of them by hash."""
    return _first(df, keys, cap, seed, row)


def evenly_spaced(df: DataFrame, keys: Sequence[str], position: str, k: int) -> DataFrame:
    """``k`` positions spread over each group (linspace, rounded half to even); all if there are not more."""
    n = df.groupBy(*keys).agg((F.max(position) + 1).alias("_n"))
    step = F.lit(1.0) if k < 2 else (F.col("_n") - 1) / F.lit(float(k - 1))
    wanted = F.when(F.col("_n") <= k, F.sequence(F.lit(0).cast("bigint"), F.col("_n").cast("bigint") - 1)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * step).cast("bigint")))
    picks = n.select(*keys, F.explode(wanted).alias("_pos")).distinct()
    return df.join(picks.withColumnRenamed("_pos", position), [*keys, position], "left_semi")


def sparse_frames(df: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` random frames per sequence, in order."""
    return _first(df, [KEY], n, seed, POS)


def drop_frames(df: DataFrame, rate: float, probability: float, seed: str) -> DataFrame:
    """With the given probability per sequence, keep only floor(N * (1 - rate)) random frames."""
    sizes = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    gate = F.pmod(hash_number(hash_order(f"{seed}:gate", KEY)), F.lit(1_000_000)) < int(probability * 1_000_000)
    r = lookup(_with_rank(df, [KEY], seed, POS), sizes.withColumn("_gate", gate), [KEY], F.col(POS), "inner")
    return r.filter(~F.col("_gate") | (F.col("_p") < F.floor(F.col("_n") * (1 - rate)))).drop("_h", "_p", "_n", "_gate")


def stride_frames(df: DataFrame, stride: int, start: int = 0, max_frames: int | None = None, least: int = 2) -> DataFrame:
    """Every ``stride``-th frame from ``start``, at most ``max_frames``; a sequence left with fewer than ``least`` stops the query."""
    hit = df.filter((F.col(POS) >= start) & ((F.col(POS) - start) % stride == 0))
    if max_frames is not None:
        hit = hit.filter((F.col(POS) - start) / stride < max_frames)
    n = hit.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    out = lookup(hit, n, [KEY], F.col(POS), "inner")
    short = F.raise_error(F.concat(F.lit("too few frames left in "), F.col(KEY).cast("string"))).cast("boolean")
    return out.filter(F.when(F.col("_n") < least, short).otherwise(F.lit(True))).drop("_n")


def missing_numbers(df: DataFrame, number: str, report: int = 10) -> DataFrame:
    """Numbers absent from 1..max of each video: how many, and the first few.

    Sixty-four neighbouring numbers are the bits of one row.  With n numbers
    present the first ``report`` gaps end at n + ``report``, so only blocks up
    to there are looked at again; no range is spelt out.
    """
    at = F.col(number).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at - 1, F.lit(64)).cast("int"))
    rows = df.filter(at >= 1).select(KEY, F.shiftright(at - 1, 6).alias("_b"), bit.alias("_m"), at.alias("_i"))
    blocks = rows.groupBy(KEY, "_b").agg(F.bit_or("_m").alias("_m"), F.max("_i").alias("_i"))
    size = blocks.groupBy(KEY).agg(F.sum(F.bit_count("_m")).alias("_n"), F.max("_i").alias("_top"))
    size = size.filter(F.col("_top") > F.col("_n"))
    near = lookup(blocks, size, [KEY], F.col("_b"), "inner").filter(F.col("_b") * 64 < F.col("_n") + report).select(KEY, "_b", "_m")
    first = lambda d, n: d.withColumn("_r", F.row_number().over(W.partitionBy(KEY).orderBy("_b"))).filter(F.col("_r") <= n).drop("_r")
    # Every block with a gap adds one number or more; a block without any row adds sixty-four at once.
    some = first(near.filter("_m <> -1"), report)
    after = near.select(KEY, (F.col("_b") + 1).alias("_b")).unionByName(size.select(KEY, F.lit(0).cast("bigint").alias("_b")))
    whole = -(-report // 64)
    none = first(after.join(near.select(KEY, "_b"), [KEY, "_b"], "left_anti"), whole).select(KEY, F.explode(F.sequence(F.col("_b"), F.col("_b") + whole - 1)).alias("_b")).distinct()
    none = none.join(near.select(KEY, "_b"), [KEY, "_b"], "left_anti").withColumn("_m", F.lit(0).cast("bigint"))
    spots = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("_m", k) == 0)
    found = some.unionByName(none).select(KEY, F.explode(F.transform(spots, lambda k: F.col("_b") * 64 + k + 1)).alias("_i")).join(size.select(KEY, "_top"), KEY).filter(F.col("_i") < F.col("_top"))
    listed = found.groupBy(KEY).agg(F.array_sort(F.collect_list("_i")).alias("_l"))
    text = F.array_join(F.transform(F.slice("_l", 1, report), lambda v: v.cast("string")), ",")
    return size.select(KEY, (F.col("_top") - F.col("_n")).alias("missing")).join(listed.select(KEY, text.alias("first_missing")), KEY)


def temporal_sample(df: DataFrame, every: int, seed: str | None = None) -> DataFrame:
    """Every k-th frame, from 0 or from a repeatable random offset per sequence."""
    off = F.lit(0) if seed is None else F.pmod(hash_number(hash_order(seed, KEY)), F.lit(every))
    return df.filter((F.col(POS) >= off) & (F.pmod(F.col(POS) - off, F.lit(every)) == 0))


def systematic_sample(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, stride: int, cap: int) -> DataFrame:
    """Every ``stride``-th row in order, at most ``cap`` per group."""
    placed = with_position(df, keys, [order], bucket, "_p")
    return placed.filter((F.col("_p") % stride == 0) & (F.col("_p") < stride * cap)).drop("_p")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
