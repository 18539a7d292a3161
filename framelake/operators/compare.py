"""Set operations, table comparison, method comparison and expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framelake.functions.ratios import NULL, finite, ratio
from framelake.operators.layout import ordered


def stack(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union of tables with differing columns, each row tagged with its table's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(tag, F.lit(n)) for n, t in tables.items()])


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, both directions in one join."""
    a = expected.select(key).distinct().withColumn("_a", F.lit(True))
    b = actual.select(key).distinct().withColumn("_b", F.lit(True))
    j = a.join(b, key, "full")
    return j.filter(F.col("_a").isNull() | F.col("_b").isNull()).select(key, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def not_within(subset: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    return subset.select(key).distinct().join(whole.select(key), key, "left_anti")


def unexpected_values(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    return df.select(column).distinct().filter(~F.col(column).isin(list(allowed)))


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number differs between two tables; one shuffle, duplicates counted."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    return both.groupBy(*cols).agg(F.sum("_d").alias("surplus")).filter(F.col("surplus") != 0)


def tolerance_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per value column: rows compared, mismatches beyond the tolerance, keys on one side only."""
    left = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(1).alias("_l"))
    right = b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(1).alias("_r"))
    j = left.join(right, list(keys), "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    far = {v: F.when(F.col(f"_a_{v}").isNull() | F.col(f"_b_{v}").isNull(), ~F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}")))
           .otherwise(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}")) > atol + rtol * F.abs(F.col(f"_b_{v}"))) for v in values}
    agg = j.agg(F.count_if(both).alias("compared"), F.count_if(~both).alias("one_sided"), *[F.count_if(both & far[v]).alias(f"m_{v}") for v in values])
    return agg.select("compared", "one_sided", F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"m_{v}").alias("mismatches")) for v in values])).alias("r")).select(
        "compared", "one_sided", "r.*")


def retention_check(old: DataFrame, new: DataFrame, keys: Sequence[str], equal: Sequence[str], close: Sequence[str], flag: Column, atol: float = 1e-6) -> DataFrame:
    """Every old row must be in the new table, unchanged and flagged.  All counts but ``kept`` should be zero."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in [*equal, *close]], flag.alias("_flag"), F.lit(True).alias("_there"))
    j = old.join(n, list(keys), "left")
    there = F.col("_there").isNotNull()
    diff = F.lit(False)
    for c in equal:
        diff = diff | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    off = F.lit(False)
    for c in close:
        off = off | (F.abs(F.col(c) - F.col(f"_n_{c}")) > atol)
    return j.agg(F.count_if(~there).alias("lost"), F.count_if(there & diff).alias("changed"), F.count_if(there & off).alias("moved"), F.count_if(there & ~F.col("_flag")).alias("unflagged"),
                 F.count_if(there).alias("kept"))


def by_method(scores: DataFrame, methods: Sequence[str], key: str = "sweep_id", method: str = "method", metric: str = "metric") -> DataFrame:
    """One column per method, for sweeps every method has."""
    wide = scores.groupBy(key).pivot(method, list(methods)).agg(F.first(metric))
    return wide.dropna(subset=list(methods))


def signed_rank(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Paired signed-rank test on one row: statistic, z with and without tie correction, effect size; see ``two_sided_p``.

    Zero differences leave the ranking but count in ``n`` of ``z_reference``.
    Ranks are averaged over ties from the counts of equal differences, so only
    distinct absolute differences are ordered.
    """
    d = pairs.select((F.col(a) - F.col(b)).alias("_d"))
    n_all = d.agg(F.count(F.lit(1)))
    sizes = d.filter(F.col("_d") != 0).groupBy(F.abs("_d").alias("_abs")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_up"))
    ranked = ordered(sizes, [], ["_abs"], "_n")
    rank = F.col("before") + (F.col("_n") + 1) / 2
    agg = ranked.agg(F.sum(rank * F.col("_up")).alias("w_plus"), F.sum(rank * (F.col("_n") - F.col("_up"))).alias("w_minus"), F.sum("_n").alias("n_nonzero"),
                     F.sum(F.col("_n") ** 3 - F.col("_n")).alias("_ties")).withColumn("n", n_all.scalar())
    stat = F.least("w_plus", "w_minus")
    n, m = F.col("n"), F.col("n_nonzero")
    z_ref = (stat - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    z = (stat - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48)
    return agg.select(stat.alias("statistic"), "n", "n_nonzero", z_ref.alias("z_reference"), (z_ref / F.sqrt(n)).alias("effect_size"), z.alias("z"))


def two_sided_p(z: Column) -> Column:
    """Both tails of the normal distribution beyond ``z``; relative error below 2e-7."""
    # Chebyshev coefficients of the complementary error function.
    coefficients = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    power = F.lit(0.0)
    for c in reversed(coefficients):
        power = power * t + F.lit(c)
    return t * F.exp(power - x * x)


def normal_p_value(z: float) -> float:
    """Two-sided normal tail of one number."""
    import math
    return math.erfc(abs(z) / math.sqrt(2))


def checkpoint_comparison(metrics: DataFrame, metric_cols: Sequence[str], selection: str = "video_name") -> DataFrame:
    """One row per checkpoint and split, and whether all checkpoints saw the same selection.

    The selection is compared by an order-free digest, never gathered.
    """
    h = F.xxhash64(F.col(selection)).cast("decimal(38,0)")
    agg = metrics.groupBy("checkpoint", "split").agg(F.count_distinct(selection).alias("selected"), F.concat_ws(":", F.count(F.lit(1)), F.sum(h)).alias("_sel"),
                                                     *[F.sum(c).alias(c) for c in metric_cols])
    same = agg.groupBy("split").agg((F.count_distinct("_sel") == 1).alias("same_selection"))
    return agg.join(same, "split").drop("_sel")


def mean_metric(scores: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Mean over scans: sums and counts are combined, never means."""
    return scores.groupBy(*keys).agg((F.sum(metric) / F.count(metric)).alias("mean"), F.count(metric).alias("scans"))


def renamed(df: DataFrame, mapping: Mapping[str, str], digits: int | None = None) -> DataFrame:
    """Report names for metric columns, optionally formatted to a number of digits."""
    out = df.withColumnsRenamed(dict(mapping))
    if digits is not None:
        out = out.withColumns({c: F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in mapping.values()})
    return out


def expect(df: DataFrame, rules: Mapping[str, Column], unique: Sequence[str] = (), non_empty: bool = True) -> DataFrame:
    """Rows that break each rule, counted in one aggregate (uniqueness needs its own)."""
    aggs = [F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    pieces = [F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("violations")) for n in rules]
    if non_empty:
        pieces.append(F.struct(F.lit("non_empty").alias("rule"), (F.col("_rows") == 0).cast("bigint").alias("violations")))
    out = row.select(F.explode(F.array(*pieces)).alias("r")).select("r.*")
    if unique:
        dup = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"))
        out = out.unionByName(dup.select(F.lit("unique_" + "_".join(unique)).alias("rule"), "violations"))
    return out


def enforce(report: DataFrame) -> DataFrame:
    """Turn a report of violations into an error for the first broken rule that is read."""
    text = F.concat(F.lit("expectation failed: "), "rule", F.lit(", rows: "), F.col("violations").cast("string"))
    return report.withColumn("violations", F.when(F.col("violations") > 0, F.raise_error(text).cast("bigint")).otherwise(F.col("violations")))


def flag_audit(points: DataFrame, flags: str = "source_flags", kind: str = "source_type") -> DataFrame:
    """Undefined bits, empty flags, and types that disagree with the flags."""
    from framelake.functions import flags as FL
    return points.agg(F.count_if(FL.undefined_bits(flags)).alias("undefined_bits"), F.count_if(F.col(flags) == 0).alias("zero_flags"),
                      F.count_if(F.col(kind) != FL.source_type(flags)).alias("type_mismatch"), F.count(F.lit(1)).alias("points"))
