"""How rows are laid out for ordered and keyed work.

A video may hold a third of all rows, so nothing here sorts or gathers a whole
video in one task.  Ordered work runs on chunks of bounded length: numbering
and running values add a small prefix per chunk, neighbourhood work copies the
few border rows a chunk needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framelake.session import cut_lineage

CHUNK = 65_536
SALTS = 16


def lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column | None = None,
           how: str = "left", salts: int = SALTS, keep: str | None = None) -> DataFrame:
    """Join per-key values onto many rows without putting a hot key on one task.

    ``small`` holds one row per key.  With ``spread`` (any expression that
    differs between rows of one key) the key is salted on both sides.  The
    copies of ``small`` come from a join with the salts, not from an explode:
    Spark counts a join's rows in its size, an exploded array's it does not,
    so only what is small with all its copies is broadcast.

    ``keep`` names a column for the salt, made here or by an earlier lookup
    with the same ``spread``.  Rows that this lookup shuffled by key and salt
    are where joins and groupings by key and that column need them.
    """
    if spread is None:
        return big.join(small, list(keys), how)
    # The coalesce tells Spark that a salt is never null: no filter on it comes between equal subplans, which then share their shuffle.
    salt = keep or "_salt"
    left = big if salt in big.columns else big.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"), F.lit(0)))
    right = small.crossJoin(small.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias(salt)))
    out = left.join(right, [*keys, salt], how)
    return out if keep else out.drop(salt)


def outgrown(side: DataFrame) -> DataFrame:
    """A join side with more rows than Spark expects of it (boxes written out as pixels, or per box): never broadcast.

    Rows that an explode adds are missing in Spark's estimate, and a planned
    broadcast stays even if the side turns out large.
    """
    return side.hint("merge")


def chunk_offsets(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Rows before each bucket of a key, from per-bucket counts."""
    counts = df.groupBy(*keys, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
                  name: str = "position") -> DataFrame:
    """0-based row number per key.  ``bucket`` must grow with ``order``.

    Rows are sorted inside (key, bucket) only; the bucket's own start comes
    from counts that are combined before any shuffle.
    """
    offsets = chunk_offsets(df, keys, bucket)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = df.withColumn("_bucket", bucket).join(offsets, [*keys, "_bucket"])
    return (joined.withColumn(name, (F.row_number().over(inside) - 1 + F.col("_before")).cast("bigint"))
            .drop("_bucket", "_before"))


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str | None = None, name: str = "position", before: str = "before") -> DataFrame:
    """0-based place of each row within its key and, with ``amount``, the sum of it over earlier rows.

    Rows go to ranges of (keys, order) that Spark takes from a sample, so no
    value, however often it or its neighbours occur, decides how they spread.
    Each range is numbered on its own; what lies before a range follows from
    one row of sizes per key and range.  ``order`` should end in something that
    tells rows apart.  The ranges are written down once, so that a repeated
    task finds the same ones.
    """
    keys, order = list(keys), list(order)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    add = F.lit(1) if amount is None else F.col(amount)
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(add).alias("_s"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_s")])
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    out = rows.join(starts, [*keys, "_part"]).withColumn(name, (F.row_number().over(inside) - 1 + F.col("_n0")).cast("bigint"))
    if amount is not None:
        out = out.withColumn(before, F.coalesce(F.sum(add).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_s0"))
    return out.drop("_part", "_n0", "_s0")


def with_hash_position(df: DataFrame, keys: Sequence[str], hash_col: str, ties: Sequence[Column | str] = (),
                       name: str = "position", digits: int = 3) -> DataFrame:
    """0-based position in hash order; hash prefixes are the buckets, so they are even."""
    return with_position(df, keys, [hash_col, *ties], F.substring(hash_col, 1, digits), name)


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Cut each key's rows into chunks and copy border rows to the neighbours.

    ``pos`` counts 0, 1, 2 ... inside a key.  Adds ``_chunk`` and ``_own``
    (false on the copies).
    """
    p = F.col(pos)
    first = F.greatest(F.lit(0), F.floor((p - after) / chunk))
    last = F.floor((p + before) / chunk)
    copies = df.withColumn("_chunk", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    return copies.withColumn("_own", F.floor(p / chunk) == F.col("_chunk"))


def neighbourhood(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int,
                  make: Callable[[W], dict[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """Window expressions that look at most ``before``/``after`` rows away.

    ``make`` gets the window (chunk of a key, ordered by ``pos``) and returns
    the new columns.
    """
    w = W.partitionBy(*keys, "_chunk").orderBy(pos)
    out = with_halo(df, keys, pos, before, after, chunk).withColumns(make(w))
    return out.filter("_own").drop("_own", "_chunk")


def running(df: DataFrame, keys: Sequence[str], pos: str,
            totals: dict[str, tuple[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """Running ``sum``/``max``/``min`` from the first row of each key.

    ``totals`` maps the new column to (kind, expression).  Each chunk is
    scanned on its own and shifted by the combined value of earlier chunks.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    merge = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
    }
    cut = df.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    parts = cut.groupBy(*keys, "_chunk").agg(*[fold[k](e).alias(f"_part_{n}") for n, (k, e) in totals.items()])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    prefix = parts.select(*keys, "_chunk", *[
        fold[k](f"_part_{n}").over(before).alias(f"_before_{n}") for n, (k, _) in totals.items()
    ])
    inside = W.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    out = cut.join(prefix, [*keys, "_chunk"])
    out = out.withColumns({
        n: merge[k](F.col(f"_before_{n}"), fold[k](e).over(inside)) for n, (k, e) in totals.items()
    })
    return out.drop("_chunk", *[f"_before_{n}" for n in totals])


def running_totals(df: DataFrame, keys: Sequence[str], pos: str, values: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Running sums of doubles from the first row of each key, with what rounding took from them added back.

    A plain sum of ten thousands of rows is off in digits that still count.
    The error of one addition is itself a double; errors are summed beside the
    values, inside chunks and over them.  Rows without a value add nothing.
    """
    def lost(a: Column, b: Column) -> Column:
        part = (a + b) - a
        return (a - ((a + b) - part)) + (b - part)

    def over(what: Column, w: W) -> Column:
        return F.coalesce(F.sum(what).over(w), F.lit(0.0))

    names = list(values)
    inside = W.partitionBy(*keys, "_chunk").orderBy(pos)
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before, here = inside.rowsBetween(W.unboundedPreceding, -1), inside.rowsBetween(W.unboundedPreceding, 0)
    cut = df.withColumn("_chunk", F.floor(F.col(pos) / chunk)).withColumns({f"_v_{n}": F.coalesce(e.cast("double"), F.lit(0.0)) for n, e in values.items()})
    cut = cut.withColumns({f"_a_{n}": over(F.col(f"_v_{n}"), before) for n in names})
    cut = cut.withColumns({f"_s_{n}": F.col(f"_a_{n}") + F.col(f"_v_{n}") for n in names} | {f"_l_{n}": over(lost(F.col(f"_a_{n}"), F.col(f"_v_{n}")), here) for n in names})
    ends = cut.groupBy(*keys, "_chunk").agg(*[F.max_by(f"_{p}_{n}", pos).alias(f"_{p}_{n}") for n in names for p in "sl"])
    ends = ends.withColumns({f"_s0_{n}": over(F.col(f"_s_{n}"), earlier) for n in names})
    ends = ends.withColumns({f"_l0_{n}": over(F.col(f"_l_{n}") + lost(F.col(f"_s0_{n}"), F.col(f"_s_{n}")), earlier) for n in names})
    out = cut.join(ends.select(*keys, "_chunk", *[f"_{p}0_{n}" for n in names for p in "sl"]), [*keys, "_chunk"])

    def total(n: str) -> Column:
        start, s = F.col(f"_s0_{n}"), F.col(f"_s_{n}")
        rest = lost(start, s) + (F.col(f"_l0_{n}") + F.col(f"_l_{n}"))
        return start + s + F.when(F.isnan(rest), 0.0).otherwise(rest)  # errors of sums that are not finite are no numbers

    return out.withColumns({n: total(n) for n in names}).drop("_chunk", *[f"_{p}_{n}" for n in names for p in ("v", "a", "s", "l", "s0", "l0")])


def value_bins(counted: DataFrame, keys: Sequence[str], bins: int = 1024, few: int = 10_000) -> DataFrame:
    """Number the bins of a key's different values ``_v``: ``_bin`` grows with the value.  Adds ``_total``, the sum of ``_n``.

    The cuts are quantiles of a sample of the different values, about sixteen
    a bin, so bins are about equal however the values lie, one far value or
    many.  The sample goes by a hash of the value: computed again it is the
    same.  Only the sizes of bins depend on it.  Keys with ``few`` values have
    one bin.
    """
    side = max(2, int(bins ** 0.5))  # a bin is found in two steps of this many comparisons
    size = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_values"))
    sized = lookup(counted, size, keys, F.col("_v"), "inner")
    picked = sized.filter((F.col("_values") > few) & (F.pmod(F.xxhash64("_v"), F.lit(1 << 30)) * F.col("_values") < F.lit(1 << 30) * (16.0 * side ** 2)))
    cuts = picked.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    place = F.sequence(F.lit(1), F.lit(side ** 2 - 1))
    cuts = cuts.withColumn("_cuts", F.transform(place, lambda i: F.element_at("_s", F.greatest(F.lit(1), F.floor(i * F.size("_s") / side ** 2)).cast("int")))).drop("_s")
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.element_at("_cuts", i * side)), lambda c: c <= F.col("_v")))
    fine = F.size(F.filter(F.slice("_cuts", coarse * side + 1, side - 1), lambda c: c <= F.col("_v")))
    binned = lookup(sized, cuts, keys, F.col("_v"), "left")
    return binned.withColumn("_bin", F.when(F.col("_cuts").isNull(), 0).otherwise(coarse * side + fine)).drop("_cuts", "_values")


def _between(low: Column, high: Column, d: Column) -> Column:
    """``low (1 - d) + high d`` with the first product and the sum rounded once, as a fused multiply-add does.

    Values may differ in their last bit only (differences of decimals); then
    each further rounding can move a threshold past one of them.
    """
    def halves(v: Column) -> tuple[Column, Column]:
        top = v * 134217729.0 - (v * 134217729.0 - v)
        return top, v - top

    rest, far = 1 - d, high * d
    p = low * rest
    (a, b), (x, y) = halves(low), halves(rest)
    lost = ((a * x - p) + a * y + b * x) + b * y  # what rounding took from the product
    s = p + far
    back = s - p
    once = s + (((p - (s - back)) + (far - back)) + lost)
    return F.when(F.isnan(once), F.when(low == high, low).otherwise(s)).otherwise(once)


def _ends_of_few(counted: DataFrame, keys: list[str], asked: dict[str, float]) -> DataFrame:
    """Per key the two values around each percentile and the way between them; a key's different values are sorted in one task."""
    whole = W.partitionBy(*keys)
    placed = counted.withColumns({"_end": F.sum("_n").over(whole.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)), "_total": F.sum("_n").over(whole)})

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("_v")))

    exact = {name: F.lit(float(q)) * (F.col("_total") - 1) for name, q in asked.items()}
    return placed.groupBy(*keys).agg(*[
        F.struct(at(F.floor(e)).alias("low"), at(F.ceil(e)).alias("high"), F.max(e - F.floor(e)).alias("d")).alias(name) for name, e in exact.items()])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, asked: dict[str, float], bins: int = 1024, few: int = 10_000) -> DataFrame:
    """Exact linear-interpolated percentiles of groups of any size, 0..1 each.

    Equal values are counted first.  A group with at most ``few`` different
    values is sorted as it is.  The values of a larger one are cut into bins of
    about equal numbers of different values, and only the bins that hold a
    wanted rank are sorted.  Groups without a value are absent.
    """
    keys = list(keys)
    known = df.filter(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [value, *keys])))
    counted = known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    # Reading ``_n`` too lets Spark take the counts from the shuffle that the other readers use.  A large group has a row here for ``few`` of its values.
    size = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values"), F.sum("_n").alias("_rows"))
    large = F.broadcast(size.filter((F.col("_values") > few) & (F.col("_rows") > few)).select(*keys))
    few_ends = _ends_of_few(counted.join(large, keys, "left_anti"), keys, asked)
    binned = value_bins(counted.join(large, keys, "left_semi"), keys, bins)
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bin_sizes = (binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_size"), F.first("_total").alias("_total"))
                 .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))))
    ranks = F.array(*[
        F.struct(F.lit(name).alias("_name"), F.lit(side).alias("_side"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("_exact"))
        for name, q in asked.items() for side in ("low", "high")
    ])
    wanted = bin_sizes.withColumn("_want", F.explode(ranks)).select(*keys, "_bin", "_before", "_size", "_want.*")
    wanted = wanted.withColumn("_rank", F.when(F.col("_side") == "low", F.floor("_exact")).otherwise(F.ceil("_exact")))
    wanted = wanted.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size")))
    hit_bins = wanted.select(*keys, "_bin", "_before").distinct()
    inside = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = (binned.join(hit_bins, [*keys, "_bin"]).withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
              .select(*keys, "_bin", "_v", (F.col("_end") - F.col("_n")).alias("_start"), "_end"))
    on = [ranked[k] == wanted[k] for k in [*keys, "_bin"]]
    on += [wanted["_rank"] >= ranked["_start"], wanted["_rank"] < ranked["_end"]]
    found = wanted.join(ranked, on).select(*[wanted[k] for k in keys], "_name", "_side", "_exact", "_v")
    aggs = []
    for name in asked:
        low = F.max(F.when((F.col("_name") == name) & (F.col("_side") == "low"), F.col("_v")))
        high = F.max(F.when((F.col("_name") == name) & (F.col("_side") == "high"), F.col("_v")))
        exact = F.max(F.when(F.col("_name") == name, F.col("_exact")))
        aggs.append(F.struct(low.alias("low"), high.alias("high"), (exact - F.floor(exact)).alias("d")).alias(name))
    ends = found.groupBy(*keys).agg(*aggs).unionByName(few_ends)
    return ends.select(*keys, *[_between(F.col(f"`{n}`.low"), F.col(f"`{n}`.high"), F.col(f"`{n}`.d")).alias(n) for n in asked])


def percentile_table(df: DataFrame, keys: Sequence[str], asked: dict[str, tuple[str, float]]) -> DataFrame:
    """Percentiles of several columns in one pass: ``{name: (column, quantile)}``."""
    keys = list(keys)
    cols = sorted({c for c, _ in asked.values()})
    qs = sorted({q for _, q in asked.values()})
    pairs = F.array(*[F.struct(F.lit(c).alias("_metric"), F.col(c).cast("double").alias("_value")) for c in cols])
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")
    got = percentiles(long, [*keys, "_metric"], "_value", {f"_q{i}": q for i, q in enumerate(qs)})
    return got.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_metric") == c, F.col(f"_q{qs.index(q)}"))).alias(n) for n, (c, q) in asked.items()])



def group_batches(df: DataFrame, keys: Sequence[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema, order: Sequence[str] = ()) -> DataFrame:
    """Run ``kernel`` on batches of whole groups, sorted by group and ``order``.

    For groups of bounded size (a frame, a chunk).  Many small groups share a
    batch; a group cut by an Arrow batch boundary waits for its other rows.
    """
    keys = list(keys)

    def feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            ids = group_ids(b, keys)
            tail = ids == ids[-1]
            if tail.all() and held and not group_ids(pd.concat([held[-1][keys].tail(1), b[keys].tail(1)]), keys)[-1]:
                held.append(b)
                continue
            done = pd.concat([*held, b[~tail]], ignore_index=True)
            if len(done):
                yield kernel(done)
            held = [b[tail]]
        if held:
            yield kernel(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(feed, schema)


def group_ids(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """0, 1, 2 ... for consecutive groups of a sorted batch; missing keys are equal."""
    if not len(pdf):
        return np.zeros(0, int)
    new = np.zeros(len(pdf), bool)
    for k in keys:
        v = pdf[k].to_numpy()
        gone = pd.isna(v)
        new[1:] |= np.where(gone[1:] | gone[:-1], gone[1:] != gone[:-1], v[1:] != v[:-1]).astype(bool)
    return np.cumsum(new)


def split_groups(pdf: pd.DataFrame, keys: Sequence[str]) -> list[pd.DataFrame]:
    ids = group_ids(pdf, keys)
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(pdf)]
    return [pdf.iloc[i:j] for i, j in zip(cuts, cuts[1:])]
