"""Ordered folds over long sequences, chunk by chunk.

*Steps that compose.*  If a step's effect on the state can be written down
without knowing the state (an affine map, a clamp, a table of a few states, a
matrix), the effects of neighbouring steps combine to one effect.  Then a scan
needs no guess: every chunk is scanned on its own by doubling, and the effects
of whole chunks are combined in rounds that reach twice as far each time.

*Other recurrences* are run on all chunks at once from a guessed start state.
Chunks whose guess turns out different from the end state of their predecessor
run again.  States that forget their past settle after one or two rounds.  The
rounds are bounded by the logarithm of the number of chunks; keys that have
not settled by then are read once more in order, row stream by row stream, with
nothing but the state in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from framelake.operators.layout import CHUNK, group_batches, split_groups
from framelake.session import cut_lineage

Fold = Callable[[pd.DataFrame, tuple], tuple[pd.DataFrame, tuple]]


def _in_order(rows: DataFrame, keys: list[str], pos: str, state: list[str], fold: Fold, schema: T.StructType) -> DataFrame:
    """The state at the start of every chunk, from one pass over each key's rows in order."""
    group = [*keys, "_chunk"]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, at = None, None, ()
        for b in batches:
            for part in split_groups(b, group) if len(b) else []:
                k = tuple(part[keys].iloc[0])
                if k != key:
                    key, chunk, at = k, None, tuple(float(part[s].iloc[0]) for s in state)
                if part["_chunk"].iloc[0] != chunk:
                    chunk = part["_chunk"].iloc[0]
                    yield part[group].iloc[:1].assign(**dict(zip(state, at)))[schema.names]
                at = fold(part, at)[1]

    return rows.repartition(*keys).sortWithinPartitions(*group, pos).mapInPandas(follow, schema)


def chunked_fold(df: DataFrame, keys: Sequence[str], pos: str, start: DataFrame, state: Sequence[str], fold: Fold,
                 out: T.StructType, chunk: int = CHUNK) -> DataFrame:
    """Fold ``fold(rows, state) -> (new columns, state)`` over each key's rows.

    ``start`` has one row per key with the ``state`` columns (doubles).  The
    result holds the keys, ``pos`` and the columns of ``out``.
    """
    keys, state = list(keys), list(state)
    group = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", F.floor(F.col(pos) / chunk).cast("bigint"))
    spans = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    guess = spans.join(start, keys)
    key_fields = [f for f in rows.schema.fields if f.name in keys]
    by_name = {f.name: f for f in rows.schema.fields}

    if last := spans.agg(F.max("_chunk")).first()[0]:
        rows = cut_lineage(rows)
        ends_schema = T.StructType([*key_fields, T.StructField("_chunk", T.LongType()),
                                    *[T.StructField(f"_end_{s}", T.DoubleType()) for s in state]])

        def run_ends(batch: pd.DataFrame) -> pd.DataFrame:
            parts = split_groups(batch, group)
            ends = [fold(p, tuple(float(p[s].iloc[0]) for s in state))[1] for p in parts]
            head = pd.concat([p[group].iloc[:1] for p in parts], ignore_index=True)
            return head.assign(**{f"_end_{s}": [float(e[i]) for e in ends] for i, s in enumerate(state)})

        guess, ends, stale = cut_lineage(guess), None, None
        for _ in range(2 + int(last).bit_length()):
            if stale is not None and stale.isEmpty():
                break
            todo = rows.join(guess if stale is None else stale, group)
            fresh = group_batches(todo, group, run_ends, ends_schema, [pos])
            ends = cut_lineage(fresh if ends is None else ends.join(fresh, group, "left_anti").unionByName(fresh))
            shifted = ends.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), *[F.col(f"_end_{s}") for s in state])
            both = guess.join(shifted, group, "left")
            fixed = both.select(*group, *[F.coalesce(f"_end_{s}", s).alias(s) for s in state],
                                F.expr(" OR ".join(f"NOT (coalesce(_end_{s}, {s}) <=> {s})" for s in state)).alias("_moved"))
            fixed = cut_lineage(fixed)
            guess = fixed.drop("_moved")
            stale = fixed.filter("_moved").drop("_moved")
        if not stale.isEmpty():
            unsettled = stale.select(*keys).distinct()
            begin = _in_order(rows.join(unsettled, keys, "left_semi").join(start, keys), keys, pos, state, fold, guess.schema)
            guess = cut_lineage(guess.join(unsettled, keys, "left_anti").unionByName(begin))

    schema = T.StructType([*key_fields, by_name[pos], *out.fields])

    def run_rows(batch: pd.DataFrame) -> pd.DataFrame:
        new = [fold(p, tuple(float(p[s].iloc[0]) for s in state))[0] for p in split_groups(batch, group)]
        base = batch[[*keys, pos]].reset_index(drop=True)
        return pd.concat([base, pd.concat(new, ignore_index=True)], axis=1)[schema.names]

    return group_batches(rows.join(guess, group), group, run_rows, schema, [pos])


def total(value: str, name: str = "total") -> Fold:
    """Fold for a running total; the state is the sum and what rounding took from it so far.

    A plain sum of millions of rows is off in digits that still count; the
    error of one addition is itself a double and is added up beside it.  Rows
    without a value add nothing.
    """

    def fold(pdf: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        add = np.nan_to_num(pdf[value].to_numpy(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
        sums = np.cumsum(np.concatenate([state[:1], add]))
        before, after = sums[:-1], sums[1:]
        part = after - before
        lost = state[1] + np.cumsum((before - (after - part)) + (add - part))
        return pd.DataFrame({name: np.where(np.isfinite(after), after + lost, after)}), (float(after[-1]), float(lost[-1]))

    return fold


Compose = Callable[[np.ndarray, np.ndarray], np.ndarray]


def affine(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """``x -> a x + b`` as rows (a, b)."""
    return np.column_stack([then[:, 0] * first[:, 0], then[:, 0] * first[:, 1] + then[:, 1]])


def clamp(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """``x -> min(max(x + d, low), high)`` as rows (d, low, high); ``low <= high``."""
    d, low, high = then.T
    return np.column_stack([first[:, 0] + d, *[np.clip(first[:, i] + d, low, high) for i in (1, 2)]])


def states(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """A table of next states, one column per state."""
    return np.take_along_axis(then, first.astype(np.int64), 1)


def matrices(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """``first @ then`` of 4x4 matrices without their last row, as rows of twelve."""
    a, b = (np.concatenate([m.reshape(-1, 3, 4), np.broadcast_to([[[0.0, 0, 0, 1]]], (len(m), 1, 4))], 1) for m in (first, then))
    return (a @ b)[:, :3].reshape(-1, 12)


def _doubled(values: np.ndarray, compose: Compose) -> np.ndarray:
    """All leading compositions of stacked rows, each round reaching twice as far."""
    out, reach = values.copy(), 1
    while reach < len(out):
        out[reach:] = compose(out[:-reach], out[reach:])
        reach *= 2
    return out


def composed(df: DataFrame, keys: Sequence[str], pos: str, effect: str, compose: Compose, name: str = "total", chunk: int = CHUNK) -> DataFrame:
    """``keys, pos, name``: the effects (arrays of doubles) of all rows of a key up to and with each row, composed in order.

    ``compose(first, then)`` takes and gives stacked rows.  The number of Spark
    jobs grows with the logarithm of the number of chunks; no task holds more
    than a chunk, and of other chunks one row each.
    """
    keys = list(keys)
    group = [*keys, "_chunk"]
    cut = df.select(*keys, pos, F.col(effect).alias("_e"), F.floor(F.col(pos) / chunk).cast("bigint").alias("_chunk"))
    fields = {f.name: f for f in cut.schema.fields}
    vec = T.ArrayType(T.DoubleType())

    def inside(batch: pd.DataFrame) -> pd.DataFrame:
        done = [_doubled(np.stack(p["_e"].to_numpy()).astype(float), compose) for p in split_groups(batch, group)]
        return batch[[*keys, pos, "_chunk"]].assign(_p=[r for d in done for r in d])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = b["_before"].notna().to_numpy()
            value = b["_p"].to_numpy(copy=True)
            if some.any():
                new = compose(np.stack(b["_before"][some].to_numpy()).astype(float), np.stack(b["_p"][some].to_numpy()).astype(float))
                for i, v in zip(np.flatnonzero(some), new):
                    value[i] = v
            yield b.drop(columns="_before").assign(_p=value)

    local = group_batches(cut, group, inside, T.StructType([*[fields[k] for k in keys], fields[pos], fields["_chunk"], T.StructField("_p", vec)]), [pos])
    last = cut.agg(F.max("_chunk")).first()[0] or 0
    if last:
        local = cut_lineage(local)
        ends = cut_lineage(local.groupBy(*group).agg(F.max_by("_p", pos).alias("_p")))
        schema, reach = T.StructType([*[fields[k] for k in keys], fields["_chunk"], T.StructField("_p", vec)]), 1
        place = W.partitionBy(*keys).orderBy("_chunk")
        ends = cut_lineage(ends.withColumn("_i", F.row_number().over(place)))  # one row per chunk; chunks without rows leave no gap
        schema = T.StructType([*schema.fields, T.StructField("_i", T.IntegerType())])
        while reach <= last:
            before = ends.select(*keys, (F.col("_i") + reach).alias("_i"), F.col("_p").alias("_before"))
            ends = cut_lineage(ends.join(before, [*keys, "_i"], "left").select(*schema.names, "_before").mapInPandas(joined, schema))
            reach *= 2
        order = ends.select(*group, "_i")
        before = ends.select(*keys, (F.col("_i") + 1).alias("_i"), F.col("_p").alias("_before")).join(order, [*keys, "_i"]).select(*group, "_before")
        local = local.join(before, group, "left").mapInPandas(joined, local.schema)
    return local.select(*keys, pos, F.col("_p").alias(name))


def scan_products(df: DataFrame, keys: Sequence[str], pos: str, matrix: str, name: str = "total",
                  reverse: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Running matrix product of transforms in order: ``before @ this`` or, reversed, ``this @ before``."""
    return composed(df, keys, pos, matrix, (lambda a, b: matrices(b, a)) if reverse else matrices, name, chunk)
