"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql import Window as W

from framelake.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    The written table outlives any executor, and what reads it does not repeat
    the work above it.
    """
    path = scratch_path(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: Sequence[str], amount: str | None = None) -> DataFrame:
    """Rows in one total order: ``position`` (0, 1, 2 ...) and, with ``amount``, ``before`` (its sum over earlier rows).

    Range partitions are numbered on their own; the sizes of the partitions,
    one row each, give every partition its start.  ``order`` should end in a
    column that tells equal rows apart, so that no partition grows beyond its
    share.  Descending columns are given negated.  ``df`` is read twice (once
    to find the ranges), so it should be a stored table.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_sum", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            size = b[amount].to_numpy(zero_copy_only=False).astype(np.int64) if amount else np.ones(n, np.int64)
            ends = total + np.cumsum(size)
            out = {c: b[c] for c in b.schema.names} | {"_part": pa.array(np.full(n, part, np.int32)), "_at": pa.array(np.arange(at, at + n)), "_sum": pa.array(ends - size)}
            yield pa.record_batch(out)
            at, total = at + n, int(ends[-1])

    rows = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, schema))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.lit(1) if amount is None else F.col(amount)).alias("_s"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_s")])
    out = rows.join(F.broadcast(starts), "_part").withColumn("position", F.col("_at") + F.col("_n0"))
    if amount:
        out = out.withColumn("before", F.col("_sum") + F.col("_s0"))
    return out.drop("_part", "_at", "_sum", "_n0", "_s0")


def bit_hex(c: Column) -> Column:
    """64 bits in a bigint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")
