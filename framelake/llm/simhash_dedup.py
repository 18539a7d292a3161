"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart meet at a value that lies within
half the distance of both.  Every fingerprint emits the values of its ball,
one shuffle brings equal values together, and what meets is linked.

Two passes keep the balls small:

1. *Sieve.*  Three differing bits leave two thirds of the fingerprint with at
   most two.  For each choice of two thirds a fingerprint emits its ball of
   radius one there (132 values); a fingerprint that meets no other is alone
   and takes no further part.
2. *Meeting.*  The rest emit their full balls: everybody the 65 values of
   radius one, and fingerprints of odd parity also those 992 values of radius
   two whose two flipped bits lie in the same half.  An odd distance needs
   different parities, and of three differing bits two lie in one half, so
   every pair at distance three meets with the even side one and the odd side
   two flips away.  All who meet at a value where somebody is at most one flip
   away are linked to the smallest such member: a star, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import bit_hex, stored
from .components import components

SEED = 42
RADIUS = 3
_SLAB = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text: majority vote of the shingles' XXH64."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    k = min(width, n)
    a, b = (ends - size)[: n - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), _SLAB):
        votes += np.unpackbits(h[i:i + _SLAB].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def fingerprints(text: str) -> Column:
    """Signed 64-bit fingerprint of a text column, whole texts in Arrow batches."""

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")

    return F.pandas_udf(each, T.LongType())(text)


def _sieve_masks() -> list[tuple[int, int, int]]:
    """(kept bits, flipped bit or none, mark of the dropped third) for each value a fingerprint emits."""
    cuts, out = [(0, 21), (21, 42), (42, 64)], []
    for k, (lo, hi) in enumerate(cuts):
        dropped = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        flips = [0] + [1 << b for b in range(64) if not lo <= b < hi]
        out += [(_signed(~dropped & (1 << 64) - 1), _signed(f), _signed((k + 1) << lo)) for f in flips]
    return out


def _long_array(values: list[int]):
    return F.expr("array(" + ",".join(f"{v}L" if v > -(1 << 63) else "-9223372036854775807L - 1L" for v in values) + ")")


def _alone_removed(fps: DataFrame) -> DataFrame:
    masks = _sieve_masks()
    m = F.arrays_zip(*[_long_array([x[i] for x in masks]).alias(n) for i, n in enumerate(("keep", "flip", "mark"))])
    met = fps.select("fp", F.explode(m).alias("m")).select(
        "fp", F.col("m.keep").bitwiseAND(F.col("fp")).bitwiseXOR(F.col("m.flip")).bitwiseOR(F.col("m.mark")).alias("value"))
    w = W.partitionBy("value")
    return met.withColumn("lo", F.min("fp").over(w)).withColumn("hi", F.max("fp").over(w)).filter("lo != hi").select("fp").distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """True links ``(u, v)`` whose components equal those of all pairs within three bits.  ``fps``: distinct ``fp``."""
    if radius != 3:
        raise ValueError("the balls are laid out for three bits")
    near = stored(_alone_removed(fps))
    one = [0] + [_signed(1 << b) for b in range(64)]
    two = [_signed(1 << a | 1 << b) for a in range(64) for b in range(a) if a // 32 == b // 32]
    odd = F.bit_count("fp") % 2 == 1
    # every ball is an array of bit masks, built once per plan and exploded
    emitted = near.select("fp", F.lit(True).alias("close"), F.explode(_long_array(one)).alias("flip")).union(
        near.filter(odd).select("fp", F.lit(False).alias("close"), F.explode(_long_array(two)).alias("flip")))
    met = emitted.select("fp", "close", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    hub = F.min(F.when(F.col("close"), F.col("fp"))).over(W.partitionBy("value"))
    return (met.withColumn("hub", hub).filter(F.col("hub") != F.col("fp"))
            .filter(F.bit_count(F.col("hub").bitwiseXOR(F.col("fp"))) <= radius)
            .select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct())


def _classed(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, text_hash, root, component_id`` per row; ``root`` is the component's smallest fingerprint."""
    marked = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints("text").alias("fp")))
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(fps.select("fp")))
    named = fps.join(root.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "root", "component_id")
    return marked.join(of, "fp")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` for every row of ``docs (doc_id, text)``.

    Texts without words (null, empty, only spaces) have fingerprint zero and
    link like any other.  Repeated rows each keep a row.  Null ids are never a
    component's name unless all its ids are null.
    """
    return _classed(docs).select("doc_id", bit_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: that with the smallest id, then the smallest hash of its text.

    A document without id stays only where its whole group has none; of
    repeated rows one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("h"))
    first = _classed(docs).groupBy("root").agg(F.min(key).alias("k")).select("k.no_id", "k.id", "k.h")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().alias("no_id"),
                        F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    kept = named.join(first, ["no_id", "id", "h"]).dropDuplicates(["no_id", "id", "h"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
