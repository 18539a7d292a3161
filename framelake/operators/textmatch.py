"""Which texts contain which of many names: an inverted index of rarest q-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framelake.session import scratch_path

# Lengths of the grams; a name uses the longest that fits into it.
GRAMS = (8, 4, 2, 1)


def grams(text: Column, q: int) -> Column:
    """All different runs of ``q`` characters, read off in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def _hashed(df: DataFrame, q: int, text: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(grams(F.col(text), q)).alias("_gram")).select(*keep, F.xxhash64(F.lit(q), "_gram").alias("_hash"))


def register(names: DataFrame, name: str) -> DataFrame:
    """``name, _q, _hash``: each name under one of its grams, that which the fewest names hold.

    A hash that two grams share only adds candidates.
    """
    q = reduce(lambda c, n: c.when(F.length(name) >= n, n), GRAMS[1:], F.when(F.length(name) >= GRAMS[0], GRAMS[0]))
    sized = names.withColumn("_q", q)
    held = reduce(DataFrame.unionByName, [_hashed(sized.filter(F.col("_q") == n), n, name, name, "_q") for n in GRAMS])
    common = held.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    rarest = held.join(common, "_hash").groupBy(name, "_q").agg(F.min(F.struct("_n", "_hash")).alias("_r"))
    return rarest.select(name, "_q", F.col("_r._hash").alias("_hash"))


def contains_join(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs (key, needle) where the text contains the needle; no text is compared with every needle.

    A text that contains a name contains the gram the name is registered
    under.  Texts send their different grams, equal hashes meet, and what met
    is verified on the whole text.  Names without characters, null names and
    null texts match nothing; a null key is a key like any other.
    """
    names = needles.select(F.col(needle).alias("_needle")).filter(F.length("_needle") > 0).distinct()
    at = scratch_path(texts.sparkSession, "names")
    register(names, "_needle").write.parquet(at)
    index = texts.sparkSession.read.parquet(at)  # its size is known, so a small index is sent to the texts
    used = [r["_q"] for r in index.select("_q").distinct().collect()]  # at most one row per gram length
    narrow = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if not used:
        return narrow.select(F.col("_key").alias(key), F.col("_text").alias(needle)).limit(0)
    sent = reduce(DataFrame.unionByName, [_hashed(narrow, q, "_text", "_key") for q in used])
    maybe = sent.join(index.select("_needle", "_hash"), "_hash").select(F.col("_key").alias("_met"), "_needle").distinct()
    sure = maybe.join(narrow, F.col("_met").eqNullSafe(F.col("_key"))).filter(F.contains("_text", "_needle"))
    return sure.select(F.col("_key").alias(key), F.col("_needle").alias(needle)).distinct()
