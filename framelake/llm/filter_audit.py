"""Filter interaction audit by truth-table survival words.

Five filters give every document five failure bits, and these give a 32-bit
word: bit ``s`` is set if the document survives when exactly the filters of
subset ``s`` are applied.  Adding words bit by bit over all documents of a part
gives the survivors of all 32 subsets, from which every order of application,
every single failure and every Shapley value follows.

The words are added by carry-save adders: three words of one weight become one
word of that weight (their xor) and one of twice the weight (their majority).
A document that stands for ``n`` equal ones enters at the weights of the binary
digits of ``n``, so copies are counted without being listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
FULL = SUBSETS - 1
_COUNTS = T.ArrayType(T.LongType())


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (null: empty); they depend on the text alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text), text.rlike("[#$%&*|]")]
    out = F.lit(0)
    for i, c in enumerate(fails):
        out = out.bitwiseOR(F.when(c, F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def survival_word(mask: int) -> int:
    """Subsets that spare a document with the failures ``mask``, as the bits of a word."""
    return sum(1 << s for s in range(SUBSETS) if not s & mask)


def positional_counts(words: np.ndarray, times: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """How often each bit is set in the words of each group: ``[groups, 32]``; a word counts ``times`` fold."""
    out = np.zeros((groups, 32), np.int64)
    bits = np.arange(32, dtype=np.uint32)
    level, carry_w, carry_g = 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    while len(carry_w) or (times >> level).any():
        entering = (times >> level & 1).astype(bool)
        w, g = np.concatenate([words[entering], carry_w]), np.concatenate([group[entering], carry_g])
        carries: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            order = np.argsort(g, kind="stable")
            w, g = w[order], g[order]
            first = np.searchsorted(g, g, "left")
            place = np.arange(len(g)) - first
            if not len(place) or not place.max():
                break
            # three words of one group side by side; a missing third is zero
            triple = np.cumsum(place % 3 == 0) - 1
            side = np.zeros((triple[-1] + 1, 3), np.uint32)
            side[triple, place % 3] = w
            a, b, c = side.T
            g = g[place % 3 == 0]
            w, carry = a ^ b ^ c, (a & b) | (c & (a ^ b))
            carries.append((carry[carry != 0], g[carry != 0]))
        out[g] += (w[:, None] >> bits & 1).astype(np.int64) << level
        carry_w = np.concatenate([c for c, _ in carries]) if carries else np.zeros(0, np.uint32)
        carry_g = np.concatenate([c for _, c in carries]) if carries else np.zeros(0, np.int64)
        level += 1
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each batch to one row of counts per part and label."""
    for b in batches:
        if not b.num_rows:
            continue
        part = b["part"].dictionary_encode()
        label = b["label"].to_numpy(zero_copy_only=False).astype(np.int64)
        key, group = np.unique(part.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + label, return_inverse=True)
        words = b["word"].to_numpy(zero_copy_only=False).astype(np.uint32)
        counts = positional_counts(words, b["n"].to_numpy(zero_copy_only=False).astype(np.int64), group, len(key))
        yield pa.record_batch({"part": part.dictionary.take(pa.array(key // 4)), "label": pa.array((key % 4).astype(np.int32)),
                               "counts": pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * 32), pa.array(counts.ravel()))})


def words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, label, word, n``: survival words of all documents; equal ones of a text share a row with their number ``n``.

    ``label`` has bit 0 for quality 1 and bit 1 for toxic 1.
    """
    narrow = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"), failures(F.col("text")).alias("mask"))
    # equal rows combine before the shuffle, so a repeated row is never hot; null ids are spread by their text
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("h")).otherwise(F.lit(0))
    rows = narrow.groupBy("doc_id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", salt)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    known = known.withColumn("salt", F.lit(0).cast("long"))
    label = F.coalesce("good", F.lit(0)).bitwiseOR(2 * F.coalesce("toxic", F.lit(0)))
    labelled = rows.join(known, ["doc_id", "salt"], "left").withColumn("label", label)
    # per text, part and label: all rows, the smallest id and the rows that carry it
    texts = labelled.groupBy("h", "part", "mask", "label").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    least = texts.groupBy("h").agg(F.min("first").alias("least"))
    placed = texts.join(least, "h").withColumn("spared", F.col("no_id") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0))
    table = F.array(*[F.lit(survival_word(m)).cast("long") for m in range(SUBSETS)])
    e = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("spared").alias("n")), F.struct(F.col("mask").bitwiseOR(e).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))
    out = placed.select("part", "label", F.explode(both).alias("x")).filter("x.n > 0")
    return out.select("part", F.col("label").cast("int").alias("label"), F.element_at(table, F.col("x.mask") + 1).alias("word"), F.col("x.n").alias("n"))


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` and, as arrays over the 32 subsets, the surviving documents: ``kept``, ``good`` and ``toxic`` ones."""
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("counts", _COUNTS)])
    added = words(docs, labels).mapInArrow(_added, schema)
    cols = []
    for name, having in (("kept", F.lit(True)), ("good", F.col("label").bitwiseAND(1) != 0), ("toxic", F.col("label").bitwiseAND(2) != 0)):
        cols.append(F.array(*[F.sum(F.when(having, F.col("counts")[s]).otherwise(0)) for s in range(SUBSETS)]).alias(name))
    return added.groupBy("part").agg(*cols)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, over ``docs (doc_id, text, source)`` and ``labels (doc_id, quality, toxic)``.

    Null text is empty; null source is the part ``''``.  A row without id is
    never a copy of a smaller id and makes no other row one; repeated ids do
    not fail E against each other.  A document with several label rows has a
    label if one of them says so; null labels say nothing.  An empty table
    gives no rows.  Further columns are ignored.
    """
    def at(name: str, s: Column) -> Column:
        return F.element_at(name, s + 1)

    def subset(letters: Column) -> Column:
        return sum((F.when(F.instr(letters, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))

    n = len(FILTERS)
    shapley = []
    for f in range(n):
        without = [s for s in range(SUBSETS) if not s >> f & 1]
        orders = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in without}
        shapley.append(sum((orders[s] * (F.col("kept")[s] - F.col("kept")[s | 1 << f]) for s in without), F.lit(0)).cast("long"))
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = survivors(docs, labels).select("*", F.array(*shapley).alias("shares"), F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumn("before", subset(F.expr("substring(filter_order, 1, step - 1)"))).withColumn("filter", subset(letter))
    before, one = F.col("before"), F.col("filter")
    after = before.bitwiseOR(one)
    removed = at("kept", before) - at("kept", after)
    return steps.select(
        "part", "filter_order", "step", at("kept", after).alias("kept"), removed.alias("removed"),
        (F.col("kept")[0] - at("kept", one) - removed).alias("redundant"), (at("kept", F.lit(FULL) - one) - F.col("kept")[FULL]).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"), (at("toxic", before) - at("toxic", after)).alias("toxic_lost"),
        F.element_at("shares", F.instr(F.lit(FILTERS), letter)).alias("shapley"))
