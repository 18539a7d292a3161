"""Bit flags that say which samplers picked a point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .ratios import col

# Source bits, priority order of the single source type,
# and the confidence a set bit contributes.
SOURCE_BITS = {"global": 1, "local": 2, "tophat": 4, "context": 8}
SOURCE_TYPES = {"global": 1, "local": 2, "tophat": 3, "context": 4}
SOURCE_CONFIDENCE = {"local": 0.7, "tophat": 0.7, "context": 0.0}
ALL_BITS = 15


def has_source(flags: Column | str, source: str) -> Column:
    return col(flags).bitwiseAND(F.lit(SOURCE_BITS[source])) != 0


def any_source(flags: Column | str) -> Column:
    return col(flags) != 0


def merge_sources(flags: Column | str) -> Column:
    """Aggregate: union of the source bits of rows on one pixel."""
    return F.bit_or(col(flags))


def source_type(flags: Column | str) -> Column:
    """Single type of a flag set: first set bit in priority order, 0 for none."""
    picks = [F.when(has_source(flags, s), F.lit(t)) for s, t in SOURCE_TYPES.items()]
    return F.coalesce(*picks, F.lit(0))


def source_confidence(flags: Column | str, global_confidence: Column | str) -> Column:
    """Largest confidence among the set bits; the global bit brings its own."""
    parts = [F.when(has_source(flags, "global"), col(global_confidence)).otherwise(0.0)]
    parts += [F.when(has_source(flags, s), F.lit(v)).otherwise(0.0) for s, v in SOURCE_CONFIDENCE.items()]
    return F.greatest(*parts)


def without_source(flags: Column | str, source: str) -> Column:
    """Ablation: the flag set with one bit cleared."""
    return col(flags).bitwiseAND(F.lit(0xFFFF & ~SOURCE_BITS[source]))


def source_overlap(flags: Column | str) -> Column:
    return F.bit_count(col(flags)) > 1


def context_only(flags: Column | str) -> Column:
    return col(flags) == SOURCE_BITS["context"]


def source_names(flags: Column | str) -> Column:
    """Array of the set source names, for exploding."""
    names = [F.when(has_source(flags, s), F.lit(s)) for s in SOURCE_BITS]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def undefined_bits(flags: Column | str) -> Column:
    return col(flags).bitwiseAND(F.lit(~ALL_BITS)) != 0


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
