"""Names, ids and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .ratios import col

# Fixed value: shape of a recording id inside names and texts.
RECORDING_ID = r"\d{8}_\d{6}_\d+"


def basename(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def blank_to_null(c: Column | str) -> Column:
    t = F.trim(col(c))
    return F.when(t != "", t)


def video_name(attribute: Column | str, path: Column | str, suffix: str = "") -> Column:
    """A recorded name, else a recording id in the path, else the file stem."""
    found = F.regexp_extract(stem(path), RECORDING_ID, 0)
    base = stem(path)
    if suffix:
        base = F.when(base.endswith(suffix), F.substring(base, F.lit(1), F.length(base) - len(suffix))).otherwise(base)
    return F.coalesce(blank_to_null(attribute), F.when(found != "", found), base)


def safe_name(c: Column | str) -> Column:
    """Only letters, digits, dot, dash and underscore; other runs become one underscore.

    The pattern is a fixed value.
    """
    return F.btrim(F.regexp_replace(col(c), r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))


def resolve(path: Column | str, base: str) -> Column:
    """Absolute paths stay, others are taken relative to ``base``."""
    p = col(path)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))


def config_id(fields: Sequence[str]) -> Column:
    """``cfg_`` and twelve hex digits of the hash over the fields in name order."""
    return F.concat(F.lit("cfg_"), F.substring(fingerprint(fields), 1, 12))


def fingerprint(fields: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def hash_order(seed: str, name: Column | str) -> Column:
    """Sort key that shuffles repeatably: hash over seed and name."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), col(name).cast("string")), 256)


def hash_number(key: Column, bits: int = 52) -> Column:
    """A whole number from the leading hex digits of a hash key."""
    return F.conv(F.substring(key, 1, bits // 4), 16, 10).cast("bigint")
