"""Document fingerprints: SimHash in DataFrame expressions, and search by permuted block tables.

The terms of a text are its pairs of neighbouring words; a term votes as often
as it occurs.  Votes on 64 bits are counted sixteen bits apart in sixteen
ordinary sums (bit ``i + 16 j`` is lane ``j`` of sum ``i``), on stretches of a
text short enough that no lane overflows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import bit_hex, stored

HEAD, EACH = 64, 64  # code points of a text that order equal ids, sampled rows per part of the order
STRETCH = 1 << 14  # terms counted in one lane
LANES = 0x0001000100010001
HALVES = 0x0000FFFF0000FFFF
RADIUS, BLOCKS = 3, 6


def next_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text`` with the row's place ``(part, n)`` and the next row's.

    The next document follows in ascending doc_id; null ids come first, equal
    ids are ordered by the head of the text, then its hash, then row by row.
    After the last comes the first, a single document follows itself.  The
    order is cut into about equal parts at places taken from a sample of fixed
    size per part, so sparse ids, null ids and repeated rows all spread.  The
    first row of a part is copied to the part before it; of the corpus only
    one key per part is looked at as a whole.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.substring(text, 1, HEAD).alias("head"),
                   F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    keyed = docs.select("doc_id", text.alias("text"), key.alias("key"))
    sample = sorted(r["key"] for r in keyed.select("key").orderBy(F.xxhash64("key")).limit(EACH * parts).collect())
    cuts = sorted({tuple(sample[i * len(sample) // parts]) for i in range(1, parts)}) if sample else []
    kind = "array<struct<has:boolean,id:bigint,head:string,h:bigint,row:bigint>>"
    bounds = F.array(*[F.struct(*map(F.lit, c)) for c in cuts]).cast(kind)
    rows = keyed.withColumn("part", F.size(F.filter(bounds, lambda b: b <= F.col("key"))))
    order = W.orderBy("part")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = stored(rows.groupBy("part").agg(F.min("key").alias("first"))).withColumn("next_part", F.coalesce(F.lead("part").over(order), F.first("part").over(whole)))
    ends = F.broadcast(ends.withColumn("prior_part", F.coalesce(F.lag("part").over(order), F.last("part").over(whole))))  # one row per part
    both = rows.join(ends, "part").withColumn("copy", F.explode(F.when(F.col("key") == F.col("first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    both = both.select("doc_id", "text", "copy", "key", "next_part", F.when(F.col("copy"), F.col("prior_part")).otherwise(F.col("part")).alias("window"))
    w = W.partitionBy("window").orderBy("copy", "key")
    return (both.withColumn("n", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))
            .withColumn("next_copy", F.lead("copy").over(w)).filter(~F.col("copy"))
            .withColumn("next_n", F.when(F.col("next_copy"), F.lit(1)).otherwise(F.col("n") + 1))
            .withColumn("next_part", F.when(F.col("next_copy"), F.col("next_part")).otherwise(F.col("window")))
            .select("doc_id", "text", "next_text", F.col("window").alias("part"), "n", "next_part", "next_n"))


def terms(text: Column) -> Column:
    """Pairs of neighbouring words; a text of one word votes as a whole."""
    words = F.split(text, r"\s+")
    return F.when(F.size(words) < 2, F.array(F.struct(text.alias("a"), F.lit("").alias("b")))).otherwise(
        F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b")), 1, F.size(words) - 1))


def simhash(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, fp``: the 64 majority votes over the terms of ``text``; ties vote 0.  ``keys`` name a row."""
    exploded = texts.select(*keys, F.posexplode(terms(F.col(text))).alias("at", "t"))
    hashed = exploded.select(*keys, F.floor(F.col("at") / STRETCH).cast("int").alias("stretch"), F.xxhash64("t.a", "t.b").alias("h"))
    short = hashed.groupBy(*keys, "stretch").agg(
        F.count(F.lit(1)).alias("terms"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES))).alias(f"s{i}") for i in range(16)])
    wide = {f"s{i}_{o}": F.sum((F.shiftrightunsigned(f"s{i}", 16 * o)).bitwiseAND(F.lit(HALVES))) for i in range(16) for o in (0, 1)}
    votes = short.groupBy(*keys).agg(F.sum("terms").alias("terms"), *[c.alias(k) for k, c in wide.items()])
    bits = []
    for b in range(64):
        lane, i = divmod(b, 16)
        count = F.shiftrightunsigned(f"s{i}_{lane % 2}", 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        bits.append(F.when(count * 2 > F.col("terms"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(F.lit(0)))
    parts = [sum(bits[i + 1:i + 16], bits[i]) for i in range(0, 64, 16)]
    return votes.select(*keys, sum(parts[1:], parts[0]).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the angle that the differing bits stand for, none below 0: 1 for equal fingerprints, about 0 for unrelated ones."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(3.141592653589793 / 64)))


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """One mask per table: the blocks that must agree.  Some ``blocks - radius`` blocks hold no differing bit."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(one, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fp, near_fp, n``: all index fingerprints within ``radius`` bits of each query fingerprint.

    ``queries (fp)`` and ``index (fp, n)`` hold distinct fingerprints.  Each
    table keys a fingerprint by some of its blocks; a pair within the radius
    agrees in at least one table, and counts only in the first such, so pairs
    need no deduplication.
    """
    masks = block_masks(radius, blocks)
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("bigint").alias("m")) for k, m in enumerate(masks)]))

    def keyed(df: DataFrame, fp: str, *more: str) -> DataFrame:
        return df.select(F.col("fp").alias(fp), *more, tables.alias("t")).select(fp, *more, "t.k", F.col(fp).bitwiseAND(F.col("t.m")).alias("key"))

    met = keyed(queries, "fp").join(keyed(index, "near_fp", "n"), ["k", "key"])
    diff = F.col("fp").bitwiseXOR(F.col("near_fp"))
    first = F.lit(None)
    for k in reversed(range(len(masks))):
        first = F.when(diff.bitwiseAND(F.lit(masks[k]).cast("bigint")) == 0, F.lit(k)).otherwise(first)
    return met.filter(F.bit_count(diff) <= radius).filter(F.col("k") == first).select("fp", "near_fp", "n")


def fingerprinted(docs: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with likenesses.

    Edited: the last quarter of the code points gives way to the first as many
    (or all) of the next text.  ``n_within``: for ids divisible by ``every``
    how many other rows have a fingerprint within ``radius`` bits; else null.
    """
    pairs = next_texts(docs)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = pairs.select("part", "n", "doc_id", "next_part", "next_n", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited"), 256)))
    both = rows.withColumn("v", F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("t")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("t")))))
    keys = ["part", "n", "doc_id", "next_part", "next_n", "n_chars", "sha"]
    votes = simhash(both.select(*keys, "v.is_edited", "v.t"), [*keys, "is_edited"], "t")
    of = stored(votes.groupBy(*keys).agg(*[F.max(F.when(F.col("is_edited") == e, F.col("fp"))).alias(c) for c, e in (("fp", False), ("edited_fp", True))]))
    after = of.select(F.col("part").alias("next_part"), F.col("n").alias("next_n"), F.col("fp").alias("next_fp"))
    index = of.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    asked = F.col("doc_id") % every == 0
    found = within(of.filter(asked).select("fp").distinct(), index, radius).groupBy("fp").agg((F.sum("n") - 1).alias("n_within"))
    return (of.join(after, ["next_part", "next_n"]).join(found, "fp", "left")
            .select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), bit_hex(F.col("fp")).alias("fingerprint"),
                    bit_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.when(asked, F.col("n_within")).alias("n_within")))
