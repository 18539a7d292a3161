"""WARC records and Merkle fixity audit of replicas.

Every page becomes one WARC record; records are ordered by page id within an
archive file (a range of ids) and lie at consecutive offsets.  A tree is built
over the ids: leaves are ids, a node covers ``FANOUT`` consecutive nodes of
the level below, and its hash is taken over their numbers and hashes in order,
so replicas agree at a node exactly if they agree in all records below it.
Nodes carry the offset range they cover.  Replicas are compared from the root
down, and only branches that differ are followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .common import stored

FANOUT = 64
FILE = FANOUT ** 2  # ids per archive file


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The record as text: a WARC/1.1 resource record; null url or html is empty."""
    body = F.coalesce(html, F.lit(""))
    crlf = F.lit("\r\n")
    head = [F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
            F.concat(F.lit("WARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">")), F.lit("Content-Type: text/html"),
            F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *head), crlf, crlf, body, crlf, crlf)


def records(pages: DataFrame) -> DataFrame:
    """``file, page_id, copies, record_sha256, length, offset`` of the distinct records of an archive.

    Rows without id cannot be filed and are left out.  Equal records of one id
    lie next to each other and count as ``copies``; different ones of one id
    follow by their hash.  Offsets run through a file of ``FILE`` ids.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.filter("page_id IS NOT NULL").select(F.floor(F.col("page_id") / FILE).cast("bigint").alias("file"), "page_id", F.sha2(text, 256).alias("record_sha256"), F.octet_length(text).cast("bigint").alias("length"))
    distinct = hashed.groupBy("file", "page_id", "record_sha256", "length").agg(F.count(F.lit(1)).alias("copies"))
    before = W.partitionBy("file").orderBy("page_id", "record_sha256").rowsBetween(W.unboundedPreceding, -1)
    return distinct.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)))


def leaves(recs: DataFrame) -> DataFrame:
    """Level 0, ``node, hash, first_file, start, last_file, end``: one leaf per id, over its records in hash order."""
    item = F.struct("record_sha256", F.col("copies").alias("c"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda r: F.concat_ws(":", r["record_sha256"], r["c"].cast("string"))), ",")
    return recs.groupBy(F.col("page_id").alias("node")).agg(
        F.sha2(line, 256).alias("hash"), F.min(F.struct("file", "offset")).alias("start"), F.max(F.struct("file", (F.col("offset") + F.col("length") * F.col("copies")).alias("offset"))).alias("end"))


def parents(level: DataFrame) -> DataFrame:
    """One level up: at most ``FANOUT`` children per node, hashed in order."""
    child = F.struct("node", "hash")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), ",")
    return level.groupBy(F.floor(F.col("node") / FANOUT).cast("bigint").alias("node")).agg(F.sha2(line, 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end"))


def tree(recs: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the top; every level is a written table.  The top has one node, or one each side of zero."""
    levels = [stored(leaves(recs))]
    while levels[-1].limit(3).count() > 2 or (len(levels) < 12 and not levels[-1].filter("node NOT IN (0, -1)").isEmpty()):
        levels.append(stored(parents(levels[-1])))
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``node`` of every node that one side lacks or hashes differently."""
    left, right = a.select("node", F.col("hash").alias("ha")), b.select("node", F.col("hash").alias("hb"))
    return left.join(right, "node", "full").filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("node")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that differ between two replicas ``(page_id, url, html)``, with where they lie.

    ``fault``: ``altered`` (the id's records differ), ``missing`` (from the
    second replica) or ``extra`` (only there).  Intact branches are not read
    below their top.
    """
    ra, rb = stored(records(a)), stored(records(b))
    ta, tb = tree(ra), tree(rb)
    height = max(len(ta), len(tb))
    for t in (ta, tb):
        while len(t) < height:
            t.append(stored(parents(t[-1])))
    suspect = None
    for level_a, level_b in zip(reversed(ta), reversed(tb)):
        if suspect is not None:
            level_a, level_b = (x.withColumn("up", F.floor(F.col("node") / FANOUT).cast("bigint")).join(suspect.withColumnRenamed("node", "up"), "up", "left_semi") for x in (level_a, level_b))
        suspect = stored(differing(level_a, level_b))
    at_a = suspect.join(ta[0], "node").select(F.col("node").alias("page_id"), F.col("start").alias("sa"), F.col("end").alias("ea"), F.col("hash").alias("hash_a"))
    at_b = suspect.join(tb[0], "node").select(F.col("node").alias("page_id"), F.col("start").alias("sb"), F.col("end").alias("eb"), F.col("hash").alias("hash_b"))
    fault = F.when(F.col("sb").isNull(), F.lit("missing")).when(F.col("sa").isNull(), F.lit("extra")).otherwise(F.lit("altered"))
    return at_a.join(at_b, "page_id", "full").select(
        "page_id", fault.alias("fault"), F.coalesce("sa.file", "sb.file").alias("file"), F.col("sa.offset").alias("start_a"), F.col("ea.offset").alias("end_a"),
        F.col("sb.offset").alias("start_b"), F.col("eb.offset").alias("end_b"), "hash_a", "hash_b")
