"""Resharding by minimum-cost flow.

Old shards supply their bytes, new shards demand equal shares, and a byte
costs nothing where it stays and one where it moves.  The flow of least cost
is solved on the shards alone; their number does not grow with the corpus.
Each arc takes one contiguous stretch of an old shard's rows, largest size
classes first, so that a stretch ends among small rows and shares come out
nearly equal.  Only shards that lose or gain rows are written anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ranked, stored

Arc = tuple[int, int, int]  # old shard, new shard, bytes


def flow(supply: dict[int, int], demand: dict[int, int]) -> list[Arc]:
    """Transfers of least cost that empty every supply into the demands, by successive cheapest paths.

    Staying (equal numbers) is free, moving costs one per byte.  The residual
    network has old and new shards as nodes; each round sends the most that
    fits along a cheapest path found by relaxation.
    """
    if sum(supply.values()) != sum(demand.values()):
        raise ValueError("supply and demand differ")
    sent: dict[tuple[int, int], int] = {}
    left, need = dict(supply), dict(demand)
    while any(left.values()):
        cost = {("s", i): 0 for i in left if left[i]}
        via: dict[tuple[str, int], tuple[str, int]] = {}
        changed = True
        while changed:
            changed = False
            for i in supply:
                for j in demand:
                    c = int(i != j)
                    for a, b, w in ((("s", i), ("d", j), c), (("d", j), ("s", i), -c)):
                        if a in cost and (a[0] == "s" or sent.get((i, j))) and cost[a] + w < cost.get(b, 1 << 60):
                            cost[b], via[b], changed = cost[a] + w, a, True
        end = min((n for n in cost if n[0] == "d" and need[n[1]]), key=lambda n: (cost[n], n))
        path = [end]
        while path[-1] in via:
            path.append(via[path[-1]])
        path.reverse()
        back = [sent[(b[1], a[1])] for a, b in zip(path, path[1:]) if a[0] == "d"]
        amount = min([left[path[0][1]], need[end[1]], *back])
        for a, b in zip(path, path[1:]):
            arc = (a[1], b[1]) if a[0] == "s" else (b[1], a[1])
            sent[arc] = sent.get(arc, 0) + (amount if a[0] == "s" else -amount)
        left[path[0][1]] -= amount
        need[end[1]] -= amount
    return sorted((i, j, n) for (i, j), n in sent.items() if n)


def even(total: int, shards: int) -> dict[int, int]:
    """Shares of ``total`` that differ by at most one."""
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def shares(total: int, capacities: dict[int, int]) -> dict[int, int]:
    """Shares of ``total`` in proportion to the capacities, whole, the earlier ones rounded first."""
    whole, sofar, given, out = sum(capacities.values()), 0, 0, {}
    if whole <= 0 or min(capacities.values()) < 0:
        raise ValueError("capacities must not be negative and not all zero")
    for j in sorted(capacities):
        sofar += capacities[j]
        out[j] = total * sofar // whole - given
        given += out[j]
    return out


def from_files(docs: DataFrame) -> DataFrame:
    """Add ``_row``, the file and line of a row, to a table that is read from Parquet files as it stands."""
    return docs.withColumn("_row", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line")))


def _numbered(df: DataFrame) -> DataFrame:
    """``_row`` for any table; it holds only for what is stored from this frame."""
    return df if "_row" in df.columns else df.withColumn("_row", F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("line")))


def reshard(docs: DataFrame, old_shard: Column, shards: int | dict[int, int]) -> tuple[DataFrame, list[Arc]]:
    """``doc_id, size, text_crc32, old_shard, shard, slot, _row`` and the transfers.

    ``shards``: how many of equal bytes, or the capacity of each.  A row weighs
    its text's UTF-8 bytes plus one; null texts weigh one.  Repeated rows are
    rows of their own, told apart by ``_row``, which is kept if given.
    """
    text = F.coalesce("text", F.lit(""))
    sized = stored(_numbered(docs).select(
        "doc_id", "_row", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
        .withColumn("_small", -F.floor(F.log2("size"))).withColumn("_tie", F.xxhash64("doc_id", "text_crc32")))
    supply = {r["old_shard"]: r["n"] for r in sized.groupBy("old_shard").agg(F.sum("size").alias("n")).collect()}
    total = sum(supply.values())
    arcs = flow(supply, even(total, shards) if isinstance(shards, int) else shares(total, shards))
    # stretches in the order of the rows: old shard by old shard, what stays first
    ends, total = [], 0
    for i, j, n in sorted(arcs, key=lambda a: (a[0], a[0] != a[1], a[1])):
        total += n
        ends.append((total, j))
    rows = ranked(sized, ["old_shard", "_small", "_tie", "doc_id", "size", "_row"], "size")
    middle = F.col("before") + F.col("size") / 2
    at = F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e, _ in ends]), lambda e: e <= middle)) if ends else F.lit(0)
    to = F.get(F.array(*[F.lit(j) for _, j in ends]), F.col("stretch")) if ends else F.lit(0)
    rows = rows.withColumn("stretch", at).withColumn("shard", to.cast("int"))
    # a stretch is contiguous in the order, so places in a shard follow from where its stretches begin
    seen: dict[int, int] = {}
    slot0 = {}
    for r in sorted(rows.groupBy("stretch", "shard").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["stretch"]):
        slot0[r["stretch"]] = seen.get(r["shard"], 0) - r["first"]
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    shift = F.get(F.array(*[F.lit(slot0.get(k, 0)).cast("bigint") for k in range(len(ends))]), F.col("stretch")) if ends else F.lit(0)
    return rows.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("position") + shift).cast("bigint").alias("slot"), "_row"), arcs


def affected(arcs: list[Arc]) -> list[int]:
    """Shards that lose or gain bytes."""
    return sorted({s for i, j, _ in arcs if i != j for s in (i, j)})


def rewrite(docs: DataFrame, placed: DataFrame, arcs: list[Arc], path: str) -> None:
    """Write the documents of every affected new shard below ``path``, one folder per shard, with their ``slot``.

    Every row goes to its own place.  Rows find it by ``_row`` where ``docs``
    has it; else documents and places are both numbered by id, checksum and
    row, and equal numbers belong together (equal rows are interchangeable).
    The caller's columns keep their names; a column of theirs that is called
    ``slot`` or ``shard`` becomes ``doc_slot`` or ``doc_shard``.
    """
    mine = [c for c in docs.columns if c != "_row"]
    kept = F.struct(*[F.col(f"`{c}`").alias(f"doc_{c}" if c in ("slot", "shard") else c) for c in mine]).alias("doc")
    if "_row" in docs.columns:
        rows = docs.select("_row", kept)
    else:
        crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
        rows = stored(docs.select(kept, F.col("doc_id").alias("id"), crc.alias("crc"), F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("line")).alias("_row")))
        order = ranked(rows.select("id", "crc", "_row"), ["id", "crc", "_row"]).select("position", "_row")
        theirs = ranked(stored(placed), ["doc_id", "text_crc32", "_row"]).select("position", "shard", "slot")
        placed = order.join(theirs, "position")
    where = placed.filter(F.col("shard").isin(affected(arcs)) if arcs else F.lit(False)).select("_row", "shard", "slot")
    rows.select("_row", "doc").join(where, "_row").select("doc.*", "slot", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def resharded(docs: DataFrame, old_shard: Column, shards: int | dict[int, int], path: str) -> DataFrame:
    """Place the rows, write the affected shards below ``path`` and return ``doc_id, size, text_crc32, shard, slot``.

    Rows of affected shards are those of the files; all others stay where they are.
    """
    placed, arcs = reshard(docs, old_shard, shards)
    placed = stored(placed)
    rewrite(docs, placed, arcs, path)
    hit = affected(arcs)
    stay = placed.filter(~F.col("shard").isin(hit)).select("doc_id", "size", "text_crc32", "shard", "slot")
    if not hit:
        return stay
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text"], T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    text = F.coalesce("text", F.lit(""))
    back = docs.sparkSession.read.schema(schema).parquet(path).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), "shard", "slot")
    return back.unionByName(stay)
