"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are projected, shifted and keyed along several Hilbert curves; Spark
range-partitions the keys, which numbers every row along every curve.  A query
looks at the rows whose numbers lie near its own on any curve, and what the
curves find is merged and ranked by the inner product of the original vectors.

How near is near is measured, not guessed: for a bounded sample of queries the
true neighbours are found by brute force, and the window is the distance along
the best curve that covers the wanted share of them.  Where vectors have
structure the window is narrow; where they have none it grows with the table,
and so does the work.

Largest inner product becomes nearest neighbour by one more coordinate that
lengthens every vector to the longest one's length; a query gets zero there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ranked, stored

CURVES, DIMS, BITS = 8, 8, 6
SAMPLE = 4096       # vectors that fit the projections
PROBES = 256        # queries that measure the window
COVERED = 0.95      # share of true neighbours the window must cover
BLOCK = (1024, 65_536)  # least and greatest rows per block


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each integer cell (n, d) on the Hilbert curve, d * bits bits.

    Skilling's transform: undo the rotations from the highest bit down, then
    Gray-decode across the coordinates; the bits interleave to the key.
    """
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    for s in range(bits - 1, 0, -1):
        q, low = 1 << s, (1 << s) - 1
        for i in range(d):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    for s in range(bits - 1, 0, -1):
        t ^= np.where(x[:, d - 1] & 1 << s, (1 << s) - 1, 0)
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for s in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | x[:, i] >> s & 1
    return key


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: distinct rows with an id and a finite, non-zero vector of the most frequent length."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(~bad & F.exists("v", lambda x: x != 0)).distinct()
    rows = stored(rows)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (size[0]["n"] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Curves:
    """Projections, fitted on a bounded sample of the vectors."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.longest, self.bits = longest, bits
        lifted = self.lifted(sample, False)
        d = lifted.shape[1]
        self.mean, self.turn, self.scale, self.shift = lifted.mean(0), [], [], []
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :dims]
            self.turn.append(turn)
            spread = ((lifted - self.mean) @ turn).std(0)
            self.scale.append(np.where(spread > 0, spread, 1))
            self.shift.append(rng.uniform(-0.15, 0.15, turn.shape[1]))

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1))
        if query:
            return np.hstack([x * (self.longest / np.maximum(norm, 1e-300))[:, None], np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(self.longest ** 2 - norm ** 2, 0))[:, None]])

    def keys(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        y, top = self.lifted(x, query) - self.mean, (1 << self.bits) - 1
        return [hilbert_keys(np.clip((y @ t / (6 * s) + 0.5 + h) * (top + 1), 0, top).astype(np.int64), self.bits)
                for t, s, h in zip(self.turn, self.scale, self.shift)]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed coordinate by coordinate so that equal vectors score equal anywhere."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def nearest(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the ``k`` best candidates per query, its own id left out.

    Matrix products choose generously, the exact scores decide; ties go to the
    smaller id.
    """
    out = []
    slack = 1e-9 * (np.abs(q).sum(1).max(initial=0) * np.abs(c).max(initial=0) + 1e-300)
    for lo in range(0, len(q), 256):
        s = q[lo:lo + 256] @ c.T
        s[q_ids[lo:lo + 256, None] == c_ids[None]] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        rows, cols = np.nonzero((s >= (least - slack)[:, None]) & np.isfinite(s))
        exact = inner(q[lo + rows], c[cols])
        order = np.lexsort((c_ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < k
        out.append((lo + rows[keep], cols[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_FOUND = "query_id bigint, vec_id bigint, score double"


def brute_force(rows: DataFrame, probes: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """True neighbours of a bounded list of queries; every task keeps its best ``k`` per query."""
    q, ids = np.array([p[1] for p in probes]), np.array([p[0] for p in probes], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_v, kept_id = np.zeros((0, q.shape[1])), np.zeros(0, np.int64)
        best: tuple[np.ndarray, ...] = ()
        for b in batches:
            c, c_id = matrix(b["v"]), b["vec_id"].to_numpy(zero_copy_only=False)
            c, c_id = np.vstack([kept_v, c]), np.concatenate([kept_id, c_id])
            r, i, s = nearest(q, ids, c, c_id, k)
            used, at = np.unique(i, return_inverse=True)
            kept_v, kept_id, best = c[used], c_id[used], (r, at, s)
        if best:
            r, at, s = best
            yield pa.record_batch({"query_id": pa.array(ids[r]), "vec_id": pa.array(kept_id[at]), "score": pa.array(s)})

    return _top(rows.mapInArrow(run, _FOUND), k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, curves: int = CURVES, covered: float = COVERED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query row, by largest inner product.

    ``vectors (vec_id, embedding)``.  Rows without id, with a null, zero or
    non-finite vector, or of another length than most take no part.  Repeated
    rows count once; an id with several vectors counts with its best score.
    """
    rows = usable(vectors.select("vec_id", "embedding"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    asked = rows.filter(is_query)
    probes = [(r["vec_id"], r["v"]) for r in asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(PROBES).collect()]
    if not probes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fit = Curves(np.array([r["v"] for r in sample]), rows.agg(F.max(norm)).first()[0], curves)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = b["asked"].to_numpy(zero_copy_only=False)
            v = matrix(b["v"])
            for query, take in ((False, np.arange(len(q))), (True, np.flatnonzero(q))):
                for m, key in enumerate(fit.keys(v[take], query) if len(take) else []):
                    part = b.take(pa.array(take))
                    yield pa.record_batch({"curve": pa.array(np.full(len(take), m, np.int32)), "key": pa.array(key), "query": pa.array(np.full(len(take), query)),
                                           "vec_id": part["vec_id"], "v": part["v"]})

    entries = rows.select("vec_id", "v", is_query.alias("asked")).mapInArrow(keyed, "curve int, key bigint, query boolean, vec_id bigint, v array<double>")
    entries = stored(entries.withColumn("tie", F.xxhash64("vec_id")))
    total = entries.filter("curve = 0").count()
    placed = stored(ranked(entries, ["curve", "key", "tie", "vec_id", "query"]).withColumn("place", F.col("position") - F.col("curve") * total)
                    .select("curve", "place", "query", "vec_id", "v"))

    # the window: how far true neighbours lie from the probes on their best curve
    true = stored(brute_force(rows, probes, k).select("query_id", "vec_id"))
    here = placed.filter("query").select("curve", F.col("vec_id").alias("query_id"), F.col("place").alias("from"))
    there = placed.filter("NOT query").select("curve", "vec_id", "place")
    far = true.join(here, "query_id").join(there, ["curve", "vec_id"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("d"))
    measured = [r["d"] for r in far.collect()]
    window = int(np.quantile(measured, covered)) + 1 if measured else total
    block = min(max(window, BLOCK[0]), BLOCK[1])

    blocks = F.sequence(F.floor(F.greatest(F.lit(0), F.col("place") - window) / block), F.floor(F.least(F.lit(total - 1), F.col("place") + window) / block))
    met = placed.withColumn("block", F.explode(F.when(F.col("query"), blocks).otherwise(F.array(F.floor(F.col("place") / block)))))
    # the queries of a block are dealt to groups of about block size; its candidates go to each of them
    sizes = met.groupBy("curve", "block").agg(F.greatest(F.lit(1), F.ceil(F.count_if("query") / block)).cast("int").alias("chunks"))
    met = met.join(sizes, ["curve", "block"])
    chunk = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("vec_id", "place"), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = met.withColumn("chunk", F.explode(chunk))

    def meet(t: pa.Table) -> pa.Table:
        q = t["query"].combine_chunks().to_numpy(zero_copy_only=False)
        ids, v = t["vec_id"].combine_chunks().to_numpy(zero_copy_only=False), matrix(t["v"].combine_chunks())
        r, c, s = nearest(v[q], ids[q], v[~q], ids[~q], k)
        return pa.table({"query_id": pa.array(ids[q][r]), "vec_id": pa.array(ids[~q][c]), "score": pa.array(s)})

    found = met.groupBy("curve", "block", "chunk").applyInArrow(meet, _FOUND)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
