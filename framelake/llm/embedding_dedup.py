"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, one vector of each group kept.

Equal vectors of a label are one class with a number of copies, so a hot vector
is compared once.  Classes go to the cell of their nearest centroid.  Two
vectors at an angle of at most ``t`` may lie in different cells; one of them is
then a guest in the other's cell.  A vector ``y`` of cell ``j`` can have such a
partner in cell ``i`` only if

* its angle to the plane halfway between both centroids is at most ``t``, and
* its angle to the centroid of ``i`` is at most ``t`` more than that of the
  farthest vector at home in ``i``,

so sending guests wherever both hold loses no link, whatever the centroids
are.  Which of two cells receives the other's guests is fixed by their numbers.

A cell of a label is cut into blocks by hash; each pair of blocks is one group
of bounded size, multiplied strip by strip.  It returns, per class, the number
of vectors it links to and the smallest class of its local component, never
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ranked, stored
from .components import components

THRESHOLD = 0.98
# The centroids, at most MOST of them, are fitted on at most SAMPLE distinct vectors; every vector is assigned and compared.
SAMPLE, MOST, ROUNDS = 4096, 1024, 8
# Classes of a block, rows of a strip, products that cost as much as sending one vector.
BLOCK, STRIP, SENDING = 2048, 256, 4000
_SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and all components one after the other as doubles."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so that no square overflows."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors, at most ``k``."""
    rng = np.random.default_rng(7)
    centroids = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        home = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        size = np.sqrt((sums * sums).sum(1))
        centroids = np.where(size[:, None] > _SLACK, sums / np.maximum(size, _SLACK)[:, None], centroids)
    return centroids


class Cells:
    """Centroids, the angle each cell reaches, and where a vector is at home or a guest."""

    def __init__(self, centroids: np.ndarray, threshold: float):
        self.centroids, self.angle = centroids, float(np.arccos(threshold))
        self.reach = np.full(len(centroids), np.pi)
        apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
        self.margin = apart * np.sin(self.angle) + _SLACK
        i, j = np.indices(apart.shape)
        # receives[i, j]: the vectors of cell j are guests in cell i
        self.receives = (i != j) & ((i < j) == ((i + j) % 2 == 0))

    def products(self, x: np.ndarray) -> np.ndarray:
        d = min(x.shape[1], self.centroids.shape[1])  # further components count as zero
        return x[:, :d] @ self.centroids[:, :d].T

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and angle to its centroid."""
        p = self.products(x)
        cell = p.argmax(1)
        return cell, np.arccos(np.clip(p[np.arange(len(p)), cell], -1, 1))

    def guests(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits."""
        p = self.products(x)
        own = p[np.arange(len(p)), home]
        near = own[:, None] - p <= self.margin[home]
        far = np.arccos(np.clip(p, -1, 1)) <= self.reach + self.angle + _SLACK
        return np.nonzero(near & far & self.receives.T[home])


def chosen(sample: np.ndarray, labels: np.ndarray, n: int, threshold: float) -> Cells:
    """The number of cells (a power of four) with the least estimated work for ``n`` vectors like the sample.

    Centroids come from one half of the sample, the estimate from the other.
    """
    best, least, k = None, np.inf, 4
    train, sample, labels = (sample[::2], sample[1::2], labels[1::2]) if len(sample) > 1 else (sample, sample, labels)
    while k <= MOST:
        cells = Cells(fit(train, k), threshold)
        home, angle = cells.home(sample)
        np.maximum.at(cells.reach, home, 0)
        cells.reach = np.array([angle[home == c].max(initial=0) for c in range(len(cells.centroids))])
        row, cell = cells.guests(sample, home)
        here, visits = np.zeros((labels.max() + 1, k)), np.zeros((labels.max() + 1, k))
        np.add.at(here, (labels, home), 1)
        np.add.at(visits, (labels[row], cell), 1)
        scale = n / len(sample)
        work = scale * scale * (here * (here / 2 + visits)).sum() + n * k + scale * (len(sample) + len(row)) * SENDING
        if work < least:
            best, least = cells, work
        k *= 4
    best.reach[:] = np.pi
    return best


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of each length in a batch."""
    length, flat = _rows(vectors)
    start = np.cumsum(length) - length
    for d in np.unique(length):
        i = np.flatnonzero(length == d)
        yield i, unit(flat[start[i][:, None] + np.arange(d)])


def _homes(cells: Cells):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for i, x in _by_length(b["embedding"]):
                cell[i], angle[i] = cells.home(x)
            yield pa.record_batch({"node": b["node"], "cell": pa.array(cell), "angle": pa.array(angle)})

    return assign


def _placed(cells: Cells):
    """Each class at home and as a guest: lists of cells, home first."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, rows, visits = np.zeros(b.num_rows, np.int64), [np.arange(b.num_rows)], []
            for i, x in _by_length(b["embedding"]):
                home[i] = cells.home(x)[0]
                row, cell = cells.guests(x, home[i])
                rows.append(i[row])
                visits.append(cell)
            row, cell = np.concatenate(rows), np.concatenate([home, *visits])
            order = np.argsort(row, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
            yield pa.record_batch({c: b[c] for c in b.schema.names} | {"cells": pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[order].astype(np.int32)))})

    return place


def _linked(threshold: float):
    """Links between the two blocks of a group, or inside its one block: what each class links to and its local root."""
    schema = {"node": pa.int64(), "links": pa.int64(), "root": pa.int64()}

    def link(key: tuple, group: pa.Table) -> pa.Table:
        node, n, block = (group[c].to_numpy() for c in ("node", "n", "block"))
        guest = group["guest"].to_numpy()
        length, flat = _rows(group["embedding"])
        x = unit(flat.reshape(len(node), int(length[0])))
        low, high = key[-2].as_py(), key[-1].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links, root, met = np.zeros(len(node), np.int64), np.arange(len(node)), np.zeros(len(node), bool)
        for s in range(0, len(left), STRIP):
            rows = left[s:s + STRIP]
            near = x[rows] @ x[right].T >= threshold
            near &= ~(guest[rows][:, None] & guest[right])
            if low == high:
                near &= rows[:, None] != right
            links[rows] += near @ n[right]
            if low != high:
                links[right] += n[rows] @ near
            for i in np.flatnonzero(near.any(1)):
                other = right[near[i]]
                met[rows[i]] = met[other] = True
                roots = np.unique(np.append(root[other], root[rows[i]]))
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, root, node)
        out = np.flatnonzero(met)
        return pa.table([pa.array(node[out]), pa.array(links[out]), pa.array(least[root[out]])], schema=pa.schema(schema))

    return link


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node, links, root``: partial results of all groups for the stored classes ``nodes (node, label, embedding, n)``.

    Rows of a node add up to the number of vectors it links to; ``(node,
    root)`` connect all linked classes.
    """
    n = nodes.count()
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("label", "embedding").toArrow().combine_chunks()
    if not n:
        return nodes.select("node", F.col("n").alias("links"), F.col("node").alias("root"))
    lengths, _ = _rows(picked["embedding"])
    sample = np.zeros((len(lengths), lengths.max()))
    for i, x in _by_length(picked["embedding"]):
        sample[i, :x.shape[1]] = x
    cells = chosen(sample, np.unique(picked["label"].to_numpy(), return_inverse=True)[1], n, threshold)
    angles = nodes.mapInArrow(_homes(cells), "node bigint, cell int, angle double").groupBy("cell").agg(F.max("angle").alias("angle")).collect()  # one row per cell
    cells.reach = np.full(len(cells.centroids), -np.pi)
    for r in angles:
        cells.reach[r["cell"]] = r["angle"]
    schema = T.StructType([*nodes.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    placed = stored(nodes.mapInArrow(_placed(cells), schema))
    visits = placed.select("*", F.size("embedding").alias("dim"), F.posexplode("cells").alias("at", "cell")).withColumn("guest", F.col("at") > 0).drop("cells", "at")
    group = ["label", "dim", "cell"]
    sizes = visits.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    cut = visits.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(*group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "n", "embedding", "guest", "block")
    return pairs.groupBy(*group, "low", "high").applyInArrow(_linked(threshold), "node bigint, links bigint, root bigint")


def groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding, label)``.

    Vectors link if their labels are equal, they have the same number of
    components and their cosine is at least ``threshold``.  Rows whose label,
    id or vector is null, and vectors that are zero or hold null or non-finite
    components, link with nothing and stay.  Repeated rows link with each
    other; all rows that carry a component's id are kept.  Further columns are
    ignored.  An empty table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    copies = stored(rows.filter(part).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .withColumn("tie", F.xxhash64("label", "embedding")))
    nodes = stored(ranked(copies, ["first", "tie"]).withColumnRenamed("position", "node"))
    met = stored(links(nodes.select("node", "label", "embedding", "n"), threshold))
    total = met.groupBy("node").agg(F.sum("links").alias("links"))
    # nodes are numbered by their smallest id, so the smallest node of a component carries the smallest id
    root = components(met.filter("root < node").select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "node")
    names = nodes.select(F.col("node").alias("root"), F.col("first").alias("component_id"))
    of = nodes.join(total, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).join(names, "root")
    of = of.select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    found = rows.filter(part).join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
