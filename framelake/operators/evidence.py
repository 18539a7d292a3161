"""Neighbourhood evidence on ordered values and on pixel grids.

Ordered values use window functions over bounded neighbourhoods.  Pixel grids
use one dense array per frame: a frame is bounded by its image size, and whole
frames are handed to vectorised kernels batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from framelake.functions.ratios import col
from framelake.operators.layout import CHUNK, group_batches, group_ids, lookup, neighbourhood, percentiles, running

KEY, POS = "video_name", "frame_order"
FRAME = [KEY, POS]


def threshold_per_group(df: DataFrame, keys: Sequence[str], response: str, percentile: float, minimum: float, name: str = "selected",
                        spread: str | None = None) -> DataFrame:
    """Response at least the percentile of the group's positive responses and at least ``minimum``.

    A frame's responses are bounded by its image and fit one aggregate.  For
    larger groups name a ``spread`` column: the percentile is then taken in
    bins and the join back is salted.
    """
    q = percentile / 100.0
    if spread is None:
        t = df.groupBy(*keys).agg(F.percentile(F.when(F.col(response) > 0, F.col(response)), q).alias("_t"))
        out = df.join(t, list(keys))
    else:
        out = lookup(df, percentiles(df.filter(F.col(response) > 0), keys, response, {"_t": q}), keys, F.col(spread))
    return out.withColumn(name, F.coalesce((F.col(response) >= F.col("_t")) & (F.col(response) >= minimum), F.lit(False))).drop("_t")


def local_percentile(df: DataFrame, value: str, size: int, percentile: float, contrast: float, chunk: int = CHUNK) -> DataFrame:
    """Values bright against their neighbours in the sequence; windows shorten at the ends."""
    if size < 1 or size % 2 == 0:
        raise ValueError("size must be odd")
    h = size // 2

    def make(w):
        near = w.rowsBetween(-h, h)
        return {"_p": F.percentile(value, F.lit(percentile / 100.0)).over(near), "_m": F.percentile(value, F.lit(0.5)).over(near)}

    out = neighbourhood(df, [KEY], POS, h, h, make, chunk)
    return out.withColumns({"threshold": F.col("_p"), "contrast": F.col(value) - F.col("_m")}).withColumn(
        "selected", (F.col(value) >= F.col("threshold")) & (F.col("contrast") >= contrast)).drop("_p", "_m")


def _staged(df: DataFrame, margin: int, stages: Sequence[Callable[[W], dict[str, Column]]], chunk: int) -> DataFrame:
    """Several window steps on the same chunks; the halo covers all of them."""
    from framelake.operators.layout import with_halo

    w = W.partitionBy(KEY, "_chunk").orderBy(POS)
    out = with_halo(df, [KEY], POS, margin, margin, chunk)
    for make in stages:
        out = out.withColumns(make(w))
    return out.filter("_own").drop("_own", "_chunk")


def top_hat(df: DataFrame, value: str, size: int, chunk: int = CHUNK) -> DataFrame:
    """Value above its opening (lowest, then highest, of the neighbourhood)."""
    h = size // 2
    near = lambda w: w.rowsBetween(-h, h)
    out = _staged(df, 2 * h, [lambda w: {"_e": F.min(value).over(near(w))}, lambda w: {"_o": F.max("_e").over(near(w))}], chunk)
    return out.withColumn("response", F.col(value) - F.col("_o")).drop("_e", "_o")


def runs(df: DataFrame, flag: str, name: str = "run", chunk: int = CHUNK) -> DataFrame:
    """Number the stretches of consecutive equal flags in each video."""
    prev = neighbourhood(df, [KEY], POS, 1, 0, lambda w: {"_prev": F.lag(flag).over(w)}, chunk)
    change = F.when(F.col("_prev") == F.col(flag), 0).otherwise(1)
    return running(prev, [KEY], POS, {name: ("sum", change)}, chunk).drop("_prev")


def clean_runs(df: DataFrame, flag: str, open_size: int, close_size: int, min_run: int, chunk: int = CHUNK) -> DataFrame:
    """Open, close, then drop selected stretches shorter than ``min_run``."""
    o, c = open_size // 2, close_size // 2
    bit = F.col(flag).cast("int")
    near = lambda w, h: w.rowsBetween(-h, h)
    out = _staged(df.withColumn("_b", bit), 2 * (o + c), [
        lambda w: {"_1": F.min("_b").over(near(w, o))}, lambda w: {"_2": F.max("_1").over(near(w, o))},
        lambda w: {"_3": F.max("_2").over(near(w, c))}, lambda w: {"_4": F.min("_3").over(near(w, c))}], chunk)
    out = out.withColumn("_on", F.col("_4") == 1).drop("_b", "_1", "_2", "_3", "_4")
    numbered = runs(out, "_on", "_run", chunk)
    size = numbered.groupBy(KEY, "_run").agg(F.count(F.lit(1)).alias("_size"))
    return numbered.join(size, [KEY, "_run"]).withColumn("cleaned", F.col("_on") & (F.col("_size") >= min_run)).drop("_on", "_run", "_size")


def _labels(frame: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Smallest row index of each cell's 8-connected component, for many frames at once."""
    n = len(frame)
    x, y = x - x.min() + 1, y - y.min() + 1
    wide, high = int(x.max()) + 2, int(y.max()) + 2
    key = (frame.astype(np.int64) * high + y) * wide + x
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    a, b = [], []
    for step in (1, wide - 1, wide, wide + 1):
        at = np.searchsorted(sorted_key, key + step)
        hit = (at < n) & (sorted_key[np.minimum(at, n - 1)] == key + step)
        a.append(np.flatnonzero(hit))
        b.append(order[at[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    a, b = rank[a], rank[b]
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all() and (new[a] == new[b]).all():
            return order[new[rank]]
        lab = new


def components(cells: DataFrame, keys: Sequence[str] = FRAME, x: str = "x", y: str = "y") -> DataFrame:
    """8-connected components of the given cells of each frame.

    The component is named by its first cell in reading order (comp_y, comp_x).
    """
    fields = {f.name: f for f in cells.schema.fields}
    schema = T.StructType([*[fields[k] for k in keys], fields[x], fields[y], T.StructField("comp_y", T.IntegerType()), T.StructField("comp_x", T.IntegerType())])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = pdf[x].to_numpy(), pdf[y].to_numpy()
        first = _labels(group_ids(pdf, keys), ys, xs)
        return pdf[[*keys, x, y]].assign(comp_y=ys[first].astype(np.int32), comp_x=xs[first].astype(np.int32))

    return group_batches(cells.select(*keys, x, y).distinct(), keys, kernel, schema)


def _windows(img: np.ndarray, size: int, mode: str, value: float = 0.0) -> np.ndarray:
    """Every size x size window of a stack of images (frame, y, x, dy, dx), without copying."""
    h = size // 2
    edge = (h, size - 1 - h)
    pad = np.pad(img, ((0, 0), edge, edge), mode=mode, **({"constant_values": value} if mode == "constant" else {}))
    return np.lib.stride_tricks.sliding_window_view(pad, (size, size), axis=(1, 2))


def _extreme(img: np.ndarray, size: int, pick: np.ufunc, outside: float) -> np.ndarray:
    """Lowest or highest of every size x size window: columns first, then rows."""
    h = size // 2
    for axis, length in ((1, img.shape[1]), (2, img.shape[2])):
        edge = [(h, size - 1 - h) if a == axis else (0, 0) for a in range(3)]
        pad = np.pad(img, edge, constant_values=outside)
        cut = lambda k: pad[:, k:k + length] if axis == 1 else pad[:, :, k:k + length]
        img = cut(0).copy()
        for k in range(1, size):
            pick(img, cut(k), out=img)
    return img


def _opened(img: np.ndarray, size: int) -> np.ndarray:
    return _extreme(_extreme(img, size, np.minimum, np.inf), size, np.maximum, -np.inf)


def _bright(img: np.ndarray, size: int, percentile: float, contrast: float) -> np.ndarray:
    """Pixels not below the percentile of their window and ``contrast`` above its median.

    Where nothing is negative no dark pixel is above a median, so if few pixels
    are lit only their windows are ranked.
    """
    n = size * size
    lit = np.nonzero(img)
    values = img[lit]
    if not (contrast > 0 and img.min() >= 0 and len(values) * n < img.size * min(n, len(np.unique(values)) + 1)):
        p, m = _ranked(img, size, percentile)
        return (img >= p) & (img - m >= contrast)
    at, mid = min(n - 1, int(n * percentile / 100.0)), n // 2
    view, out = _windows(img, size, "symmetric"), np.zeros(img.shape, bool)
    strip = max(1, STRIP // n)
    for r in range(0, len(values), strip):
        some, v = tuple(i[r:r + strip] for i in lit), values[r:r + strip]
        part = np.partition(view[some].reshape(len(v), n), sorted({at, mid}), axis=1)
        out[some] = (v >= part[:, at]) & (v - part[:, mid] >= contrast)
    return out


def _ranked(img: np.ndarray, size: int, percentile: float) -> tuple[np.ndarray, np.ndarray]:
    """The percentile and the median element of every window, a strip of rows at a time to bound memory."""
    f, high, wide = img.shape
    n = size * size
    at, mid = min(n - 1, int(n * percentile / 100.0)), n // 2
    levels = np.unique(img)
    if len(levels) < n:
        return _counted(img, levels, size, at, mid)
    view = _windows(img, size, "symmetric")
    p, m = np.empty_like(img), np.empty_like(img)
    strip = max(1, STRIP // (f * wide * n))
    for r in range(0, high, strip):
        part = np.partition(view[:, r:r + strip].reshape(f, -1, wide, n), sorted({at, mid}), axis=3)
        p[:, r:r + strip], m[:, r:r + strip] = part[..., at], part[..., mid]
    return p, m


def _counted(img: np.ndarray, levels: np.ndarray, size: int, at: int, mid: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by counting: per grey level, how many of the window's pixels are not brighter.

    Window sums come from running sums, so the cost does not grow with the
    window; it is used where a window holds more pixels than there are levels.
    """
    h = size // 2
    edge = (h, size - 1 - h)
    pad = np.searchsorted(levels, np.pad(img, ((0, 0), edge, edge), mode="symmetric"))
    f, high, wide = img.shape
    total = np.zeros((f, high + size, wide + size), np.int32)
    p, m = np.zeros(img.shape, np.int32), np.zeros(img.shape, np.int32)
    for k in range(len(levels) - 1):
        np.cumsum(np.cumsum(pad <= k, axis=1, dtype=np.int32), axis=2, out=total[:, 1:, 1:])
        n = total[:, size:, size:] - total[:, :-size, size:] - total[:, size:, :-size] + total[:, :-size, :-size]
        p += n <= at
        m += n <= mid
    return levels[p], levels[m]


STRIP = 8_000_000
STACK = 300_000


def _cleaned(mask: np.ndarray, open_size: int, close_size: int, min_area: int) -> np.ndarray:
    m = mask.astype(float)
    if open_size > 1:
        m = _opened(m, open_size)
    if close_size > 1:
        m = -_opened(-m, close_size)
    f, y, x = np.nonzero(m > 0)
    if min_area > 1 and len(f):
        lab = _labels(f, y, x)
        small = np.bincount(lab, minlength=len(f))[lab] < min_area
        m[f[small], y[small], x[small]] = 0
    return m > 0


def _tophat_mask(img: np.ndarray, size: int, percentile: float, minimum: float) -> np.ndarray:
    resp = img - _opened(img, size)
    limit = np.full(len(img), np.inf)
    f, y, x = np.nonzero(resp > 0)
    if len(f):
        v = resp[f, y, x]
        v = v[np.lexsort((v, f))]
        frames, first, n = np.unique(f, return_index=True, return_counts=True)
        at = (n - 1) * (percentile / 100)
        low = np.floor(at).astype(np.int64)
        t, a, b = at - low, v[first + low], v[first + np.minimum(low + 1, n - 1)]
        limit[frames] = np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)  # as np.percentile, all frames at once
    return (resp >= limit[:, None, None]) & (resp >= minimum)


def grid_evidence(cells: DataFrame, width: int, height: int, window: int = 5, percentile: float = 80.0, contrast: float = 4.0, tophat: int = 3,
                  tophat_percentile: float = 85.0, min_response: float = 2.0, open_size: int = 0, close_size: int = 0, min_area: int = 0,
                  keys: Sequence[str] = FRAME) -> DataFrame:
    """Local-percentile (bit 2) and top-hat (bit 4) evidence of image cells, each cleaned on its own.

    ``cells``: x, y, value per frame; absent cells are dark.  Mirrored edges
    for the percentile, rectangular kernels for the morphology.  Small frames
    are stacked, so the kernels run on many frames at once.
    """
    fields = {f.name: f for f in cells.schema.fields}
    schema = T.StructType([*[fields[k] for k in keys], T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()),
                           T.StructField("value", T.DoubleType()), T.StructField("flags", T.IntegerType())])

    def stack(pdf: pd.DataFrame, ids: np.ndarray) -> pd.DataFrame:
        img = np.zeros((ids[-1] + 1, height, width))
        img[ids, pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["value"].to_numpy()
        local = _cleaned(_bright(img, window, percentile, contrast), open_size, close_size, min_area)
        top = _cleaned(_tophat_mask(img, tophat, tophat_percentile, min_response), open_size, close_size, min_area)
        flags = local * 2 + top * 4
        f, y, x = np.nonzero(flags)
        names = pdf[list(keys)].iloc[np.searchsorted(ids, np.arange(ids[-1] + 1))].iloc[f].reset_index(drop=True)
        return names.assign(x=x.astype(np.int32), y=y.astype(np.int32), value=img[f, y, x], flags=flags[f, y, x].astype(np.int32))[schema.names]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = group_ids(pdf, keys)
        per = max(1, STACK // (height * width))
        out = []
        for first in range(0, ids[-1] + 1, per):
            a, b = np.searchsorted(ids, [first, first + per])
            out.append(stack(pdf.iloc[a:b], ids[a:b] - first))
        return pd.concat(out, ignore_index=True)

    return group_batches(cells.select(*keys, "x", "y", "value"), keys, kernel, schema)


def brightness(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Per frame: mean, deviation, 5 to 95 percentile spread, bright and non-dark shares."""
    v = col(value)
    return cells.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.percentile(v, 0.95) - F.percentile(v, 0.05)).alias("spread"),
        F.avg((v >= 180).cast("double")).alias("bright_share"), F.avg((v >= 20).cast("double")).alias("lit_share"))


def frame_difference(cells: DataFrame, value: str = "value") -> DataFrame:
    """Mean absolute change per frame against the frame before on the same pixel.

    An equi-join with the next frame's rows, so no pixel's history is sorted.
    """
    now = cells.select(KEY, POS, "x", "y", F.col(value).alias("_now"))
    before = cells.select(KEY, (F.col(POS) + 1).cast("int").alias(POS), "x", "y", F.col(value).alias("_before"))
    diff = F.abs(F.col("_now") - F.col("_before"))
    return now.join(before, [KEY, POS, "x", "y"]).groupBy(KEY, POS).agg(F.avg(diff).alias("diff_mean"), F.stddev_pop(diff).alias("diff_std"), F.count(F.lit(1)).alias("pixels"))
