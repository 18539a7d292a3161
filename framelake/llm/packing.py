"""Packing documents into sequences of fixed length by a configuration linear program.

Only the histogram of lengths matters for the plan, and it has at most as many
bars as a sequence has tokens, whatever the corpus.  The program asks for the
fewest configurations (multisets of lengths that fit one sequence), fractions
allowed, that cover every bar.  Multiplicative weights solve it: a length's
weight is its price, a knapsack dynamic program finds the configurations of
greatest price, a step with one of them lowers the weights of what it covers.
The prices over the greatest price bound the program from below.

Whole multiples of the result are dealt; what rounding leaves is a smaller
program of the same kind, and the last pieces are dealt by best fit.
Documents are then given to configurations by their number among those of
equal length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import LONG, PIECES
from .common import ranked, stored

CAPACITY = 2048
UNIT, TOGETHER = 4 << 20, 4096  # bytes of text tokenised at once, new pieces given to the tokenizer at once
# Classes of bytes: white space as the vocabulary sees it, also as characters of several bytes; letters and stops of ASCII.
_SPACE, _LETTER, _STOP, _OTHER = range(4)
_CLASS = bytes(_SPACE if c in b"\t\n\x0b\x0c\r " else _STOP if c in b".,;:!?" else _LETTER if bytes([c]).isalpha() else _OTHER for c in range(256))
_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
# Pricings of a program, steps and new configurations after each, configurations that take part in steps, gap to the bound at which it ends.
PRICINGS, STEPS, FRESH, POOL, GAP = 120, 160, 160, 2500, 5e-4
# A priced configuration is near enough to the best; the learning rate at first, its factor per tenth of the pricings, its least; weight lost in a step.
NEAR, RATE, COOLING, LEAST_RATE, LOSS = 0.1, 0.5, 0.65, 0.03, 0.3
# Programs in a row, each for the rest of the one before.
PROGRAMS = 4

Config = tuple[int, dict[int, int]]  # multiplicity, length -> how often


def priced(price: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the greatest price within each capacity, and a length to take there (0: none).

    ``price``: by length, minus infinity where there is none; any number of
    copies may be taken.  Of equal prices the longest length is taken.
    """
    best, take = np.zeros(cap + 1), np.zeros(cap + 1, np.int64)
    for c in range(1, cap + 1):
        v = best[:c] + price[c:0:-1]
        k = int(v.argmax())
        best[c], take[c] = (v[k], c - k) if v[k] > best[c - 1] else (best[c - 1], 0)
    return best, take


def _filled(take: list[int], n: int, cap: int) -> dict[int, int]:
    """The best configuration that holds ``n``."""
    out, c = {n: 1}, cap - n
    while c > 0:
        k = take[c]
        if k:
            out[k] = out.get(k, 0) + 1
        c -= k or 1
    return out


class Program:
    """Fractional solution for a histogram: ``share`` of each configuration of ``pool``, ``cover`` of each length, lower ``bound``."""

    def __init__(self, hist: dict[int, int], cap: int):
        self.cap, self.lengths = cap, np.array(sorted(hist))
        self.counts = np.array([hist[n] for n in self.lengths.tolist()], float)
        self.at = {n: i for i, n in enumerate(self.lengths.tolist())}
        self.pool: list[dict[int, int]] = []
        self.known: set[tuple] = set()
        self.index, self.copies = np.zeros((0, 2), np.int64), np.zeros((0, 2))
        self.bound = 0.0
        self._clear()
        self._solve()

    def _clear(self) -> None:
        self.share, self.cover, self.average = np.zeros(len(self.pool)), np.zeros(len(self.lengths)), np.zeros(len(self.lengths))

    def _add(self, fresh: list[dict[int, int]]) -> None:
        fresh = [c for c in fresh if (k := tuple(sorted(c.items()))) not in self.known and not self.known.add(k)]
        width = max([self.index.shape[1], *map(len, fresh)])
        grown = [np.pad(x, ((0, len(fresh)), (0, width - x.shape[1]))) for x in (self.index, self.copies)]
        for i, c in enumerate(fresh, len(self.pool)):
            grown[0][i, :len(c)], grown[1][i, :len(c)] = [self.at[n] for n in c], list(c.values())
        self.index, self.copies = grown
        self.pool += fresh
        self.share = np.pad(self.share, (0, len(fresh)))

    def _knapsack(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest prices under the weights; all prices over the greatest one bound the program."""
        price = np.full(self.cap + 1, -np.inf)
        price[self.lengths] = weight
        best, take = priced(price, self.cap)
        self.bound = max(self.bound, float(self.counts @ weight / best[self.cap]))
        return best, take

    def _price(self, weight: np.ndarray) -> None:
        """Add the best configurations of lengths that are covered least."""
        best, take = self._knapsack(weight)
        self.average += weight / best[self.cap]
        value = weight + best[self.cap - self.lengths]
        near = np.flatnonzero(value >= best[self.cap] * (1 - NEAR))
        order = np.lexsort((-self.counts[near] * self.lengths[near], self.cover[near]))
        take = take.tolist()
        self._add([_filled(take, n, self.cap) for n in self.lengths[near[order[:FRESH]]].tolist()])

    def _steps(self, weight: np.ndarray, rate: float) -> None:
        """Steps with the dearest configurations; each lowers the weight of its lengths by about ``LOSS`` of the configuration's price."""
        value = (weight[self.index] * self.copies).sum(1)
        act = np.argpartition(-value, POOL)[:POOL] if len(value) > POOL else np.arange(len(value))
        index, copies = self.index[act], self.copies[act]
        for _ in range(STEPS):
            value = (weight[index] * copies).sum(1)
            j = int(value.argmax())
            some = copies[j] > 0
            i, a = index[j][some], copies[j][some]
            gain = a / self.counts[i]
            step = LOSS / (rate * float((weight[i] * a * gain).sum() / value[j]))
            self.cover[i] += step * gain
            self.share[act[j]] += step
            weight[i] *= np.exp(-rate * step * gain)

    def _solve(self) -> None:
        weight, rate, tenth = self.lengths / self.cap, RATE, max(1, PRICINGS // 10)
        for r in range(1, PRICINGS + 1):
            weight = np.maximum(weight / weight.max(), 1e-12)
            self._price(weight)
            self._steps(weight, rate)
            if r % tenth == 0:
                self._knapsack(self.average)
                if r < 0.6 * PRICINGS:  # prices are learnt, the shares so far are not kept
                    self._clear()
                    rate = max(rate * COOLING, LEAST_RATE)
            least = self.cover.min()
            if least > 2 and self.share.sum() <= least * self.bound * (1 + GAP):
                break

    def dealt(self, hist: dict[int, int], scale: float) -> tuple[list[Config], dict[int, int]]:
        """Whole multiples of the scaled shares, and the pieces they leave."""
        left, out = Counter(hist), []
        for j in np.argsort(-self.share, kind="stable").tolist():
            if self.share[j] <= 0:
                break
            m = min(int(self.share[j] * scale), *(left[n] // a for n, a in self.pool[j].items()))
            if m:
                out.append((m, self.pool[j]))
                left.subtract({n: a * m for n, a in self.pool[j].items()})
        return out, {n: c for n, c in left.items() if c}


def best_fit(hist: dict[int, int], cap: int) -> list[Config]:
    """Best fit of the longest first, by counts: equal sequences are filled together."""
    rooms: dict[int, list[Config]] = {}
    for n in sorted(hist, reverse=True):
        c = hist[n]
        while c:
            room = min((r for r in rooms if r >= n), default=cap)
            m, config = rooms[room].pop() if room in rooms else (c, {})
            if room in rooms and not rooms[room]:
                del rooms[room]
            k = min(room // n, c)
            take = min(m, c // k)
            if take < m and config:
                rooms.setdefault(room, []).append((m - take, config))
            rooms.setdefault(room - k * n, []).append((take, {**config, n: config.get(n, 0) + k}))
            c -= k * take
    return [x for r in rooms.values() for x in r]


def _number(configs: list[Config]) -> int:
    return sum(m for m, _ in configs)


def plan(hist: dict[int, int], cap: int = CAPACITY) -> list[Config]:
    """Configurations with whole multiplicities that use every piece exactly once."""
    left = {n: c for n, c in hist.items() if c > 0}
    if any(not 0 < n <= cap for n in left):
        raise ValueError(f"lengths must lie in 1..{cap}")
    out: list[Config] = [(left.pop(cap), {cap: 1})] if cap in left else []
    for _ in range(PROGRAMS):
        if not left:
            return out
        p = Program(left, cap)
        mean = float(np.average(p.cover, weights=p.counts * p.lengths))
        # several ways to round the same solution; the one that needs the fewest sequences with its rest dealt by best fit
        scales = {1 / mean, 0.9 / mean, 0.7 / mean, 1 / max(p.cover.min(), 0.8 * mean)}
        tries = [p.dealt(left, s) for s in sorted(scales, reverse=True)]
        need = [_number(c) + _number(best_fit(rest, cap)) for c, rest in tries]
        configs, left = tries[int(np.argmin(need))]
        out += configs
        if len(configs) == 0:
            break
    return out + best_fit(left, cap)


def places(configs: list[Config]) -> dict[str, np.ndarray]:
    """Per (length, first number) in order: first sequence, pieces per sequence, offset of the first."""
    rows, base, sequence = [], {}, 0
    for m, config in configs:
        offset = 0
        for n in sorted(config, reverse=True):
            a = config[n]
            rows.append((n << 44 | base.get(n, 0), sequence, a, offset))
            base[n] = base.get(n, 0) + a * m
            offset += a * n
        sequence += m
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("key", "sequence", "each", "offset"), cols))


def pack(pieces: DataFrame, cap: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces (doc_id, piece, length, ...)``, a stored table.

    Pieces of one length are interchangeable; they are numbered in hash order.
    Only the histogram comes to the driver.
    """
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where, starts, total = places(plan(hist, cap)), np.zeros(cap + 2, np.int64), 0
    for n in sorted(hist):
        starts[n] = total
        total += hist[n]
    cols = pieces.columns
    numbered = ranked(pieces.withColumn("_tie", F.xxhash64("doc_id", "piece", "ids_crc32")), ["length", "_tie", "doc_id", "piece", "start"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, position = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "position"))
            number = position - starts[n]
            i = np.searchsorted(where["key"], n << 44 | number, "right") - 1
            r = number - (where["key"][i] & (1 << 44) - 1)
            out = {c: b[c] for c in cols}
            out["sequence_id"] = pa.array(where["sequence"][i] + r // where["each"][i])
            out["offset"] = pa.array(where["offset"][i] + r % where["each"][i] * n)
            yield pa.record_batch(out)

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.select(*cols, "position").mapInArrow(place, schema)


class KnownPieces:
    """Ids of the pieces of texts, as little-endian 32-bit numbers, remembered over two generations.

    The vocabulary never looks across the places where texts are cut, so the
    ids of a text are those of its pieces, joined.  A new piece of ASCII
    letters goes straight to the model, others to the tokenizer many at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.now, self.before = {}, {}

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        got = self.tokenizer.encode("\n".join(pieces), add_special_tokens=False)
        begin = np.cumsum([0, *[len(p) + 1 for p in pieces]])
        at = np.searchsorted(np.fromiter((o[0] for o in got.offsets), np.int64, len(got)), begin)
        ids = np.array(got.ids, "<u4").tobytes()
        return [ids[4 * i:4 * j] for i, j in zip(at.tolist(), at[1:].tolist())]

    def look_up(self, pieces: list[str]) -> list[bytes]:
        now, before = self.now, self.before
        new = [p for p in pieces if p not in now and p not in before]
        tokenize = self.tokenizer.model.tokenize
        made = {p: array("I", [t.id for t in tokenize(p.lower())]).tobytes() for p in new if p.isascii() and p.isalpha()}
        new = [p for p in new if p not in made]
        for lo in range(0, len(new), TOGETHER):
            some = new[lo:lo + TOGETHER]
            made.update(zip(some, self._fresh(some)))
        out = []
        for p in pieces:
            ids = now.get(p)
            if ids is None:
                ids = before.get(p)
                if ids is None:
                    ids = made[p]
                if len(p) <= LONG:
                    now[p] = ids
            out.append(ids)
        if len(now) >= PIECES:
            self.now, self.before = {}, now
        return out


def units(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts of stretches of about ``UNIT`` bytes; null is empty."""
    texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    size = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)) + 1
    cut = np.flatnonzero(np.diff(np.cumsum(size) // UNIT)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)]):
        if lo < hi:
            yield lo, [t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]


def token_ids(texts: list[bytes], known: KnownPieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by id 0, and where each text begins (with the end of the last).

    Texts are cut at white space and between a letter and a stop, where the
    vocabulary always cuts.  Every different piece is looked up once; its ids
    are then copied to all its places.
    """
    joined = b"\n".join(texts)
    if _WIDE_SPACE.search(joined):
        joined = _WIDE_SPACE.sub(lambda m: b" " * len(m[0]), joined)
    kind = np.frombuffer(b"\n" + joined.translate(_CLASS) + b"\0", np.uint8)
    here, before = kind[1:] != _SPACE, np.concatenate([[False], kind[1:-1] != _SPACE])
    cut = (kind[:-1] == _LETTER) & (kind[1:] == _STOP)
    starts, ends = np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = np.frombuffer(joined, np.uint8)[here[:-1]]
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    some = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    of = known.look_up(pc.binary_join(some, "\n")[0].as_py().split("\n") if len(starts) else [])
    code = coded.indices.to_numpy(zero_copy_only=False)
    length = np.fromiter(map(len, of), np.int64, len(of)) // 4
    flat, first = np.frombuffer(b"".join(of), "<u4"), np.cumsum(length) - length
    n = length[code] if len(code) else np.zeros(0, np.int64)
    after = np.cumsum(n)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    words_before = np.searchsorted(starts, text_end)
    end = np.concatenate([[0], after])[words_before] + np.arange(1, len(texts) + 1)
    ids = np.zeros(int(end[-1]), "<u4")
    keep = np.ones(len(ids), bool)
    keep[end - 1] = False
    ids[keep] = flat[np.repeat(first[code] - (after - n), n) + np.arange(len(ids) - len(texts))]
    return ids, np.concatenate([[0], end])


def token_pieces(docs: DataFrame, path: str, cap: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of at most ``cap`` tokens: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A null text is empty; every document ends in id 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownPieces(path)
        for batch in batches:
            for lo, texts in units(batch["text"]):
                all_ids, begin = token_ids(texts, known)
                size = np.diff(begin)
                pieces = -(-size // cap)
                at = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * cap
                length = np.minimum(cap, size[at] - start)
                s, data = begin[at] + start, memoryview(all_ids).cast("B")
                crc = [zlib.crc32(data[4 * i:4 * (i + n)]) for i, n in zip(s.tolist(), length.tolist())]
                out = {"doc_id": batch["doc_id"].take(pa.array(at + lo)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                       "ids_crc32": pa.array(crc, pa.int64())}
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(s, len(all_ids)).astype(np.int32)), pa.array(all_ids.astype(np.int32)))
                yield pa.record_batch(out)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, cap: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(stored(token_pieces(docs, path, cap)), cap)


def sequences(docs: DataFrame, path: str, cap: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids``, at most ``cap`` ids each."""
    pieces = stored(token_pieces(docs, path, cap, ids=True))
    placed = pack(pieces, cap)
    whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
