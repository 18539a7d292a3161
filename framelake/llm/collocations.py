"""Phrase collocations from a weighted de Bruijn graph of words.

*Edges.*  The longest grams, four words, are the edges; each leads from the
node of its first three words to that of its last three.  Every word occurrence
starts one edge; where its piece ends earlier, the edge is a shorter stub, the
correction for the piece's end.  Edges and stubs are summed on both sides of
one shuffle, sent in compressed blocks to ranges of the word order.

*Flow.*  What leaves a node, stubs that end in it included, is how often its
three words occur; the same sum over all nodes with the same first two words or
first word gives the shorter counts.  In word order each is a run of
neighbouring rows.  Only runs cut by the border of a range need adding up.

*Paths.*  A node all of whose flow comes in by one edge and leaves by one is
unary.  Edges joined by unary nodes are compacted to one path by pointer
doubling; the shorter phrases a path covers are read off it once per word.

Candidates are scored over their cuts with exact integers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

LONGEST, LEAST, TOP = 4, 30, 2000
# Bytes of text summed at once in a task, of a range, of the sample that sets the borders of ranges; border candidates per range.
UNIT, RANGE, SAMPLE, EACH = 3 << 20, 4 << 20, 4 << 20, 64
# Words of a path read as one value.
STRETCH = 1024
_BREAKS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = bytes(2 if c in _BREAKS else 1 if c in _GAPS else 0 for c in range(256))
_BITS = 23  # a unit or a range has fewer than 2 ** 23 different words

Gram = tuple[bytes, ...]  # language, then the words


class Grams:
    """Different grams in order with their counts: language and words as places in sorted lists, 0 for no word."""

    def __init__(self, languages: Sequence[bytes], vocabulary: pa.Array, language: np.ndarray, words: np.ndarray, counts: np.ndarray):
        """``words``: one row per place of a gram; unsorted, repeats allowed."""
        high = language.astype(np.int64) << 2 * _BITS | words[0].astype(np.int64) << _BITS | words[1]
        low = words[2].astype(np.int64) << _BITS | words[3]
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(order) else order
        del high, low
        self.languages, self.vocabulary = languages, vocabulary
        self.counts = np.add.reduceat(counts[order], new) if len(new) else counts[:0]
        at = order[new]
        self.language, self.words = language[at].astype(np.int32), words[:, at].astype(np.int32)

    def __len__(self) -> int:
        return len(self.counts)

    def gram(self, i: int) -> Gram:
        return (self.languages[self.language[i]], *[self.vocabulary[int(w) - 1].as_py() if w else b"" for w in self.words[:, i]])


def sorted_codes(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different values in byte order, and the place of each value there, from 1."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def gathered(texts: Sequence[bytes], languages: Sequence[bytes]) -> Grams:
    """Edges and stubs of some texts."""
    joined = b"\n".join(texts)
    kind = np.frombuffer(joined.translate(_KIND), np.uint8)
    word = np.concatenate([[False], kind == 0, [False]])
    starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = np.frombuffer(joined.translate(_LOWER), np.uint8)[kind == 0]
    vocabulary, ids = sorted_codes(pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]))
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    names = sorted(set(languages))
    of = {x: i for i, x in enumerate(names)}
    begin = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    language = np.array([of[x] for x in languages], np.int32)[np.searchsorted(begin, starts, "right") - 1]
    n, words = len(ids), np.zeros((LONGEST, len(ids)), np.int32)
    for k in range(LONGEST):
        same = piece[k:] == piece[:n - k] if k < n else np.zeros(0, bool)
        words[k, :len(same)] = np.where(same, ids[k:], 0)
    return Grams(names, vocabulary, language, words, np.ones(n, np.int64))


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of about ``most`` bytes, cut between pieces."""
    start = 0
    while len(text) - start > most:
        end = max(text.rfind(bytes([c]), start + 1, start + most) for c in _BREAKS)
        if end < 0:
            end = min((i for i in (text.find(bytes([c]), start + most) for c in _BREAKS) if i >= 0), default=-1)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    """Grams of all texts, summed over about ``UNIT`` bytes at a time."""
    texts, languages, size = [], [], 0
    for b in batches:
        for text, lang in zip(b["text"], b["lang"]):
            for part in _cut(text.as_py(), UNIT):
                texts.append(part)
                languages.append(lang.as_py())
                size += len(part) + 1
                if size >= UNIT:
                    yield gathered(texts, languages)
                    texts, languages, size = [], [], 0
                    pa.default_memory_pool().release_unused()
    if texts:
        yield gathered(texts, languages)


def packed(grams: Grams, start: int, end: int) -> bytes:
    """A range of grams as one compressed block, with the words it needs."""
    words = grams.words[:, start:end]
    used, local = np.unique(words, return_inverse=True)
    vocabulary = grams.vocabulary.take(pa.array(used[used > 0] - 1))
    local = local.reshape(words.shape) + (0 if len(used) and used[0] == 0 else 1)
    names, language = np.unique(grams.language[start:end], return_inverse=True)
    columns = {f"w{k}": pa.array(local[k].astype(np.int32)) for k in range(LONGEST)} | {"n": pa.array(grams.counts[start:end]), "lang": pa.array(language.astype(np.int32))}
    listed = {"words": vocabulary, "names": pa.array([grams.languages[i] for i in names], pa.binary())}
    out = []
    for part in (columns, listed):
        sink = pa.BufferOutputStream()
        batch = pa.record_batch(part) if part is columns else pa.record_batch({k: pa.array([v.to_pylist()], pa.list_(pa.binary())) for k, v in part.items()})
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        out.append(sink.getvalue().to_pybytes())
    return len(out[0]).to_bytes(8, "little") + out[0] + out[1]


def merged(blocks: Sequence[bytes]) -> Grams:
    """The grams of several blocks summed."""
    columns, words, names = [], [], []
    for b in blocks:
        n = int.from_bytes(b[:8], "little")
        columns.append(pa.ipc.open_stream(b[8:8 + n]).read_all())
        listed = pa.ipc.open_stream(b[8 + n:]).read_all()
        words.append(listed["words"].combine_chunks().flatten())
        names.append(listed["names"].combine_chunks().flatten())
    vocabulary, word = sorted_codes(pa.concat_arrays(words))
    languages, lang = sorted_codes(pa.concat_arrays(names))
    gram, language, at, of = [], [], 0, 0
    for c, w, x in zip(columns, words, names):
        codes = np.concatenate([np.zeros(1, np.int32), word[at:at + len(w)]])
        gram.append(codes[np.stack([c[f"w{k}"].to_numpy() for k in range(LONGEST)])])
        language.append(lang[of + c["lang"].to_numpy()] - 1)
        at, of = at + len(w), of + len(x)
    counts = np.concatenate([c["n"].to_numpy() for c in columns])
    return Grams(languages.to_pylist(), vocabulary, np.concatenate(language), np.concatenate(gram, axis=1), counts)


def flows(grams: Grams, least: int) -> Iterator[tuple[list[bytes], np.ndarray, list[bytes], np.ndarray]]:
    """Per length: languages, length, phrases and counts of all runs that reach ``least`` or touch an end of the range.

    Length 0 stands for all words of a language.
    """
    n = len(grams)
    new, before = np.zeros(n, bool), grams.language
    for k in range(LONGEST + 1):
        column = before if k == 0 else grams.words[k - 1]
        new |= np.concatenate([[True], column[1:] != column[:-1]])
        first = np.flatnonzero(new)
        count = np.add.reduceat(grams.counts, first)
        there = np.ones(len(first), bool) if k == 0 else column[first] > 0
        some = there & (count >= least)
        some[[0, -1]] = there[[0, -1]]
        if k == 0:
            some[:] = True
        i = first[some]
        words = [grams.vocabulary.take(pa.array(grams.words[j, i] - 1)).cast(pa.string()) for j in range(k)]
        phrase = pc.binary_join_element_wise(*words, " ") if k else pa.array([""] * len(i))
        lang = pa.array(grams.languages, pa.binary()).take(pa.array(grams.language[i])).cast(pa.string())
        yield pa.record_batch({"lang": lang, "size": pa.array(np.full(len(i), k, np.int32)), "phrase": phrase, "a": pa.array(count[some])})


def borders(docs: DataFrame) -> list[Gram]:
    """Grams that cut the word order into ranges of about ``RANGE`` bytes of text, from a sample of documents.

    They only balance the ranges.  Like a range partitioning of Spark's own,
    the driver sees a fixed number of grams per range.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // RANGE)
    if n < 2:
        return []
    share = min(1.0, SAMPLE * max(1, n // 256) / total)
    step = max(1, int(total * share / 6) // (EACH * n))
    some = docs.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) <= int(share * (1 << 30)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in units(batches):
            rows = [grams.gram(i) for i in range(step // 2, len(grams), step)]
            yield pa.record_batch({"gram": pa.array([list(r) for r in rows], pa.list_(pa.binary()))})

    seen = sorted(tuple(map(bytes, r["gram"])) for r in some.mapInArrow(pick, "gram array<binary>").collect())
    return sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, size, phrase, a``: all phrases of 1 to 4 words that occur ``least`` times; size 0 counts all words."""
    lang = F.coalesce("lang", F.lit("und")).cast("binary")
    texts = docs.select(lang.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    cuts = borders(texts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in units(batches):
            if not len(grams):
                continue
            at = [0, *[bisect_left(range(len(grams)), c, key=grams.gram) for c in cuts], len(grams)]
            for part, (start, end) in enumerate(zip(at, at[1:])):
                if start < end:
                    yield pa.record_batch({"part": pa.array([part], pa.int32()), "block": pa.array([packed(grams, start, end)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(flows(merged(table["block"].to_pylist()), least))

    parts = texts.mapInArrow(send, "part int, block binary").groupBy("part").applyInArrow(add, "lang string, size int, phrase string, a bigint")
    return parts.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).filter((F.col("size") == 0) | (F.col("a") >= least))


def _first(phrase: str, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def paths(counted: DataFrame) -> DataFrame:
    """``lang, words, a``: edges compacted along unary nodes, as word lists; longer paths in stretches of 1,024 edges."""
    edges = counted.filter(F.col("size") == LONGEST).select("lang", F.col("phrase").alias("edge"), "a")
    nodes = counted.filter(F.col("size") == LONGEST - 1).select("lang", F.col("phrase").alias("node"), "a")
    into = edges.withColumn("node", _first("edge", 1 - LONGEST)).join(nodes, ["lang", "node", "a"])
    out = edges.withColumn("node", _first("edge", LONGEST - 1)).join(nodes, ["lang", "node", "a"]).withColumnRenamed("edge", "after")
    back = into.join(out, ["lang", "node", "a"]).select("lang", F.col("after").alias("edge"), F.col("edge").alias("root"))
    # root: an earlier edge of the path, back: how many edges before
    at = stored(edges.join(back, ["lang", "edge"], "left").select("lang", "edge", "a", F.coalesce("root", "edge").alias("root"), F.col("root").isNotNull().cast("long").alias("back")))
    moving = at.filter("back > 0")
    done = [at.filter("back = 0")]
    # a path has a beginning: a ring of unary nodes would be a text without one
    while not moving.isEmpty():
        far = at.select("lang", F.col("edge").alias("root"), F.col("root").alias("farther"), F.col("back").alias("more"))
        joined = stored(moving.join(far, ["lang", "root"]))
        ended = joined.filter("more = 0").select("lang", "edge", "a", "root", "back")
        moving = joined.filter("more > 0").select("lang", "edge", "a", F.col("farther").alias("root"), (F.col("back") + F.col("more")).alias("back"))
        done.append(ended)
        at = done[0]
        for d in done[1:]:
            at = at.unionByName(d)
        at = at.unionByName(moving)
    stretch = at.groupBy("lang", "root", F.floor(F.col("back") / STRETCH).alias("k")).agg(
        F.max("a").alias("a"), F.sort_array(F.collect_list(F.struct("back", "edge"))).alias("e"))
    words = F.concat(F.split(F.col("e")[0]["edge"], " "), F.transform(F.slice("e", 2, STRETCH), lambda e: F.substring_index(e["edge"], " ", -1)))
    return stretch.select("lang", words.alias("words"), "a")


def _windows(words: Column, k: int) -> Column:
    last = F.size(words) - k + 1
    return F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(words, i, k), " "))


def _product(factor: int, c: str) -> Column:
    return F.lit(factor).cast("decimal(10,0)") * F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language of ``docs (text, lang)``.

    Null text is empty, null lang is ``und``.  Repeated rows count as often as
    they occur.  Equal scores go to the greater count, then to the phrase
    earlier in byte order.  Languages without candidates, and empty tables,
    give no rows.  Further columns are ignored.
    """
    counted = stored(counts(docs, least))
    phrases = counted.filter("size > 0").select("lang", "phrase", "a")
    candidates = counted.filter("size > 1")
    covered = paths(counted).select("lang", "a", F.explode(F.flatten(F.array(*[_windows(F.col("words"), k) for k in range(2, LONGEST)]))).alias("phrase"))
    for size in range(3, LONGEST):
        words = F.split("phrase", " ")
        shorter = F.flatten(F.array(*[_windows(words, k) for k in range(2, size)]))
        covered = covered.unionByName(candidates.filter(F.col("size") == size).select("lang", "a", F.explode(shorter).alias("phrase")))
    covered = covered.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_product(100, "longer") < _product(80, "a")))
    cut = kept.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    scored = cut.withColumn("t", _product(2_000_000, "a")).withColumn("score", F.expr("t div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of many hash groups, then the first of those: no language is sorted in one task
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = best.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    few = spread.withColumn("rank", F.row_number().over(W.partitionBy("lang", "g").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = counted.filter("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
