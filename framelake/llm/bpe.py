"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is cut at white space; every piece between is normalised, split into
words and merged.  Inside a word the leaves of a minimum tree hold the rank of
each adjacent pair, joined with its place, so the root is the leftmost pair of
lowest rank; a merge changes three leaves and their paths.  The vocabulary
file says everything else.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Pieces and words that a worker remembers, twice: results do not depend on it.
PIECES, WORDS = 400_000, 300_000
LONG = 64  # longer ones are made anew each time, so that what is remembered has a bound
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() cuts here, the vocabulary's \s does not


def cut_at_space(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Recent(dict):
    """What ``make`` gives for each key.  A full memory becomes the old one, from which asked keys return."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(key) > LONG:
            return self.make(key)
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Bpe:
    """Encoder and decoder of one vocabulary file (word-end BPE over bytes)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.none = 1 << 62
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # pair of ids -> (rank, id of the merged token), packed
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.known = Recent(self.word, WORDS)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge until no adjacent pair has a rank.

        ``node`` is the segment tree: leaf ``i`` is the pair that starts at
        ``i``, as rank * n + i, and every inner node the minimum of its two.
        """
        n, find, none = len(ids), self.merges.get, self.none
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length()
        node, into = [none] * (2 * size), [0] * n
        for i in range(n - 1):
            m = find(ids[i] << 32 | ids[i + 1])
            if m:
                node[size + i], into[i] = m[0] * n + i, m[1]
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b
        if node[1] == none:
            return ids
        right, left = list(range(1, n + 1)), list(range(-1, n))
        while (low := node[1]) < none:
            i = low % n
            j = right[i]
            k = right[i] = right[j]
            new = ids[i] = into[i]
            ids[j], left[k] = -1, i
            # three leaves change: the pair swallowed, the merged pair's own and the one before
            if k < n:
                m = find(new << 32 | ids[k])
                value = none
                if m:
                    value, into[i] = m[0] * n + i, m[1]
                node[size + j] = none
                at = size + j >> 1
                while at:
                    a, b = node[2 * at], node[2 * at + 1]
                    node[at] = a if a < b else b
                    at >>= 1
            else:
                value = none
            node[size + i] = value
            at = size + i >> 1
            while at:
                a, b = node[2 * at], node[2 * at + 1]
                node[at] = a if a < b else b
                at >>= 1
            p = left[i]
            if p >= 0:
                m = find(ids[p] << 32 | new)
                value = none
                if m:
                    value, into[p] = m[0] * n + p, m[1]
                if node[size + p] != value:
                    node[size + p] = value
                    at = size + p >> 1
                    while at:
                        a, b = node[2 * at], node[2 * at + 1]
                        node[at] = a if a < b else b
                        at >>= 1
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        return self.merge(ids)

    def parts(self, piece: str) -> Iterator[str | int]:
        """Words of a piece without white space, normalised, and the ids of special tokens between them."""
        for i, part in enumerate(self.cut.split(piece)) if self.cut else [(0, piece)]:
            if i % 2:
                yield self.special[part]
            elif part:
                # the vocabulary lowers letter by letter, without the final form of sigma
                yield from self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def piece(self, piece: str) -> list[int]:
        """Ids of a piece without white space."""
        out: list[int] = []
        for w in self.parts(piece):
            if isinstance(w, int):
                out.append(w)
            else:
                out += self.known[w]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for p in cut_at_space(text or "") for i in self.piece(p)]

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b["text"].to_pylist()]
            yield pa.record_batch({"doc_id": b["doc_id"], "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([bpe.decode(i) for i in ids], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, _with_id(docs, "ids array<int>, decoded string"))


def _with_id(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {rest}"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, empty for null.

    Pieces repeat, so a worker keeps each piece's ids and decoded text as they
    appear in the digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)

        def fresh(p: str) -> tuple[int, str, str]:
            ids = bpe.piece(p)
            return len(ids), " ".join(map(str, ids)), bpe.decode(ids)

        seen = Recent(fresh, PIECES)

        def sha(parts: list[str]) -> str:
            return hashlib.sha256(" ".join(parts).encode("utf-8")).hexdigest()

        for b in batches:
            counts, ids, texts = [], [], []
            for t in b["text"].to_pylist():
                got = [seen[p] for p in cut_at_space(t or "")]
                n = [g[0] for g in got]
                if 0 in n:
                    got = [g for g in got if g[0]]
                counts.append(sum(n))
                ids.append(sha([g[1] for g in got]))
                texts.append(sha([g[2] for g in got]))
            yield pa.record_batch({"doc_id": b["doc_id"], "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(texts, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, _with_id(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
