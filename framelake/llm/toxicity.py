"""Toxicity by weak supervision.

Many weak voters look at a text: a stated lexicon, and words and word
beginnings whose presence goes with toxic training labels beyond chance.  A
generative label model estimates how accurate each voter is and how strongly
voters depend on each other, and turns their votes into posterior labels.  A
linear classifier is trained on those posteriors and scores every text.

Everything is fitted on a bounded sample of labelled rows (``SAMPLE``); every
document is scored, from its whole text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .bpe import Recent
from .common import stored

# The lexicon.
LEXICON = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
SAMPLE = 20_000   # labelled rows the model is fitted on, the first in the order of a hash
VOTERS = 300      # mined voters, the least likely by chance first
BEGINNINGS = (3, 4, 5, 6)
BURST = 3         # different words with one beginning that make its voter vote
DOUBT = 0.05      # chance that any sign of a family (words, beginnings) is mined though it says nothing
ANCHOR = 0.98     # accuracy of the labels themselves
_REMEMBERED = 200_000
_FLUSH = 200_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def signs(text: str | None) -> set[str]:
    """What a voter can stand for: every word, and ``beginning*`` where several words of the text share it."""
    words = set(words_of(text))
    starts = Counter(w[:k] for w in words for k in BEGINNINGS if len(w) >= k)
    return words | {f"{p}*" for p, n in starts.items() if n >= BURST}


class Signals:
    """How strongly each voter's sign shows in a text: log of one more than its words."""

    def __init__(self, voters: list[str]):
        self.word = {v: i for i, v in enumerate(voters) if not v.endswith("*")}
        self.start = {v[:-1]: i for i, v in enumerate(voters) if v.endswith("*")}
        self.known = Recent(self._look, _REMEMBERED)

    def _look(self, piece: str) -> tuple:
        out = []
        for w in words_of(piece):
            if w in self.word:
                out.append((w, self.word[w]))
            out += [(w, self.start[w[:k]]) for k in BEGINNINGS if len(w) >= k and w[:k] in self.start]
        return tuple(out)

    def counts(self, text: str | None) -> dict[int, int]:
        """Voter -> different words of the text that carry its sign; words of the lexicon kind count once each."""
        known, seen = self.known, set()
        for piece in set((text or "").split()):
            if got := known[piece]:
                seen.update(got)
        return Counter(i for _, i in seen)


def chance(k: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Log of a bound on the chance of at least ``k`` toxic among ``n`` rows at the base rate (Chernoff)."""
    share = np.clip(k / n, 1e-9, 1 - 1e-9)
    kl = share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate))
    return np.where(share > rate, -n * kl, 0.0)


def mined(sample: DataFrame, rate: float) -> list[str]:
    """Signs that go with toxic labels beyond chance, corrected for how many of their family were looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = pa.record_batch({"sign": pa.array(list(seen), pa.string()), "toxic": pa.array([x[0] for x in seen.values()], pa.int64()), "n": pa.array([x[1] for x in seen.values()], pa.int64())})
            seen.clear()
            return rows

        for b in batches:
            for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                for s in signs(t):
                    got = seen.setdefault(s, [0, 0])
                    got[0] += y
                    got[1] += 1
                if len(seen) > _FLUSH:
                    yield out()
        yield out()

    table = stored(sample.select("text", "toxic").mapInArrow(run, "sign string, toxic bigint, n bigint").groupBy("sign").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).filter("toxic >= 3"))
    family = F.col("sign").endswith("*")
    tried = {r["f"]: r["n"] for r in table.groupBy(family.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = table.filter(F.col("toxic") >= F.col("n") * 0.5).orderBy(F.desc("toxic"), "n", "sign").limit(20 * VOTERS).collect()
    if not rows:
        return []
    p = chance(np.array([r["toxic"] for r in rows]), np.array([r["n"] for r in rows]), rate)
    order = sorted(range(len(rows)), key=lambda i: (p[i], rows[i]["sign"]))
    return [rows[i]["sign"] for i in order if p[i] < np.log(DOUBT / tried[rows[i]["sign"].endswith("*")])][:VOTERS]


def label_model(votes: np.ndarray, prior: float, anchored: int = 0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 and voters' accuracies from votes in {-1, 0, 1} (rows x voters, 0 abstains).

    Expectation and maximisation in turn.  A voter's evidence is divided by
    how much it is correlated, inside the classes, with others, so that copies
    of one opinion count about once.  The last ``anchored`` voters keep the
    stated accuracy ``ANCHOR`` and full weight, so that the classes stay those
    that they mean and do not drift to whatever many voters agree on.
    """
    n, m = votes.shape
    accuracy, weight, post = np.full(m, 0.8), np.ones(m), np.full(n, prior)
    cast = np.abs(votes)
    base = np.log(prior / (1 - prior))
    fixed = np.arange(m) >= m - anchored
    accuracy[fixed] = ANCHOR
    for step in range(rounds):
        odds = base + votes @ (weight * np.log(accuracy / (1 - accuracy)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if step and np.abs(new - post).max() < 1e-6:
            break
        post = new
        right = np.where(votes > 0, post[:, None], 1 - post[:, None]) * cast
        accuracy = np.where(fixed, ANCHOR, np.clip((right.sum(0) + 4) / (cast.sum(0) + 5), 0.55, 0.999))
        residual = votes - np.outer(post, (votes * post[:, None]).sum(0) / max(post.sum(), 1e-9)) - np.outer(1 - post, (votes * (1 - post)[:, None]).sum(0) / max((1 - post).sum(), 1e-9))
        cov = residual.T @ residual / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(rho, 1)
        weight = np.where(fixed, 1, 1 / np.where(rho > 0.3, rho, 0).sum(1).clip(min=1))
    return post, accuracy


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray  # one per voter, one for the number of different signs, one for any vote, the bias
    accuracy: np.ndarray


def features(counts: dict[int, int], least: list[int]) -> np.ndarray:
    """Strength of each sign, how many signs, and whether any is strong enough (``least`` words) for a vote."""
    x = np.zeros(len(least) + 2)
    for i, n in counts.items():
        x[i] = np.log1p(n)
    x[-2] = np.log1p(len(counts))
    x[-1] = any(n >= least[i] for i, n in counts.items())
    return x


def needed(voters: list[str]) -> list[int]:
    return [BURST if v.endswith("*") else 1 for v in voters]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``labels (doc_id, toxic)`` that may be learned from; rows without id or label are left out.

    Without both classes the lexicon alone decides.  An id with several labels
    is toxic if one of them says so.
    """
    chosen = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most `sample` rows of two numbers
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(stored(chosen)), "doc_id").dropDuplicates(["doc_id"]))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = got["n"], got["t"] or 0
    if not 0 < toxic < n:
        return Model(LEXICON, np.array([0.0] * (len(LEXICON) + 1) + [6.0, -3.0]), np.full(len(LEXICON), 0.9))
    rate = toxic / n
    voters = LEXICON + [v for v in mined(rows, rate) if v not in LEXICON]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Signals(voters)
        for b in batches:
            got = [s.counts(t) for t in b["text"].to_pylist()]
            yield pa.record_batch({"toxic": b["toxic"], "at": pa.array([list(g) for g in got], pa.list_(pa.int32())), "n": pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))})

    seen = [(r["toxic"], dict(zip(r["at"], r["n"]))) for r in rows.select("toxic", "text").mapInArrow(look, "toxic int, at array<int>, n array<int>").collect()]
    y, m = np.array([t for t, _ in seen], float), len(voters)
    least = needed(voters)
    x = np.zeros((len(seen), m + 2))
    fires = np.zeros((len(seen), m))
    for r, (_, c) in enumerate(seen):
        x[r] = features(c, least)
        for i, k in c.items():
            fires[r, i] = k >= least[i]
    # two more voters: silence of all others speaks for a clean text, and the label itself
    silence, label = -(fires.sum(1) == 0).astype(float), 2 * y - 1
    post, accuracy = label_model(np.column_stack([fires, silence, label]), min(max(rate, 0.01), 0.99), anchored=1)
    return Model(voters, logistic(x, post), accuracy)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``score``, the chance that the whole text is toxic; null texts are empty."""
    voters, weights = model.voters, model.weights
    base = 1 / (1 + np.exp(-weights[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, least = Signals(voters), needed(voters)
        for b in batches:
            out = np.full(b.num_rows, base)
            for r, t in enumerate(b["text"].to_pylist()):
                if c := s.counts(t):
                    out[r] = 1 / (1 + np.exp(-np.clip(features(c, least) @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.record_batch([*b.columns, pa.array(out)], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Every fifth id by checksum of its digits; its labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return scores(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic."""
    cols = [f"_{i}" for i in range(len(docs.columns))]
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    at = docs.columns.index("text")
    renamed = docs.toDF(*cols).withColumnRenamed(cols[at], "text")
    kept = scores(renamed, model).filter("score < 0.5").drop("score")
    return kept.toDF(*docs.columns)
