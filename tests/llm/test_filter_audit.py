"""Survival words against plain loops."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from framelake.llm import filter_audit as fa

LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, LONG, None), (None, LONG, "a"), (None, LONG, "a"), (4, None, ""), (5, "", "a"), (6, "w " * 70, "a"), (7, LONG + " # AAAAAAAAAAAAAAAAAAAAAAAA", "b"),
    (8, LONG + " # AAAAAAAAAAAAAAAAAAAAAAAA", "b"), (9, "x" * 100_000, "b"), (10, "É\x0bÉ\x1c é " * 40, "c"), (None, None, None), (11, LONG + "|", "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (7, None, 1), (8, 1, None), (99, 1, 1), (None, 1, 1), (5, 0, 1), (6, 1, 0)]


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text))]


def brute(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, bad = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(p or "", [*failures(t or ""), i is not None and i > least[t or ""]], i in good, i in bad) for i, t, p in docs]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, x in enumerate(order, 1):
                k = "ABCDE".index(x)
                gone = [r for r in left if r[1][k]]
                fails = sum(r[1][k] for r in rows if r[0] == part)
                left = [r for r in left if not r[1][k]]
                only = sum(r[1][k] and sum(r[1]) == 1 for r in rows if r[0] == part)
                shapley[part, x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def test_carry_save_counts_equal_plain_counts():
    rng = np.random.default_rng(3)
    words, group = rng.integers(0, 1 << 32, 500, np.uint32), rng.integers(0, 7, 500)
    times = np.where(rng.random(500) < 0.02, 10 ** 12 + 5, rng.integers(1, 9, 500))
    want = np.zeros((7, 32), np.int64)
    for w, t, g in zip(words.tolist(), times.tolist(), group.tolist()):
        want[g] += [t * (w >> b & 1) for b in range(32)]
    assert (fa.positional_counts(words, times, group, 7) == want).all()
    assert not fa.positional_counts(words[:0], times[:0], group[:0], 3).any()


def test_audit_against_plain_loops(spark):
    docs = spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in DOCS], "doc_id bigint, text string, source string, n int, mask int, label string")
    labels = spark.createDataFrame([(*r, 5) for r in LABELS], "doc_id bigint, quality int, toxic int, salt int")
    got = fa.audit(docs, labels).collect()
    want = brute(DOCS, LABELS)
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("labelled", [True, False])
def test_audit_of_empty_tables(spark, labelled):
    docs = spark.createDataFrame(DOCS[:0], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame(LABELS if labelled else [], "doc_id bigint, quality int, toxic int")
    assert fa.audit(docs, labels).count() == 0
