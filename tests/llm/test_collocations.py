"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from framelake.llm import collocations as cl

SPLIT, WORD, LOWER = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    f = defaultdict(Counter)
    for text, lang in docs:
        for piece in SPLIT.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            f["und" if lang is None else lang].update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f


def brute(docs, least, top):
    out = []
    for lang, f in counted(docs).items():
        n, cand = sum(a for p, a in f.items() if len(p) == 1), {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def documents():
    rng = random.Random(4)
    words = ["the", "The", "of", "ÉTÉ", "été", "x\x00y", "a", " ", "b|c", "𝒳"]
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(" ".join(rng.choices(words, k=rng.randrange(40))) + rng.choice([".", "", "\n", " \t "]) + " ".join(rng.choices(words, k=9)), rng.choice(["en", "de", None, "und", ""])) for _ in range(400)]
    docs += [(passage + ".", "en")] * 9 + [("q " + passage + " q", "en")] * 4 + [("the " * 3000, "en"), ("a b " * 500, "de"), (None, "en"), ("", None), (None, None), (" \t\n.", "xx"), ("long " + "z" * 40_000, "en")]
    return docs + [("one two three", "only")] * 5 + docs[:50]


@pytest.mark.parametrize("size, least, top", [(4 << 20, 5, 2000), (3000, 3, 40), (3000, 30, 7)])
def test_collocations_against_plain_counts(spark, monkeypatch, size, least, top):
    monkeypatch.setattr(cl, "RANGE", size)
    docs = documents()
    df = spark.createDataFrame([(t, lang, 1, "x", 0) for t, lang in docs], "text string, lang string, a int, phrase string, part int").repartition(5)
    assert size > 3000 or len(cl.borders(df.selectExpr("cast(lang as binary) lang", "cast(text as binary) text").na.drop())) > 10
    got = [tuple(r) for r in cl.collocations(df, least, top).collect()]
    assert sorted(got) == brute(docs, least, top)
    assert cl.collocations(df.limit(0)).count() == 0


def test_paths_hold_every_edge_once(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "text string, lang string")
    counts = cl.stored(cl.counts(df, 3))
    want = {(lang, " ".join(p)): a for lang, f in counted(docs).items() for p, a in f.items() if len(p) == 4 and a >= 3}
    got, longest = Counter(), 0
    for r in cl.paths(counts).collect():
        longest = max(longest, len(r["words"]))
        for i in range(len(r["words"]) - 3):
            edge = (r["lang"], " ".join(r["words"][i:i + 4]))
            got[edge] += 1
            assert want[edge] == r["a"]
    assert set(got) == set(want) and max(got.values()) == 1 and longest == 60


def test_units_and_blocks_keep_counts():
    docs = [(t or "", lang or "und") for t, lang in documents()]
    old, cl.UNIT = cl.UNIT, 2000
    try:
        batch = pa.record_batch({"lang": pa.array([x.encode() for _, x in docs], pa.binary()), "text": pa.array([t.encode() for t, _ in docs], pa.binary())})
        parts = list(cl.units(iter([batch])))
    finally:
        cl.UNIT = old
    assert len(parts) > 20
    whole = cl.merged([cl.packed(g, i, j) for g in parts if len(g) for i, j in ((0, len(g) // 2), (len(g) // 2, len(g))) if i < j])
    got = Counter({whole.gram(i): int(whole.counts[i]) for i in range(len(whole))})
    grams = [whole.gram(i) for i in range(len(whole))]
    assert grams == sorted(set(grams))
    for lang, f in counted(docs).items():
        for k in range(1, 5):
            mine = Counter()
            for g, n in got.items():
                if g[0] == lang.encode() and g[k]:
                    mine[tuple(w.decode() for w in g[1:k + 1])] += n
            assert mine == Counter({p: a for p, a in f.items() if len(p) == k})
