"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import embedding_dedup as ed

SCHEMA = "vec_id bigint, embedding array<double>, label int, node int, cell string, n int"


def rows():
    rng = np.random.default_rng(5)
    centres, out = rng.normal(size=(12, 6)), []
    for i in range(700):
        out.append((i * 3, (centres[i % 12] + rng.normal(size=6) * rng.choice([0.02, 0.1, 0.5])).tolist(), int(i % 4 if i % 5 else 9)))
    hot = centres[0].tolist()
    out += [(5000 + i, hot, 0) for i in range(150)] + [(7, [1e-200 * x for x in hot], 0), (8, [1e200 * x for x in hot], 0)]
    out += [(3, hot, 0), (3, hot, 0), (3, centres[1].tolist(), 0)]
    bad = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    out += [(9000 + i, v, 0) for i, v in enumerate(bad)] + [(9100, hot, None), (None, hot, 0), (None, None, None), (9101, hot[:3], 0), (9102, hot[:3], 0), (9103, hot + [0.0], 0)]
    return out


def brute(rows):
    ok = [i for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a].add(b)
                links[b].add(a)
    least = {i: r[0] for i, r in enumerate(rows)}
    todo = list(ok)
    while todo:
        i = todo.pop()
        for j in links[i]:
            if least[i] < least[j]:
                least[j] = least[i]
                todo.append(j)
    return [(r[0], len(links[i]), least[i], r[0] == least[i]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block, sending", [(2048, 4000), (16, 0)])
def test_groups_against_all_pairs(spark, monkeypatch, block, sending):
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "SENDING", sending)
    data = rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in data], SCHEMA)
    got = [tuple(r) for r in ed.groups(df).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(data), key=key)


def test_no_link_is_lost_between_many_cells():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    x = ed.unit(np.repeat(x, 40, 0) + rng.normal(size=(1600, 5)) * 0.12)
    cells = ed.Cells(ed.fit(x, 64), 0.98)
    home, angle = cells.home(x)
    cells.reach = np.array([angle[home == c].max(initial=-np.pi) for c in range(64)])
    at = {(i, c) for i, c in enumerate(home)} | set(zip(*cells.guests(x, home)))
    near = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    assert len(near) > 1000 and any(home[a] != home[b] for a, b in near)
    assert all((a, home[b]) in at or (b, home[a]) in at for a, b in near)
    assert len(at) < 0.2 * 1600 * 64


def test_empty_table_and_only_unusable_rows(spark):
    df = spark.createDataFrame([(1, None, 2), (2, [0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert ed.groups(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in ed.groups(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert ed.groups(df.withColumn("label", F.lit(None).cast("int"))).filter("kept").count() == 2
