"""The fixture views again, as SQL for the comparison engine."""

from __future__ import annotations

VIEWS = {
    "points": """
  SELECT l_suppkey AS video_name,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS point_index,
    CAST(l_orderkey % 40 AS INTEGER) AS frame_order, l_quantity AS x, l_extendedprice / 1000 AS y,
    CAST(l_orderkey % 40 AS DOUBLE) AS z, l_quantity AS pixel_x, round(l_discount * 100) AS pixel_y,
    CAST(l_partkey % 256 AS INTEGER) AS intensity, CAST((l_partkey * 3) % 256 AS INTEGER) AS alpha,
    l_tax * 10 AS confidence, CAST(1 + l_partkey % 15 AS INTEGER) AS source_flags, l_partkey AS part_key,
    CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS point_label, l_returnflag <> 'A' AS valid_mask
  FROM lineitem""",
    "windows": """
  SELECT * FROM (
    SELECT video_name, CAST(k AS BIGINT) AS window_id, CAST(lo + 6 * k AS INTEGER) AS start_frame,
      CAST(least(lo + 6 * k + 11, hi) AS INTEGER) AS end_frame, lo, hi, k
    FROM (SELECT video_name, min(frame_order) AS lo, max(frame_order) AS hi FROM points GROUP BY 1) s,
      generate_series(0, 100) AS g(k)
    WHERE lo + 6 * k <= hi)
  WHERE k = 0 OR lo + 6 * (k - 1) + 11 < hi""",
    "point_windows": """
  SELECT p.*, w.window_id, w.start_frame, w.end_frame FROM points p JOIN windows w
    ON p.video_name = w.video_name AND p.frame_order BETWEEN w.start_frame AND w.end_frame""",
    "window_probs": """
  SELECT pw.*, c.checkpoint, ((part_key * c.m + window_id * 13) % 101) / 100.0::DOUBLE AS p1,
    1 - ((part_key * c.m + window_id * 13) % 101) / 100.0::DOUBLE AS p0
  FROM point_windows pw, (VALUES ('ckpt_a', 7), ('ckpt_b', 11)) AS c(checkpoint, m)""",
    "votes": """
  SELECT checkpoint, video_name, point_index, any_value(point_label) AS point_label, any_value(valid_mask) AS valid_mask,
    avg(p1) AS prob, count(*) AS vote_count, CASE WHEN avg(p1) > avg(p0) THEN 1 ELSE 0 END AS pred_label
  FROM (SELECT * REPLACE (round(p1, 9) AS p1, round(p0, 9) AS p0) FROM window_probs) GROUP BY 1, 2, 3""",
    "boxes": """
  SELECT CAST(floor(p_partkey / 20.0) AS BIGINT) AS video_name, CAST((p_partkey % 20) % 15 AS INTEGER) AS frame_order,
    CAST(floor((p_partkey % 20) / 15.0) AS INTEGER) AS bbox_index, p_brand AS object_name,
    CAST(p_size % 25 AS DOUBLE) AS xmin, CAST(p_partkey % 5 AS DOUBLE) AS ymin,
    CAST(p_size % 25 + 10 AS DOUBLE) AS xmax, CAST(p_partkey % 5 + 4 AS DOUBLE) AS ymax, p_size % 7 <> 0 AS valid,
    p_size AS size, p_retailprice AS price
  FROM part""",
    "frames": """
  SELECT user_id AS video_name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_order,
    event_id AS frame_index, event_type AS source, value, ts
  FROM events""",
    "pose6": """
  SELECT label AS video_name, frame_order, {cols} FROM (
    SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_order,
      list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)""".format(cols=", ".join(
        [f"e[{1 + i}] AS a{i}" if i < 2 else "e[3] + frame_order * 0.1::DOUBLE AS a2" if i == 2 else f"e[{1 + i}] * 90 AS a{i}" for i in range(6)]
        + [f"e[{7 + i}] AS b{i}" if i < 2 else "e[9] + frame_order * 0.1::DOUBLE AS b2" if i == 2 else f"e[{7 + i}] * 90 AS b{i}" for i in range(6)])),
    "video_split": """
  SELECT s_suppkey AS video_name, CASE WHEN s_suppkey % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM supplier""",
    "method_scores": """
  SELECT o_custkey AS sweep_id, o_orderpriority AS method, round(avg(o_totalprice), 6) AS metric FROM orders GROUP BY 1, 2""",
    "cells": """
  SELECT video_name, frame_order, CAST(pixel_x AS INTEGER) AS x, CAST(pixel_y AS INTEGER) AS y, max(intensity) AS value
  FROM points GROUP BY 1, 2, 3, 4""",
}


def _matrix(p: str) -> str:
    """Twelve matrix columns from the six numbers of a pose."""
    sa, ca = f"sin(radians({p}3))", f"cos(radians({p}3))"
    sb, cb = f"sin(radians({p}4))", f"cos(radians({p}4))"
    sc, cc = f"sin(radians({p}5))", f"cos(radians({p}5))"
    rows = [
        [f"{cc}*{cb}", f"{cc}*{sb}*{sa}-{sc}*{ca}", f"{cc}*{sb}*{ca}+{sc}*{sa}", f"{p}0"],
        [f"{sc}*{cb}", f"{sc}*{sb}*{sa}+{cc}*{ca}", f"{sc}*{sb}*{ca}-{cc}*{sa}", f"{p}1"],
        [f"-{sb}", f"{cb}*{sa}", f"{cb}*{ca}", f"{p}2"],
    ]
    return ", ".join(f"{e} AS {p}m{r}{c}" for r, row in enumerate(rows) for c, e in enumerate(row))


VIEWS["poses"] = f"\n  SELECT video_name, frame_order, {_matrix('a')}, {_matrix('b')} FROM pose6"

NEEDS = {
    "windows": ["points"], "point_windows": ["points", "windows"], "window_probs": ["point_windows"],
    "votes": ["window_probs"], "poses": ["pose6"], "cells": ["points"],
}


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the views it needs, in dependency order."""
    done: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, []):
            add(d)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    body = body.strip()
    if not done:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in done)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
