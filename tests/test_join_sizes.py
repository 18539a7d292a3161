"""Join sides that grow in an explode are not broadcast, whatever Spark expects of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from framelake.operators import layout as L


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def side(text: str) -> list[str]:
    """The subtree of every broadcast, by indentation."""
    lines, out = text.splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            at = line.index("BroadcastExchange")
            end = next((j for j in range(i + 1, len(lines)) if len(lines[j]) - len(lines[j].lstrip(" :+-")) <= at - 1), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_lookup_counts_the_salted_copies(spark):
    big = spark.range(10).withColumn("k", F.col("id"))
    small = spark.range(400_000).select(F.col("id").alias("k"), F.col("id").alias("v"))  # 6 MB as it is, 16 times that with its copies
    assert "BroadcastHashJoin" not in plan(L.lookup(big, small, ["k"], F.col("id")))
    few = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("v"))
    got = L.lookup(big, few, ["k"], F.col("id"))
    assert "BroadcastHashJoin" in plan(got) and got.filter("v = k").count() == 10


@pytest.mark.parametrize("name", ["a12_box_retention", "a17_ablation_table", "a18_ablation_deltas", "a33_component_scores", "a34_largest_component", "j03_points_in_box_union",
                                  "j04_points_on_mask", "j05_labelling_policy", "q02_label_policy_audit", "q02_planted_violations", "t11_ranked_candidates"])
def test_pixels_of_boxes_are_not_broadcast(spark, name):
    text = plan(E.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "Generate explode" in text
    assert not [s for s in side(text) if "Generate explode" in s]
