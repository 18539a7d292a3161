"""Predictions go from points to files with one shuffle of the points."""

from __future__ import annotations

import __spark_entry__ as E
from framelake.plans import views as V
from tests.test_percentile_shuffles import shuffled

SF = "/root/testdata/sf0.001"


def test_votes_are_not_shuffled(spark):
    n = V.points(spark, SF).count()
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, -1)  # as for large tables
    try:
        moved = shuffled(spark)
        got = E.queries()["s14_prediction_sink"](spark, SF)
        moved = shuffled(spark) - moved  # of both writes, each of which reads the points
    finally:
        spark.conf.set(limit, before)
    assert got.groupBy().sum("points").first()[0] == 2 * n
    assert moved < 3 * n
