"""Exact p-values of the two-sample statistic against all orders of two small samples."""

import time
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import drift

from .conftest import SMALL


def brute(distance, n, m):
    """Share of the orders of n and m rows whose statistic, times n * m, is at least the distance."""
    far = total = 0
    for own in combinations(range(n + m), n):
        i = j = most = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in own else (i, j + 1)
            most = max(most, abs(i * m - j * n))
        far, total = far + (most >= distance), total + 1
    return Fraction(far, total)


@pytest.mark.parametrize("sides", [(1, 1), (3, 3), (5, 4), (2, 7), (6, 6)])
def test_paths(sides):
    n, m = sides
    for distance in range(n * m + 2):
        assert abs(1 - drift.inside_share(distance, n, m) - float(brute(distance, n, m))) < 1e-12


def test_many_rows():
    """Close to the limit for many rows, and a share at any size."""
    n = m = 3000
    z = 1.2
    series = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * z * z) for k in range(1, 40))
    assert abs(1 - drift.inside_share(round(z * np.sqrt((n + m) / (n * m)) * n * m), n, m) - series) < 0.01


def test_small_samples(spark):
    """Exact up to the limit, the series above; a feature with one side has neither."""
    rows = [("x", float(v), False) for v in (1, 2, 3, 4)] + [("x", float(v), True) for v in (3.5, 5, 6)] + [("y", 1.0, False)]
    rows += [("z", float(v), bool(v % 2)) for v in range(30)]
    df = spark.createDataFrame(rows, "feature string, value double, late boolean")
    counts = df.groupBy("feature", "value").agg(F.count_if(~F.col("late")).alias("a"), F.count_if("late").alias("b"))
    got = {r.feature: (r.ks_statistic, r.p_value) for r in drift.shift_of_counts(counts, exact_rows=10).collect()}
    assert got["x"] == pytest.approx((0.75, float(brute(9, 4, 3)))) and got["y"][0] is None
    series = {r.feature: r.p_value for r in drift.shift_of_counts(counts, exact_rows=0).collect()}
    assert got["z"][1] == series["z"] and got["x"][1] != series["x"]


def test_user_drift(spark):
    rows = entry.queries()["user_drift"](spark, SMALL).collect()
    assert len(rows) > 10 and all(0 < r.p_value <= 1 and 0 < r.ks_statistic <= 1 for r in rows)


def test_many_features_together():
    """Features of all lengths in one batch, each with its own share."""
    sides = [(n, m) for n in range(1, 7) for m in range(1, 6)]
    rows = [(d, n, m) for n, m in sides for d in range(0, n * m + 2, 3)]
    got = drift.inside_shares(*np.array(rows).T)
    for (d, n, m), share in zip(rows, got):
        assert abs(1 - share - float(brute(d, n, m))) < 1e-12
    begin = time.perf_counter()
    many = drift.inside_shares(np.arange(20_000) % 400 + 1, np.full(20_000, 40), np.full(20_000, 35))
    far = drift.inside_share(9000 * 9000, 9000, 9000)
    assert time.perf_counter() - begin < 20 and far == 1.0
    assert many[0] == drift.inside_share(1, 40, 35) and many[399] == drift.inside_share(400, 40, 35)


def test_p_values_are_spread(spark):
    """Few bytes but much work a feature: the p-values must not end up in one task."""
    rows = spark.range(4000).selectExpr("cast(id % 500 as string) as feature", "cast(id div 500 as double) as value", "id % 3 as a", "id % 2 as b")
    found = drift.shift_of_counts(rows).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
