"""Exploratory statistics over feature frames."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import side_by_side, small_side
from .running import exact_quantiles, unpivot


def labelled(normal: DataFrame, attack: DataFrame, label: str = "is_attack") -> DataFrame:
    """Normal and attack rows in one frame with a 0/1 label."""
    return normal.withColumn(label, F.lit(0)).unionByName(attack.withColumn(label, F.lit(1)), allowMissingColumns=True)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, in long form and both directions; one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            entries.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("r")))
    entries += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")) for c in columns]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def label_correlation(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Correlation of every feature with the label, strongest first."""
    row = df.agg(*[F.corr(c, F.col(label).cast("double")).alias(c) for c in columns])
    return unpivot(row, [], columns, value="r").orderBy(F.desc_nulls_last("r"), "feature")


def iqr_outliers(df: DataFrame, columns: list[str], multiplier: float = 1.5, label: str | None = None,
                 normal: int = 0) -> DataFrame:
    """Quartile fences per feature and the rows outside them.

    With a label the fences come from the normal rows and the rows of the other class outside them
    are counted.
    """
    long = unpivot(df, [label] if label else [], columns)
    basis = long.filter(F.col(label) == normal) if label else long
    q = exact_quantiles(basis, ["feature"], "value", [0.25, 0.75])
    spread = (F.col("q1") - F.col("q0")) * multiplier
    fences = q.select("feature", (F.col("q0") - spread).alias("lower"), (F.col("q1") + spread).alias("upper"))
    tested = long.filter(F.col(label) != normal) if label else long
    joined = tested.join(F.broadcast(fences), "feature")  # one row per feature
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return joined.groupBy("feature").agg(
        F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.count("*").alias("rows"),
        F.count_if(outside).alias("outliers")).withColumn("percent", F.col("outliers") * 100.0 / F.col("rows"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 50) -> DataFrame:
    """Equal-width density histogram per key; the last bin includes its right edge."""
    edges = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("all"))
    width = (F.col("hi") - F.col("lo")) / bins
    joined = df.join(small_side(edges), keys)
    place = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    grouped = joined.groupBy(*keys, place.cast("int").alias("bin")).agg(
        F.count("*").alias("rows"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("all").alias("all"))
    return grouped.select(*keys, "bin", "rows", (F.col("lo") + F.col("bin") * width).alias("left_edge"),
                          F.when(width > 0, F.col("rows") / (F.col("all") * width)).alias("density"))


def score_statistics(df: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, minimum, maximum and 95th percentile."""
    keys = keys or []
    base = df.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"),
                                 F.max(score).alias("max"))
    q = exact_quantiles(df, keys, score, [0.95]).withColumnRenamed("q0", "p95")
    return base.join(q, keys) if keys else side_by_side(base, q)
