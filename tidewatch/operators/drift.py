"""Feature drift, performance degradation and the retraining decision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DriftSettings
from ..session import side_by_side
from .evaluate import confusion, rates
from .rolling import trend
from .running import running_sums, unpivot, value_chunks


def two_sample_counts(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, a, b): how often each value occurs in the reference and in the current rows."""
    both = unpivot(reference, [], features).withColumn("_cur", F.lit(False)).unionByName(
        unpivot(current, [], features).withColumn("_cur", F.lit(True)))
    return both.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(~F.col("_cur")).alias("a"), F.count_if("_cur").alias("b"))


#: Up to so many rows on the larger side the p-value is exact, above it is the limit for many.
EXACT_ROWS = 10_000


#: Points of a lattice diagonal that one numpy step computes at most, over several features.
DIAGONAL_POINTS = 1 << 16


def inside_shares(distances: np.ndarray, ns: np.ndarray, ms: np.ndarray) -> np.ndarray:
    """The shares of the lattice paths from (0, 0) to (n, m) on which |i * m - j * n| stays below `distance`.

    Each diagonal of the lattice follows from the one before; a point's share is that of the paths up to it. Only the
    band around the straight line is held, and features of alike width and length go through the diagonals together.
    Where the statistic is so large that at most 4 exp(-z^2) < 1e-19 of the paths leave the band (the sum of the
    bounds of Dvoretzky, Kiefer, Wolfowitz and Massart for both sides), the share is 1.
    """
    d, n, m = (np.asarray(x, dtype=np.int64) for x in (distances, ns, ms))
    out = (d > 0).astype(float)
    far = d.astype(float) ** 2 > 45.0 * n * m * (n + m).astype(float)
    width = np.maximum(1, np.minimum(np.minimum(n, m) + 1, -(-2 * d // np.maximum(n + m, 1))))
    order = np.lexsort((-(n + m), -np.ceil(np.log2(width))))
    order = order[((d > 0) & ~far)[order]]
    while len(order):
        size = max(1, DIAGONAL_POINTS // int(width[order[0]]))
        rows, order = order[:size], order[size:]
        out[rows] = _band(d[rows], n[rows], m[rows], int(width[rows].max()))
    return out


def _band(d: np.ndarray, n: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    total, result = n + m, np.zeros(len(d))
    live = np.argsort(-total, kind="stable")
    d, n, m, total = d[live], n[live], m[live], total[live]
    share = np.zeros((len(d), width + 2))  # with an empty point on either side; column c is i = low + c - 1
    share[:, 1] = 1.0
    low, place = np.zeros(len(d), dtype=np.int64), np.arange(width)
    for k in range(1, int(total[0]) + 1 if len(d) else 0):
        if total[-1] < k:  # the shortest are done
            done = int(np.searchsorted(-total, -k, side="right"))
            d, n, m, total, live, low, share = (x[:done] for x in (d, n, m, total, live, low, share))
        start = np.maximum(np.maximum(0, k - m), (k * n - d) // total + 1)
        end = np.minimum(np.minimum(n, k), (k * n + d - 1) // total)
        moved = (start > low)[:, None]
        i = start[:, None] + place
        before, same = np.where(moved, share[:, 1:-1], share[:, :-2]), np.where(moved, share[:, 2:], share[:, 1:-1])
        now = before * (i / k) + same * ((k - i) / k)
        share[:, 1:-1] = np.where(i <= end[:, None], now, 0.0)
        low = start
        ends = int(np.searchsorted(-total, -k, side="left"))  # these end on this diagonal
        if ends < len(total):
            at = n[ends:] - low[ends:]
            hit = (at >= 0) & (at < width)
            result[live[ends:]] = np.where(hit, share[np.arange(ends, len(total)), np.where(hit, at, 0) + 1], 0.0)
    return result


def inside_share(distance: int, n: int, m: int) -> float:
    """`inside_shares` of one feature."""
    return float(inside_shares(np.array([distance]), np.array([n]), np.array([m]))[0])


@F.pandas_udf(T.DoubleType())
def exact_p_value(statistic: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Chance of a two-sample statistic at least as large where both sides have one distribution without ties."""
    n, m = n.to_numpy().astype(np.int64), m.to_numpy().astype(np.int64)
    distances = np.rint(statistic.to_numpy() * n * m).astype(np.int64)
    return pd.Series(np.clip(1.0 - inside_shares(distances, n, m), 0.0, 1.0))


def p_value(statistic: Column, n: Column, m: Column, terms: int = 60) -> Column:
    """Asymptotic Kolmogorov distribution of the two-sample statistic (accurate for large samples)."""
    z = F.sqrt(n * m / (n + m)) * statistic
    k = F.sequence(F.lit(1), F.lit(terms))
    series = F.reduce(k, F.lit(0.0), lambda acc, i: acc + F.pow(F.lit(-1.0), i - 1) * F.exp(-2.0 * i * i * z * z))
    return F.when(z < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def covariate_shift(reference: DataFrame, current: DataFrame, features: list[str],
                    s: DriftSettings = DriftSettings(), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """KS statistic, p-value, Wasserstein distance and severity per feature."""
    return shift_of_counts(two_sample_counts(reference, current, features), s, exact_rows)


def shift_of_counts(two_samples: DataFrame, s: DriftSettings = DriftSettings(), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """`covariate_shift` from (feature, value, a, b); with rows on one side only a feature has no statistic.

    The p-value is exact for features with at most `exact_rows` rows on each side: one row a feature goes through
    Python, whole batches at a time, spread over the shuffle's partitions. For larger ones it is the asymptotic series.
    """
    counts = value_chunks(two_samples, ["feature"], "value")
    ranked = running_sums(counts, ["feature"], "value", ["a", "b"])
    # The value after this one: the next in the chunk, or the smallest of the following chunk.
    heads = counts.groupBy("feature", "_chunk").agg(F.min("value").alias("_head"))
    follow = heads.select("feature", "_chunk", F.lead("_head").over(Window.partitionBy("feature").orderBy("_chunk")).alias("_next"))
    inside = Window.partitionBy("feature", "_chunk").orderBy("value")
    rows = ranked.withColumn("_lead", F.lead("value").over(inside)).join(follow, ["feature", "_chunk"])
    gap = F.coalesce(F.coalesce("_lead", "_next") - F.col("value"), F.lit(0.0))
    distance = F.abs(F.try_divide("cum_a", "all_a") - F.try_divide("cum_b", "all_b"))
    out = rows.groupBy("feature").agg(
        F.max(distance).alias("ks_statistic"), F.sum(distance * gap).alias("wasserstein"),
        F.max("all_a").cast("double").alias("_n"), F.max("all_b").cast("double").alias("_m"))
    series = p_value(F.col("ks_statistic"), F.col("_n"), F.col("_m"))
    if exact_rows:  # both branches of a Python function are computed, so other features go in as empty ones
        few = (F.greatest("_n", "_m") <= exact_rows) & (F.least("_n", "_m") > 0)
        own = [F.when(few, F.col(c)).otherwise(F.lit(0.0)) for c in ("ks_statistic", "_n", "_m")]
        # Few bytes, much work: Spark would put all features in one task. By "feature" alone they are dealt already, and
        # the step would be left out.
        out = out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("feature"))
        series = F.when(few, exact_p_value(*own)).otherwise(series)
    return out.select("feature", "ks_statistic", series.alias("p_value"), "wasserstein", (F.col("ks_statistic") > s.ks_threshold).alias("drifted"),
                      drift_severity(F.col("ks_statistic"), s).alias("severity"))


def drift_severity(ks: Column, s: DriftSettings = DriftSettings()) -> Column:
    return F.when(ks < s.low, "low").when(ks < s.medium, "medium").when(ks.isNotNull(), "high")


def degradation(current: DataFrame, reference: DataFrame, s: DriftSettings = DriftSettings()) -> DataFrame:
    """Change of each metric against its reference; metrics missing on either side are skipped."""
    joined = current.select("metric_name", F.col("value").alias("current_value")).join(
        reference.select("metric_name", F.col("value").alias("reference_value")), "metric_name").dropna()
    change = F.col("current_value") - F.col("reference_value")
    relative = F.when(F.col("reference_value") != 0, change / F.col("reference_value")).otherwise(0.0)
    out = joined.withColumns({"absolute_change": change, "relative_change": relative})
    r = F.col("relative_change")
    level = F.when(r < s.severe, "severe").when(r < s.moderate, "moderate").when(r < s.slight, "slight").otherwise("none")
    return out.withColumns({"degraded": r < 0, "level": level})


def concept_drift(scored: DataFrame, reference: DataFrame, order: list[str], last: int = 1000,
                  s: DriftSettings = DriftSettings()) -> DataFrame:
    """Whether the error rates of the last rows moved; false when there are fewer rows than asked for."""
    recent = scored.orderBy(*[F.desc(c) for c in order]).limit(last)
    cur = rates(confusion(recent)).select((F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
                                          F.col("fpr").alias("current_fpr"), F.col("fnr").alias("current_fnr"))
    ref = rates(confusion(reference)).select(F.col("fpr").alias("reference_fpr"), F.col("fnr").alias("reference_fnr"))
    both = side_by_side(cur, ref)
    moved = ((F.abs(F.col("current_fpr") - F.col("reference_fpr")) > s.error_rate_change)
             | (F.abs(F.col("current_fnr") - F.col("reference_fnr")) > s.error_rate_change))
    return both.withColumn("drift", (F.col("rows") >= last) & moved)


def _recent(checks: DataFrame, n: int) -> DataFrame:
    """Rows of the latest n batches; checks are one row per batch and feature or metric."""
    ids = checks.select("batch").distinct().orderBy(F.desc("batch")).limit(n)
    return checks.join(F.broadcast(ids), "batch", "left_semi")  # at most n rows


def should_retrain(drift_checks: DataFrame, performance: DataFrame, reference_accuracy: float,
                   s: DriftSettings = DriftSettings()) -> DataFrame:
    """Decision from (batch, feature, drifted) and (batch, accuracy) histories."""
    drift = _recent(drift_checks, s.last_checks).agg(
        F.coalesce(F.count_if("drifted") / F.count("*"), F.lit(0.0)).alias("drift_ratio"))
    accuracy = _recent(performance, s.last_checks).agg(F.avg("accuracy").alias("recent_accuracy"))
    drop = ((F.lit(reference_accuracy) - F.col("recent_accuracy")) / reference_accuracy if reference_accuracy > 0 else F.lit(0.0))
    both = side_by_side(drift, accuracy).withColumn("accuracy_drop", F.coalesce(drop, F.lit(0.0)))
    return both.withColumn("retrain", (F.col("drift_ratio") > s.retrain_ratio) | (F.col("accuracy_drop") > s.retrain_ratio))


def drift_summary(drift_checks: DataFrame) -> DataFrame:
    """Number of checks and the share with at least one drifted feature."""
    per_batch = drift_checks.groupBy("batch").agg(F.bool_or("drifted").alias("d"))
    return per_batch.agg(F.count("*").alias("checks"), F.coalesce(F.bool_or("d"), F.lit(False)).alias("drift_detected"),
                         F.coalesce(F.count_if("d") / F.count("*"), F.lit(0.0)).alias("drift_frequency"))


def performance_summary(performance: DataFrame, s: DriftSettings = DriftSettings()) -> DataFrame:
    """Checks, current accuracy, mean and trend of the last checks."""
    total = performance.agg(F.count("*").alias("checks"))
    recent = _recent(performance, s.last_checks)
    now = recent.agg(F.max_by("accuracy", "batch").alias("current_accuracy"), F.avg("accuracy").alias("mean_accuracy"))
    direction = trend(recent, [], "batch", "accuracy", settings=s).select("slope", "trend")
    return side_by_side(total, now, direction)


def reference_snapshot(features: DataFrame, names: list[str], metrics: DataFrame, path: str) -> None:
    """Reference rows and metrics as tables for later comparisons."""
    features.select(*names).write.mode("overwrite").parquet(f"{path}/features")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
