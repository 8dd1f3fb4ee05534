"""Votes of several detectors and the strategies that turn them into one verdict per window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EnsembleSettings
from .detect import top_addresses

KEYS = ["window_size", "window_start"]
VERDICT = ["attack_type", "confidence", "severity", "affected_ips"]

# Severity order of the consensus strategy.
VOTE_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def threshold_votes(alerts: DataFrame) -> DataFrame:
    return alerts.select(*KEYS, F.lit("threshold").alias("detector"), "attack_type", "confidence", "severity",
                         "affected_ips")


def ml_votes(scored: DataFrame) -> DataFrame:
    """Votes from rows with `ml_is_attack` and `ml_confidence`."""
    attack = scored.filter(F.col("ml_is_attack") & (F.col("ml_confidence") > 0.5))
    kind = F.coalesce("ml_attack_type", F.lit("ddos_ml")) if "ml_attack_type" in scored.columns else F.lit("ddos_ml")
    return attack.select(
        *KEYS, F.lit("ml").alias("detector"), kind.alias("attack_type"), F.col("ml_confidence").alias("confidence"),
        F.when(F.col("ml_confidence") > 0.8, "high").otherwise("medium").alias("severity"),
        F.array().cast("array<string>").alias("affected_ips"))


def entropy_votes(features: DataFrame, s: EnsembleSettings = EnsembleSettings()) -> DataFrame:
    e = F.col("entropy_src_ip")
    return features.filter(e < s.entropy_limit).select(
        *KEYS, F.lit("entropy").alias("detector"), F.lit("low_entropy_attack").alias("attack_type"),
        F.least(F.lit(0.9), 1 - e / s.entropy_limit).alias("confidence"), F.lit("medium").alias("severity"),
        top_addresses(features, "dst").alias("affected_ips"))


# A detector is any function from window features to vote rows.
Detector = Callable[[DataFrame], DataFrame]


def collect_votes(*votes: DataFrame) -> DataFrame:
    """All votes of a window in one array: threshold rules first, then ml, then entropy.

    A window has at most one vote per detector rule, so the arrays stay short.
    """
    rows = votes[0]
    for other in votes[1:]:
        rows = rows.unionByName(other)
    order = F.when(F.col("detector") == "threshold", 0).when(F.col("detector") == "ml", 1).otherwise(2)
    vote = F.struct(order.alias("o"), F.col("attack_type"), "confidence", "severity", "detector", "affected_ips")
    return rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(vote)).alias("votes"))


def _best(votes: Column) -> Column:
    """Most confident vote, the first one on a tie."""
    return F.reduce(votes, votes[0], lambda a, v: F.when(v["confidence"] > a["confidence"], v).otherwise(a))


def _emit(df: DataFrame, method: str, attack: Column, confidence: Column, severity: Column, ips: Column,
          gate: Column, s: EnsembleSettings) -> DataFrame:
    out = df.filter(gate).select(
        *KEYS, F.lit(method).alias("method"), attack.alias("attack_type"), confidence.alias("confidence"),
        severity.alias("severity"), ips.alias("affected_ips"), F.size("votes").alias("total_votes"))
    return out.filter(F.col("confidence") >= s.min_confidence)


def weighted(votes: DataFrame, s: EnsembleSettings = EnsembleSettings()) -> DataFrame:
    """The attack type with the largest weighted confidence; its best vote supplies the details."""
    weight = F.lit(s.other_weight)
    for detector, w in s.weights.items():
        weight = F.when(F.col("v.detector") == detector, w).otherwise(weight)
    exploded = votes.select(*KEYS, F.size("votes").alias("n"), F.posexplode("votes").alias("i", "v"))
    per_type = exploded.groupBy(*KEYS, "n", F.col("v.attack_type").alias("attack_type")).agg(
        F.sum(F.col("v.confidence") * weight).alias("score"), F.min("i").alias("first"),
        F.max_by("v", F.struct("v.confidence", -F.col("i"))).alias("best"))
    winner = per_type.groupBy(*KEYS, "n").agg(
        F.max_by("best", F.struct(F.round("score", 12), -F.col("first"))).alias("b"))
    raw = F.col("b.confidence")
    return winner.filter(raw >= s.min_confidence).select(
        *KEYS, F.lit("weighted").alias("method"), F.col("b.attack_type").alias("attack_type"),
        F.least(F.lit(0.95), raw).alias("confidence"), F.col("b.severity").alias("severity"),
        F.col("b.affected_ips").alias("affected_ips"), F.col("n").alias("total_votes"))


def majority(votes: DataFrame, s: EnsembleSettings = EnsembleSettings()) -> DataFrame:
    """At least two votes of any kind; the most confident one wins."""
    df = votes.withColumn("b", _best(F.col("votes")))
    return _emit(df, "majority", F.col("b.attack_type"), F.least(F.lit(0.95), F.col("b.confidence")),
                 F.col("b.severity"), F.col("b.affected_ips"), F.size("votes") >= s.min_votes, s)


def consensus(votes: DataFrame, s: EnsembleSettings = EnsembleSettings()) -> DataFrame:
    """At least two votes that all name one attack type; mean confidence, highest severity."""
    v = F.col("votes")
    types = F.array_distinct(F.transform(v, lambda x: x["attack_type"]))
    mean = F.reduce(v, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(v)

    def rank(c: Column) -> Column:
        out = F.lit(1)
        for name, value in VOTE_RANK.items():
            out = F.when(c == name, value).otherwise(out)
        return out

    worst = F.reduce(v, v[0], lambda a, x: F.when(rank(x["severity"]) > rank(a["severity"]), x).otherwise(a))
    ips = F.coalesce(F.try_element_at(F.filter(F.transform(v, lambda x: x["affected_ips"]), lambda x: F.size(x) > 0),
                                      F.lit(1)), F.array().cast("array<string>"))
    gate = (F.size(v) >= s.min_votes) & (F.size(types) == 1) & (mean >= s.min_confidence)
    return _emit(votes, "consensus", types[0], F.least(F.lit(0.95), mean), worst["severity"], ips, gate, s)


def hierarchical(votes: DataFrame, ml: DataFrame | None = None, s: EnsembleSettings = EnsembleSettings()) -> DataFrame:
    """Threshold verdicts, confirmed or dropped by the model where one has spoken.

    `ml` has one row per window with `ml_is_attack` and `ml_confidence`.
    """
    rules = F.filter("votes", lambda x: x["detector"] == "threshold")
    df = votes.withColumn("rules", rules).filter(F.size("rules") > 0).withColumn("b", _best(F.col("rules")))
    if ml is None:
        df = df.withColumn("ml_is_attack", F.lit(None).cast("boolean")).withColumn("ml_confidence", F.lit(0.0))
    else:
        df = df.join(ml.select(*KEYS, "ml_is_attack", "ml_confidence"), KEYS, "left")
    best = F.col("b.confidence")
    confirmed = F.col("ml_is_attack") & (F.col("ml_confidence") >= s.cascade_ml)
    cleared = ~F.col("ml_is_attack")
    confidence = (F.when(confirmed, (best + F.col("ml_confidence")) / 2).when(cleared, None)
                  .when(best > 0.8, best * 0.8))
    df = df.withColumn("c", confidence)
    return _emit(df, "hierarchical", F.col("b.attack_type"), F.col("c"), F.col("b.severity"), F.col("b.affected_ips"),
                 F.col("c").isNotNull(), s)


STRATEGIES = {"weighted": weighted, "majority": majority, "consensus": consensus}


def alert_payload(verdicts: DataFrame, features: DataFrame) -> DataFrame:
    """Verdict rows joined with the window figures that belong in an alert message."""
    f = features.select(*KEYS, "packets_per_second", "bytes_per_second")
    joined = verdicts.join(f, KEYS)
    return joined.select(
        "attack_type", "severity", "confidence", F.timestamp_seconds(F.col("window_start") + F.col("window_size")).alias("ts"),
        F.slice("affected_ips", 1, 10).alias("affected_ips"), F.col("method").alias("consensus_method"),
        F.struct("packets_per_second", "bytes_per_second", F.col("window_size").alias("window_size_seconds"),
                 "window_start").alias("details"))
