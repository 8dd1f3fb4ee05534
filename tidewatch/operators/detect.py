"""Threshold rules over window features, declared rules and severity tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SEVERITIES, ThresholdSettings
from ..functions.net import ipv4_number, subnet_of
from ..functions.numeric import bucket_start, micros
from ..schemas import TIER
from .windows import weight

ALERT_FIELDS = ["window_size", "window_start", "rule", "attack_type", "severity", "confidence", "current_value",
                "threshold_value", "affected_ips"]


def top_addresses(features: DataFrame, side: str, n: int = 5) -> Column:
    """The n heaviest addresses of a side, an empty array where the list is not computed."""
    name = f"top_{side}_ips"
    if name not in features.columns:
        return F.array().cast("array<string>")
    return F.coalesce(F.transform(F.slice(name, 1, n), lambda x: x["key"]), F.array().cast("array<string>"))


def _alert(rule: str, attack: str, severity: Column, confidence: Column, value: Column, limit: Column,
           ips: Column, when: Column) -> Column:
    body = F.struct(F.lit(rule).alias("rule"), F.lit(attack).alias("attack_type"), severity.alias("severity"),
                    confidence.cast("double").alias("confidence"), value.cast("double").alias("current_value"),
                    limit.cast("double").alias("threshold_value"), ips.alias("affected_ips"))
    return F.when(F.coalesce(when, F.lit(False)), body)


def threshold_rules(features: DataFrame, s: ThresholdSettings) -> list[Column]:
    """The four standard rules; `features` must carry the columns of `dynamic_thresholds`."""
    pps, entropy = F.col("packets_per_second"), F.col("entropy_src_ip")
    src, dst = top_addresses(features, "src"), top_addresses(features, "dst")
    excess = pps / F.col("pps_limit")
    drop = F.col("entropy_baseline") - entropy
    return [
        # Severity steps and confidence caps of each rule.
        _alert("volumetric_pps", "pps_flood",
               F.when(excess > 5, "critical").when(excess > 2, "high").otherwise("medium"),
               F.least(F.lit(0.99), F.lit(0.5) + (excess - 1) * 0.2), pps, F.col("pps_limit"), src,
               (pps > s.pps) & (pps > F.col("pps_limit"))),
        _alert("syn_flood", "syn_flood", F.lit("high"), F.least(F.lit(0.95), F.col("syn_ratio")), F.col("syn_ratio"),
               F.lit(s.syn_ratio), dst, (F.col("syn_ratio") > s.syn_ratio) & (pps > s.syn_min_pps)),
        _alert("udp_flood", "udp_flood", F.lit("high"), F.least(F.lit(0.9), F.col("udp_ratio")), F.col("udp_ratio"),
               F.lit(s.udp_ratio), dst, (F.col("udp_ratio") > s.udp_ratio) & (pps > s.udp_min_pps)),
        _alert("entropy_anomaly", "distributed_entropy", F.when(entropy < 0.2, "high").otherwise("medium"),
               F.least(F.lit(0.95), F.lit(0.5) + drop), entropy, F.col("entropy_baseline"), src,
               entropy < F.col("entropy_limit")),
    ]


def declared_rules(features: DataFrame, s: ThresholdSettings) -> list[Column]:
    """Rules the settings declare beyond the standard four: bandwidth, flow rate, ICMP."""
    src, dst = top_addresses(features, "src"), top_addresses(features, "dst")
    bps, fps, pps = F.col("bytes_per_second"), F.col("flows_per_second"), F.col("packets_per_second")

    def over(rule: str, attack: str, value: Column, limit: float) -> Column:
        excess = value / limit
        return _alert(rule, attack, F.when(excess > 5, "critical").when(excess > 2, "high").otherwise("medium"),
                      F.least(F.lit(0.99), F.lit(0.5) + (excess - 1) * 0.2), value, F.lit(limit), src, value > limit)

    return [
        over("volumetric_bps", "bandwidth_flood", bps, s.bps), over("flow_rate", "connection_flood", fps, s.fps),
        _alert("icmp_flood", "icmp_flood", F.lit("high"), F.least(F.lit(0.9), F.col("icmp_ratio")), F.col("icmp_ratio"),
               F.lit(s.icmp_ratio), dst, (F.col("icmp_ratio") > s.icmp_ratio) & (pps > s.icmp_min_pps)),
    ]


def raise_alerts(features: DataFrame, rules: list[Column], s: ThresholdSettings = ThresholdSettings()) -> DataFrame:
    """One row per fired rule; windows shorter than the minimum raise nothing."""
    fired = features.filter(F.col("window_size") >= s.min_window_seconds).select(
        "window_size", "window_start", F.explode(F.filter(F.array(*rules), lambda a: a.isNotNull())).alias("a"))
    return fired.select("window_size", "window_start", "a.*").select(*ALERT_FIELDS)


def per_source_rates(flows: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    """Packet, connection, byte and HTTP request rate of every source per window; null rates without `bytes` or `http_method`."""
    def amount(name: str, given: Column) -> Column:
        return (given if name in flows.columns else F.lit(None)).cast("bigint")

    grouped = flows.select(bucket_start(micros(ts), seconds).alias("window_start"), "ip_src", weight(flows).alias("w"),
                           amount("bytes", F.col("bytes")).alias("bytes"), amount("http_method", F.col("http_method").isNotNull()).alias("http"))
    return grouped.groupBy("window_start", "ip_src").agg(
        (F.sum("w") / F.lit(float(seconds))).alias("pps"), (F.count("*") / F.lit(float(seconds))).alias("connections"),
        *[(F.sum(c) / F.lit(float(seconds))).alias(n) for n, c in (("bps", "bytes"), ("http_rate", "http"))])


def per_source_alerts(flows: DataFrame, seconds: int, s: ThresholdSettings = ThresholdSettings()) -> DataFrame:
    """Sources over the per-address packet or connection limit."""
    r = per_source_rates(flows, seconds)
    hits = F.array(
        F.when(F.col("pps") > s.pps_per_ip, F.struct(F.lit("per_ip_pps").alias("rule"), F.col("pps").alias("value"))),
        F.when(F.col("connections") > s.connections_per_ip,
               F.struct(F.lit("per_ip_connections").alias("rule"), F.col("connections").alias("value"))))
    return r.select("window_start", "ip_src", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(
        "window_start", "ip_src", "h.rule", "h.value")


def per_subnet_rates(flows: DataFrame, seconds: int, prefix: int = 24, ts: str = "ts") -> DataFrame:
    """Packet rate per source subnet and window; sources are added up first, so no subnet is hot."""
    per_ip = per_source_rates(flows, seconds, ts).filter(ipv4_number(F.col("ip_src")).isNotNull())
    return per_ip.groupBy("window_start", subnet_of(F.col("ip_src"), prefix).alias("subnet")).agg(
        F.sum("pps").alias("pps"), F.count("*").alias("sources"))


# Declared severity tiers (lowest value that reaches each severity).
TIERS = {
    "pps": {"low": 10000, "medium": 25000, "high": 50000, "critical": 100000},
    "pps_per_ip": {"low": 2000, "medium": 5000, "high": 10000, "critical": 25000},
    "pps_per_subnet": {"low": 5000, "medium": 15000, "high": 30000, "critical": 75000},
    "bps": {"low": 1e8, "medium": 5e8, "high": 1e9, "critical": 5e9},
    "bps_per_ip": {"low": 5e7, "medium": 1e8, "high": 5e8, "critical": 1e9},
    "fps": {"low": 2000, "medium": 5000, "high": 10000, "critical": 25000},
    "syn_ratio": {"low": 0.7, "medium": 0.8, "high": 0.9, "critical": 0.95},
    "syn_rate": {"low": 2000, "medium": 5000, "high": 10000, "critical": 25000},
    "udp_ratio": {"low": 0.6, "medium": 0.7, "high": 0.8, "critical": 0.9},
    "udp_rate": {"low": 5000, "medium": 10000, "high": 25000, "critical": 50000},
    "icmp_ratio": {"low": 0.4, "medium": 0.5, "high": 0.6, "critical": 0.7},
    "icmp_rate": {"low": 2000, "medium": 5000, "high": 10000, "critical": 25000},
    "http_rate": {"low": 500, "medium": 1000, "high": 2500, "critical": 5000},
    "http_per_ip": {"low": 100, "medium": 250, "high": 500, "critical": 1000},
}

# Responses per attack and severity.
ACTIONS = {
    "syn_flood": {"low": ["log", "rate_limit"], "medium": ["rate_limit", "notify"],
                  "high": ["block_ip", "notify", "cloud_shield"],
                  "critical": ["block_subnet", "notify", "cloud_shield", "scrubber"]},
    "udp_flood": {"low": ["log"], "medium": ["rate_limit", "notify"], "high": ["rate_limit", "notify", "cloud_shield"],
                  "critical": ["block_subnet", "notify", "cloud_shield", "scrubber"]},
    "http_flood": {"low": ["log", "rate_limit"], "medium": ["rate_limit", "notify", "captcha"],
                   "high": ["block_ip", "notify", "cloud_shield"],
                   "critical": ["block_ip", "notify", "cloud_shield", "scrubber"]},
}

# Multiples of the baseline that reach each severity.
BASELINE_MULTIPLES = {"low": 2.0, "medium": 3.0, "high": 5.0, "critical": 10.0}

# Entropy bands (low critical, low warning, high warning, high critical).
ENTROPY_BANDS = {"src_ip": (1.0, 1.5, 6.0, 7.0), "dst_ip": (None, None, 4.0, 5.0)}


def tier_table(spark: SparkSession, tiers: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(metric, severity, SEVERITIES.index(severity), float(limit))
            for metric, levels in tiers.items() for severity, limit in levels.items()]
    return spark.createDataFrame(rows, TIER)


def tier_lookup(values: DataFrame, tiers: DataFrame) -> DataFrame:
    """Highest tier each (metric, value) reaches; rows below every tier are left out.

    The few tiers of a metric travel as one array, so no row is multiplied or regrouped.
    """
    step = F.struct("rank", "min_value", "severity")
    ladders = tiers.groupBy("metric").agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    reached = F.filter("_steps", lambda t: F.col("value") >= t["min_value"])
    hit = values.join(ladders, "metric").withColumn("_hit", F.try_element_at(reached, F.lit(-1)))
    return hit.filter(F.col("_hit").isNotNull()).select(
        *values.columns, F.col("_hit.severity").alias("severity"), F.col("_hit.min_value").alias("limit"))


def joint_severity(first: Column, second: Column) -> Column:
    """The lower of two severities; null when either is missing (both limits must be met)."""
    def rank(c: Column) -> Column:
        return F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), c)
    return F.when(rank(first) <= rank(second), first).when(rank(second) < rank(first), second)


def scaled_tiers(scale: dict[str, float], tiers: dict[str, dict[str, float]] = TIERS) -> dict[str, dict[str, float]]:
    """The declared tiers with the limits of the named metrics multiplied, for traffic of another volume."""
    return {metric: {s: v * scale.get(metric, 1.0) for s, v in levels.items()} for metric, levels in tiers.items()}


def tier_of(value: Column, levels: dict[str, float]) -> Column:
    """The highest severity whose limit the value reaches, else null."""
    out = F.lit(None).cast("string")
    for severity, limit in levels.items():
        out = F.when(value >= limit, severity).otherwise(out)
    return out


def window_tiers(features: DataFrame, tiers: dict[str, dict[str, float]] = TIERS) -> DataFrame:
    """(window_size, window_start, metric, severity) of every declared window tier that is reached.

    Rates need one limit; the SYN, UDP and ICMP rules need a ratio and a rate, and the lower severity of the two counts.
    """
    pps = F.col("packets_per_second")
    rate = {"pps": pps, "bps": F.col("bytes_per_second"), "fps": F.col("flows_per_second"),
            "http_rate": F.col("http_requests") / F.col("window_size")}
    found = [F.struct(F.lit(m).alias("metric"), tier_of(c, tiers[m]).alias("severity")) for m, c in rate.items()]
    for kind in ("syn", "udp", "icmp"):
        both = joint_severity(tier_of(F.col(f"{kind}_ratio"), tiers[f"{kind}_ratio"]), tier_of(pps, tiers[f"{kind}_rate"]))
        found.append(F.struct(F.lit(f"{kind}_flood").alias("metric"), both.alias("severity")))
    rows = features.select("window_size", "window_start", F.explode(F.array(*found)).alias("t")).select("window_size", "window_start", "t.*")
    return rows.filter(F.col("severity").isNotNull())


def address_tiers(flows: DataFrame, seconds: int, tiers: dict[str, dict[str, float]] = TIERS, ts: str = "ts") -> DataFrame:
    """(window_start, subject, metric, severity) of the declared tiers per source address (packets, bytes and HTTP
    requests a second) and per /24 subnet (packets a second)."""
    found = [F.struct(F.lit(m).alias("metric"), tier_of(F.col(c), tiers[m]).alias("severity"))
             for m, c in (("pps_per_ip", "pps"), ("bps_per_ip", "bps"), ("http_per_ip", "http_rate"))]
    sources = per_source_rates(flows, seconds, ts).select("window_start", F.col("ip_src").alias("subject"), F.explode(F.array(*found)).alias("t")).select(
        "window_start", "subject", "t.*")
    subnets = per_subnet_rates(flows, seconds, ts=ts).select("window_start", F.col("subnet").alias("subject"), F.lit("pps_per_subnet").alias("metric"),
                                                             tier_of(F.col("pps"), tiers["pps_per_subnet"]).alias("severity"))
    return sources.unionByName(subnets).filter(F.col("severity").isNotNull())


def ratio_tier(value: Column, rate: Column, ratio_levels: dict[str, float], rate_levels: dict[str, float]) -> Column:
    """Severity for rules that need a ratio and a minimum rate of the same level."""
    out = F.lit(None).cast("string")
    for severity in ("low", "medium", "high", "critical"):
        out = F.when((value >= ratio_levels[severity]) & (rate >= rate_levels[severity]), severity).otherwise(out)
    return out


def baseline_severity(value: Column, baseline: Column) -> Column:
    """Severity by the multiple of the baseline."""
    out = F.lit(None).cast("string")
    for severity, multiple in BASELINE_MULTIPLES.items():
        out = F.when((baseline > 0) & (value >= baseline * multiple), severity).otherwise(out)
    return out


def entropy_band(value: Column, side: str) -> Column:
    """low_critical / low_warning / normal / high_warning / high_critical."""
    low_crit, low_warn, high_warn, high_crit = ENTROPY_BANDS[side]
    band = F.when(value > high_crit, "high_critical").when(value > high_warn, "high_warning")
    if low_crit is not None:
        band = band.when(value < low_crit, "low_critical").when(value < low_warn, "low_warning")
    return band.otherwise("normal")


def with_actions(alerts: DataFrame) -> DataFrame:
    """Declared responses of an (attack_type, severity) pair; null where none is declared."""
    pairs = [(F.lit(f"{attack}/{severity}"), F.array(*[F.lit(a) for a in names]))
             for attack, levels in ACTIONS.items() for severity, names in levels.items()]
    table = F.create_map(*[c for pair in pairs for c in pair])
    return alerts.withColumn("actions", F.try_element_at(table, F.concat_ws("/", "attack_type", "severity")))
