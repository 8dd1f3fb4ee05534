"""Alert life cycle: cooldown, deduplication, throttling, resolution, inhibition, routing, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEVERITIES, EnsembleSettings
from ..functions.numeric import MICROS
from .ordered import CHUNK_ROWS, run_fold, spacing, spacing_with_quota

# Notification routes in order (severity, receiver, continue with the next route).
ROUTES = [("critical", "critical-receiver", True), ("high", "webhook", True), ("medium", "webhook", False)]
DEFAULT_RECEIVER = "webhook"

# Which severity silences which.
INHIBITS = {"critical": "high", "high": "medium"}


def severity_rank(severity: Column) -> Column:
    """0 for info up to 4 for critical; null for an unknown name."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(at > 0, at - 1)


def at_least(alerts: DataFrame, minimum: str) -> DataFrame:
    return alerts.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(minimum))


def with_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp")))


def keep_spaced(df: DataFrame, keys: list[str], gap_seconds: float, tie: list[str], ts: str = "ts",
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows at least `gap_seconds` after the last kept row of their key, flagged in `kept`."""
    fold = spacing(int(gap_seconds * MICROS))
    return run_fold(with_time(df, ts), keys, ["us", *tie], fold, chunk_rows=chunk_rows).drop("us")


def cooldown(alerts: DataFrame, seconds: int = 30, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Threshold alerts that pass the per-rule, per-window-size cooldown."""
    timed = alerts.withColumn("us", F.col("window_start") * F.lit(MICROS))
    kept = run_fold(timed, ["rule", "window_size"], ["us"], spacing(seconds * MICROS), chunk_rows=chunk_rows)
    return kept.filter("kept").drop("us", "kept", "leader_us")


def deduplicate(alerts: DataFrame, tie: list[str], seconds: int = 60, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Flags alerts closer than `seconds` to the last accepted one of the same type and severity."""
    out = keep_spaced(alerts, ["attack_type", "severity"], seconds, tie, chunk_rows=chunk_rows)
    return out.withColumn("is_duplicate", ~F.col("kept")).drop("kept", "leader_us")


def throttle(verdicts: DataFrame, tie: list[str], s: EnsembleSettings = EnsembleSettings(), ts: str = "ts",
             window_seconds: int = 60, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Global limit on verdicts: a minimum gap and a quota per minute (or per window), flagged in `kept`."""
    fold = spacing_with_quota(s.throttle_gap_seconds * MICROS, window_seconds * MICROS, s.throttle_per_minute)
    one = with_time(verdicts, ts).withColumn("_all", F.lit(0))
    return run_fold(one, ["_all"], ["us", *tie], fold, chunk_rows=chunk_rows).drop("_all", "us")


def attack_alerts(detections: DataFrame) -> DataFrame:
    """Alert text and fields of a detection; an unknown severity counts as medium."""
    known = F.col("severity").isin("low", "medium", "high", "critical")
    percent = F.format_string("%.2f%%", F.coalesce(F.col("confidence"), F.lit(0.0)) * 100)
    return detections.withColumns({
        "severity": F.when(known, F.col("severity")).otherwise("medium"),
        "title": F.concat(F.lit("DDoS Attack Detected: "), F.coalesce("attack_type", F.lit("Unknown"))),
        "description": F.concat(F.lit("A potential DDoS attack has been detected. Confidence: "), percent)})


def to_records(alerts: DataFrame, most: int = 20) -> DataFrame:
    """Alert rows in message shape: address lists cut to `most`, other columns as text details."""
    named = ["alert_id", "title", "description", "severity", "ts", "attack_type", "confidence", "source_ips", "target_ips"]
    lists = [F.slice(c, 1, most).alias(c) if c.endswith("_ips") else F.col(c) for c in named if c in alerts.columns]
    rest = [c for c in alerts.columns if c not in named]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    details = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return alerts.select(*lists, details.alias("details"))


def with_expiry(alerts: DataFrame, seconds: int = 3600, resolved: DataFrame | None = None) -> DataFrame:
    """`ends_at` of every alert: the manual resolution (alert_id, resolved_at) or the automatic one."""
    auto = F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))
    if resolved is None:
        return alerts.withColumn("ends_at", auto)
    joined = alerts.join(resolved.select("alert_id", "resolved_at"), "alert_id", "left")
    return joined.withColumn("ends_at", F.least(auto, F.coalesce("resolved_at", auto))).drop("resolved_at")


def active_at(alerts: DataFrame, moment: Column) -> DataFrame:
    """Alerts raised by `moment` and not over at it."""
    return alerts.filter((F.col("ts") <= moment) & (F.col("ends_at") > moment))


def inhibit(alerts: DataFrame, name: str = "attack_type", seconds: int = 300) -> DataFrame:
    """Drops alerts silenced by a more severe one of the same name in the same time bucket.

    The silencing side is reduced to distinct (name, bucket, severity) before the join.
    """
    bucket = F.expr(f"unix_micros(ts) div {seconds * MICROS}")
    timed = alerts.withColumn("_bucket", bucket)
    silences = F.lit(None).cast("string")
    for source, target in INHIBITS.items():
        silences = F.when(F.col("severity") == source, target).otherwise(silences)
    sources = timed.select(F.col(name), "_bucket", silences.alias("severity")).dropna().distinct()
    return timed.join(sources, [name, "_bucket", "severity"], "left_anti").drop("_bucket")


def route(alerts: DataFrame, routes: list[tuple[str, str, bool]] = ROUTES, default: str = DEFAULT_RECEIVER) -> DataFrame:
    """One row per (alert, receiver): routes in order, stopping at the first match that does not continue."""
    table = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(r).alias("receiver"), F.lit(c).alias("go_on"))
                      for s, r, c in routes])
    matching = F.filter(table, lambda r: r["severity"] == F.col("severity"))
    start = F.struct(F.array().cast("array<string>").alias("to"), F.lit(False).alias("done"))
    chosen = F.reduce(matching, start, lambda a, r: F.when(a["done"], a).otherwise(
        F.struct(F.concat(a["to"], F.array(r["receiver"])).alias("to"), (~r["go_on"]).alias("done"))))["to"]
    receivers = F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.lit(default)))
    return alerts.select("*", F.posexplode(receivers).alias("route_order", "receiver"))


def repeated_notifications(alerts: DataFrame, tie: list[str], name: str = "attack_type", repeat_seconds: int = 3600,
                           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Repeats of a group's notification: for each (name, severity) the alerts at least one repeat interval after the
    last one notified, numbered from 0 (the first notification)."""
    kept = keep_spaced(alerts, [name, "severity"], repeat_seconds, tie, chunk_rows=chunk_rows).filter("kept")
    # One row per group and interval is left, so the number of rows of a group is bounded by its time span.
    number = F.row_number().over(Window.partitionBy(name, "severity").orderBy("ts", *tie)) - 1
    return kept.select(name, "severity", "ts", *tie, number.alias("repeat"))


def group_notifications(alerts: DataFrame, tie: list[str], name: str = "attack_type", wait_seconds: int = 30,
                        interval_seconds: int = 300, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Notification batches per (name, severity): a batch opens with its first alert and runs one interval."""
    keyed = keep_spaced(alerts, [name, "severity"], interval_seconds, tie, chunk_rows=chunk_rows)
    opened = F.timestamp_micros("leader_us")
    return keyed.groupBy(name, "severity", opened.alias("opened_at")).agg(
        F.count("*").alias("alerts"), F.max("ts").alias("last_alert")).withColumn(
        "notify_at", F.col("opened_at") + F.make_dt_interval(secs=F.lit(wait_seconds)))


def history(alerts: DataFrame, n: int = 100, tie: list[str] | None = None) -> DataFrame:
    """The latest n alerts (a report, so the limit is the feature)."""
    return alerts.orderBy(F.desc("ts"), *[F.desc(c) for c in tie or []]).limit(n)
