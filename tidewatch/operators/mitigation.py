"""From alerts to planned responses: mitigation plan, traffic redirects, shield candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RedirectSettings, ShieldSettings
from ..functions.numeric import MICROS
from .alerts import keep_spaced
from .rolling import global_rank

# Responses per severity (action, how many of the affected addresses).
PLAN = {"critical": [("block_ip", 5), ("rate_limit", 5), ("cloud_shield", 1)],
        "high": [("block_ip", 5), ("rate_limit", 5)], "medium": [("rate_limit", 3)]}
# Block duration and rate limits of the plan.
BLOCK_SECONDS = 3600
LIMIT_PPS = {"critical": 500, "high": 500, "medium": 1000}


def plan(alerts: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row per alert, address and action; arrays are short, nothing is shuffled."""
    table = F.create_map(*[c for severity, steps in PLAN.items() for c in (
        F.lit(severity), F.array(*[F.struct(F.lit(a).alias("action"), F.lit(n).alias("most")) for a, n in steps]))])
    steps = alerts.withColumn("_step", F.explode(F.try_element_at(table, F.coalesce("severity", F.lit("medium")))))
    rows = steps.select("*", F.posexplode(F.expr("slice(affected_ips, 1, _step.most)")).alias("position", "ip"))
    limit = F.lit(None).cast("int")
    for severity, pps in LIMIT_PPS.items():
        limit = F.when(F.col("severity") == severity, pps).otherwise(limit)
    action = F.col("_step.action")
    return rows.withColumns({
        "action": action, "rate_pps": F.when(action == "rate_limit", limit),
        "duration_seconds": F.when(action == "block_ip", F.lit(BLOCK_SECONDS)),
        "dry_run": F.lit(dry_run)}).drop("_step", "affected_ips")


def episodes(windows: DataFrame, is_attack: Column, keys: list[str], order: str = "window_start",
             size: str = "window_size", chunk_windows: int = 4096) -> DataFrame:
    """Runs of consecutive attack windows (gaps and islands).

    The island number is window position minus rank among the attack windows; the rank is built from
    per-chunk counts, so long histories stay parallel.
    """
    attacks = windows.filter(is_attack)
    chunk = F.expr(f"{order} div ({size} * {chunk_windows})")
    ranked = global_rank(attacks, keys, [order], chunk, "_rn")
    island = F.expr(f"{order} div {size}") - F.col("_rn")
    grouped = ranked.withColumn("_island", island).groupBy(*keys, "_island")
    out = grouped.agg(F.min(order).alias("starts"), (F.max(order) + F.first(size)).alias("ends"),
                      F.count("*").alias("windows"), F.max("packets_per_second").alias("peak_pps"),
                      F.max("bytes_per_second").alias("peak_bps"))
    return out.drop("_island").withColumn("seconds", F.col("ends") - F.col("starts"))


def should_redirect(pps: Column, bps: Column, seconds: Column, s: RedirectSettings = RedirectSettings()) -> Column:
    return ((pps >= s.min_pps) | (bps >= s.min_bps)) & (seconds >= s.min_seconds)


def redirects(targets: DataFrame, s: RedirectSettings = RedirectSettings()) -> DataFrame:
    """Redirect rows for (target_ip, started_at): id, prefix, next hop, community, and the announced rule."""
    prefix = F.concat("target_ip", F.lit("/32"))
    rule = F.to_json(F.struct(
        F.lit("redirect").alias("action"), F.lit(s.priority).alias("priority"), prefix.alias("destination_prefix"),
        F.lit(s.scrubber).alias("redirect"),
        F.lit(f"{s.asn}:666" if s.asn else None).cast("string").alias("community")), {"ignoreNullFields": "true"})
    start = F.floor(F.unix_micros("started_at") / F.lit(MICROS)).cast("bigint").cast("string")
    return targets.withColumns({
        "redirect_id": F.concat_ws("_", F.col("target_ip"), start), "destination_prefix": prefix, "flow_rule": rule,
        "status": F.lit("active")})


def expired_redirects(active: DataFrame, history: DataFrame, moment: Column,
                      s: RedirectSettings = RedirectSettings()) -> DataFrame:
    """Active redirects whose recorded start is longer ago than the rollback time."""
    joined = active.join(history.select("redirect_id", F.col("started_at").alias("_started")), "redirect_id")
    over = F.unix_micros(moment) - F.unix_micros("_started") > s.rollback_seconds * MICROS
    return joined.filter(over).drop("_started")


def redirect_for(targets: DataFrame, active: DataFrame) -> DataFrame:
    """The earliest active redirect of each target address (exact address, not a text match)."""
    ip = F.split("destination_prefix", "/")[0]
    first = active.groupBy(ip.alias("target_ip")).agg(F.min_by("redirect_id", F.struct("started_at", "redirect_id")).alias("redirect_id"))
    return targets.join(first, "target_ip")


def redirect_status(rows: DataFrame, moment: Column, s: RedirectSettings = RedirectSettings()) -> DataFrame:
    """Start, end and status of redirects at `moment`, rolled back after their time."""
    ends = F.col("started_at") + F.make_dt_interval(secs=F.lit(s.rollback_seconds))
    return rows.withColumn("ended_at", F.when(ends < moment, ends)).withColumn(
        "status", F.when(F.col("ended_at").isNull(), "active").otherwise("completed"))


def shield_candidates(rates: DataFrame, ip: str, s: ShieldSettings = ShieldSettings(), chunk_rows: int = 1_000_000) -> DataFrame:
    """(ip, ts, pps, bps) rows over the volume limits, at most one per address and cooldown."""
    over = rates.filter((F.col("pps") >= s.min_pps) | (F.col("bps") >= s.min_bps))
    return keep_spaced(over, [ip], s.cooldown_seconds, [], chunk_rows=chunk_rows).filter("kept").drop("kept", "leader_us")


def fresh_snapshots(snapshots: DataFrame, gap_ms: int, tie: list[str], chunk_rows: int = 1_000_000) -> DataFrame:
    """Active-flow snapshots at most every `gap_ms` per flow."""
    return keep_spaced(snapshots, ["flow_id"], gap_ms / 1000, tie, chunk_rows=chunk_rows).filter("kept").drop("kept", "leader_us")


def last_actions(actions: DataFrame, n: int = 100, tie: list[str] | None = None) -> DataFrame:
    """The latest n actions, newest first (a report)."""
    return actions.orderBy(F.desc("ts"), *[F.desc(c) for c in tie or []]).limit(max(1, min(1000, n)))
