"""Votes, verdicts and the alert life cycle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import EnsembleSettings
from ..functions.numeric import r6
from ..operators import alerts as ops
from ..operators import detect, ensemble, rolling, windows
from ..session import cut_lineage
from ..sources import events as src
from .base import SIZES, ctes, greedy, query
from .base import r6 as q6
from .windows import ALERT_SQL, KEY, RULES, SCALED, alert_columns, features, raised, stored

SETTINGS = replace(EnsembleSettings(), min_confidence=0.5, entropy_limit=2.2)

# The model's vote stands in as a rule over the window features, so that SQL can follow it.
ML = """SELECT window_size, window_start, fin_ratio > 0.012 AS ml_is_attack, least(0.95::DOUBLE, 0.45 + fin_ratio * 20) AS ml_confidence FROM features"""
VOTES = {**RULES, "ml": ML, "v0": """
    SELECT window_size, window_start, 'threshold' AS detector, attack_type, confidence, severity, ips, 0 AS o FROM raised
    UNION ALL SELECT window_size, window_start, 'ml', 'ddos_ml', ml_confidence, CASE WHEN ml_confidence > 0.8 THEN 'high' ELSE 'medium' END, '', 1
      FROM ml WHERE ml_is_attack AND ml_confidence > 0.5
    UNION ALL SELECT window_size, window_start, 'entropy', 'low_entropy_attack', least(0.9::DOUBLE, 1 - entropy_src_ip / 2.2), 'medium', top_dst, 2
      FROM features WHERE entropy_src_ip < 2.2""",
    "v": """SELECT *, row_number() OVER (PARTITION BY window_size, window_start ORDER BY o, attack_type, confidence) AS i,
      count(*) OVER (PARTITION BY window_size, window_start) AS total_votes,
      CASE detector WHEN 'threshold' THEN 0.4 WHEN 'ml' THEN 0.4 ELSE 0.2 END AS w FROM v0"""}
VERDICT_SQL = f"SELECT window_size, window_start, attack_type, {q6('confidence')} AS confidence, severity, ips, total_votes::INT AS total_votes FROM "


def model_opinion(f):
    return f.withColumns({"ml_is_attack": F.col("fin_ratio") > 0.012, "ml_confidence": F.least(F.lit(0.95), F.lit(0.45) + F.col("fin_ratio") * 20)})


def windows_of(spark, sf_dir):
    """Window features with limits and the model's opinion, written once: the votes read them several times.

    The table has one row per window, so this costs little next to the pass over the flows.
    """
    return cut_lineage(model_opinion(rolling.dynamic_thresholds(stored(features(spark, sf_dir)), SCALED)))


def votes(f):
    alerts = detect.raise_alerts(f, detect.threshold_rules(f, SCALED), SCALED)
    return ensemble.collect_votes(ensemble.threshold_votes(alerts), ensemble.ml_votes(f), ensemble.entropy_votes(f, SETTINGS))


def _verdict(df):
    return df.select(*KEY, "attack_type", r6("confidence").alias("confidence"), "severity", F.array_join("affected_ips", ",").alias("ips"),
                     F.col("total_votes"))


WEIGHTED = {**VOTES, "t": """SELECT window_size, window_start, attack_type, round(sum(confidence * w), 12) AS score, min(i) AS first, any_value(total_votes) AS total_votes,
      arg_max(struct_pack(c := confidence, s := severity, p := ips), struct_pack(c := confidence, i := -i)) AS b FROM v GROUP BY ALL""",
    "r": """SELECT *, row_number() OVER (PARTITION BY window_size, window_start ORDER BY score DESC, first) AS k FROM t""",
    "verdict": """SELECT window_size, window_start, attack_type, least(0.95::DOUBLE, b.c) AS confidence, b.s AS severity, b.p AS ips, total_votes FROM r WHERE k = 1 AND b.c >= 0.5"""}


@query("votes_weighted", ctes("features", extra=WEIGHTED) + VERDICT_SQL + "verdict")
def votes_weighted(spark, sf_dir):
    return _verdict(ensemble.weighted(votes(windows_of(spark, sf_dir)), SETTINGS))


@query("votes_majority", ctes("features", extra={**VOTES, "r": """SELECT *, row_number() OVER (PARTITION BY window_size, window_start ORDER BY confidence DESC, i) AS k FROM v""",
    "verdict": "SELECT * REPLACE (least(0.95::DOUBLE, confidence) AS confidence) FROM r WHERE k = 1 AND total_votes >= 2 AND confidence >= 0.5"}) + VERDICT_SQL + "verdict")
def votes_majority(spark, sf_dir):
    return _verdict(ensemble.majority(votes(windows_of(spark, sf_dir)), SETTINGS))


@query("votes_consensus", ctes("features", extra={**VOTES,
    "one": """SELECT window_size, window_start, detector, CASE WHEN detector = 'ml' AND (window_start // 3600) % 3 = 0 THEN 'other' ELSE 'attack' END AS attack_type, confidence, severity, ips, i, total_votes,
        CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END AS rk FROM v""",
    "verdict": """SELECT window_size, window_start, min(attack_type) AS attack_type, least(0.95::DOUBLE, avg(confidence)) AS confidence, arg_max(severity, rk * 100 - i) AS severity,
        coalesce(arg_min(ips, i) FILTER (ips <> ''), '') AS ips, any_value(total_votes) AS total_votes FROM one GROUP BY 1, 2
        HAVING count(*) >= 2 AND count(DISTINCT attack_type) = 1 AND avg(confidence) >= 0.5"""}) + VERDICT_SQL + "verdict")
def votes_consensus(spark, sf_dir):
    # The model names another attack type in one window of three, so votes agree and differ.
    def named(v):
        return F.when((v["detector"] == "ml") & F.expr("window_start div 3600 % 3 = 0"), "other").otherwise("attack")

    one = votes(windows_of(spark, sf_dir)).withColumn("votes", F.transform("votes", lambda v: v.withField("attack_type", named(v))))
    return _verdict(ensemble.consensus(one, SETTINGS))


@query("votes_hierarchical", ctes("features", extra={**VOTES,
    "r": "SELECT *, row_number() OVER (PARTITION BY window_size, window_start ORDER BY confidence DESC, i) AS k FROM v WHERE detector = 'threshold'",
    "c": """SELECT r.* EXCLUDE (confidence), CASE WHEN ml_is_attack AND ml_confidence >= 0.7 THEN (confidence + ml_confidence) / 2 WHEN NOT ml_is_attack THEN NULL
        WHEN confidence > 0.8 THEN confidence * 0.8 END AS confidence FROM r LEFT JOIN ml USING (window_size, window_start) WHERE k = 1""",
    "verdict": "SELECT * FROM c WHERE confidence >= 0.5"}) + VERDICT_SQL + "verdict")
def votes_hierarchical(spark, sf_dir):
    f = windows_of(spark, sf_dir)
    return _verdict(ensemble.hierarchical(votes(f), f, SETTINGS))


@query("alert_payload", ctes("features", extra=WEIGHTED) + f"""
    SELECT attack_type, severity, (window_start + window_size) * 1000000 AS us, ips, {q6('pps')} AS pps, {q6('bps')} AS bps, window_size
    FROM verdict JOIN features USING (window_size, window_start)""")
def alert_payload(spark, sf_dir):
    f = windows_of(spark, sf_dir)
    p = ensemble.alert_payload(ensemble.weighted(votes(f), SETTINGS), f)
    return p.select("attack_type", "severity", F.unix_micros("ts").alias("us"), F.array_join("affected_ips", ",").alias("ips"),
                    r6(F.col("details.packets_per_second")).alias("pps"), r6(F.col("details.bytes_per_second")).alias("bps"),
                    F.col("details.window_size_seconds").alias("window_size"))


@query("alert_cooldown", ctes("features", extra={**RULES, "rr": "SELECT *, window_start * 1000000 AS us FROM raised",
    **greedy("rr", "rule || '_' || window_size", 4 * 3600 * 1_000_000, "window_start"),
    "kept": "SELECT o.* FROM o JOIN g USING (gk, rn) WHERE kept"}, recursive=True) + ALERT_SQL + "kept")
def alert_cooldown(spark, sf_dir):
    return alert_columns(ops.cooldown(stored(raised(spark, sf_dir)), 4 * 3600))


@query("alert_dedup", ctes("alerts", extra=greedy("alerts", "attack_type || severity", 3600 * 1_000_000, "alert_id"), recursive=True) + """
    SELECT o.alert_id, attack_type, severity, NOT kept AS is_duplicate FROM o JOIN g USING (gk, rn)""")
def alert_dedup(spark, sf_dir):
    return ops.deduplicate(src.alerts(spark, sf_dir), ["alert_id"], 3600).select("alert_id", "attack_type", "severity", "is_duplicate")


@query("alert_throttle", ctes("alerts", extra={
    "c": "SELECT *, row_number() OVER (ORDER BY us, alert_id) AS rn FROM alerts",
    "g": """SELECT rn, [us] AS q, TRUE AS kept FROM c WHERE rn = 1
      UNION ALL SELECT c.rn, CASE WHEN c.us - g.q[-1] >= 3600000000 AND len(list_filter(g.q, lambda x: x > c.us - 86400000000)) < 8 THEN list_append(g.q, c.us) ELSE g.q END,
        c.us - g.q[-1] >= 3600000000 AND len(list_filter(g.q, lambda x: x > c.us - 86400000000)) < 8 FROM g JOIN c ON c.rn = g.rn + 1"""}, recursive=True) + """
    SELECT c.alert_id, kept FROM c JOIN g USING (rn)""")
def alert_throttle(spark, sf_dir):
    limits = EnsembleSettings(throttle_gap_seconds=3600, throttle_per_minute=8)
    return ops.throttle(src.alerts(spark, sf_dir), ["alert_id"], limits, window_seconds=86400).select("alert_id", "kept")


@query("verdict_throttle", ctes("features", extra={**WEIGHTED,
    "c": "SELECT *, (window_start + window_size) * 1000000 AS us, row_number() OVER (ORDER BY window_start + window_size, window_size, attack_type) AS rn FROM verdict",
    "g": """SELECT rn, [us] AS q, TRUE AS kept FROM c WHERE rn = 1
      UNION ALL SELECT c.rn, CASE WHEN c.us - g.q[-1] >= 10000000 THEN [c.us] ELSE g.q END, c.us - g.q[-1] >= 10000000 FROM g JOIN c ON c.rn = g.rn + 1"""}, recursive=True) + """
    SELECT window_size, window_start, attack_type, kept FROM c JOIN g USING (rn)""")
def verdict_throttle(spark, sf_dir):
    v = stored(ensemble.weighted(votes(windows_of(spark, sf_dir)), SETTINGS)).withColumn("ts", F.timestamp_seconds(F.col("window_start") + F.col("window_size")))
    return ops.throttle(v, ["window_size", "attack_type"]).select(*KEY, "attack_type", "kept")


@query("active_alerts", ctes("alerts") + """
    SELECT alert_id, severity FROM alerts WHERE us <= 1705320000000000
      AND us + CASE WHEN alert_id % 3 = 0 THEN 600000000 ELSE 3600000000 END > 1705320000000000""")
def active_alerts(spark, sf_dir):
    a = src.alerts(spark, sf_dir)
    resolved = a.filter("alert_id % 3 = 0").select("alert_id", (F.col("ts") + F.expr("interval 600 seconds")).alias("resolved_at"))
    return ops.active_at(ops.with_expiry(a, 3600, resolved), F.timestamp_seconds(F.lit(1705320000))).select("alert_id", "severity")


@query("attack_alerts", ctes("alerts") + """
    SELECT alert_id, 'DDoS Attack Detected: ' || attack_type AS title, severity,
      'A potential DDoS attack has been detected. Confidence: ' || printf('%.2f', confidence * 100) || '%' AS description FROM alerts WHERE severity IN ('high', 'critical')""")
def attack_alerts(spark, sf_dir):
    return ops.attack_alerts(ops.at_least(src.alerts(spark, sf_dir), "high")).select("alert_id", "title", "severity", "description")


@query("alert_records", ctes("ranked") + """
    SELECT window_size || '/' || window_start AS alert_id, string_agg(key, ',' ORDER BY rank) FILTER (dim = 'src_ip' AND rank <= 20) AS source_ips,
      string_agg(key, ',' ORDER BY rank) FILTER (dim = 'dst_ip' AND rank <= 20) AS target_ips, CAST(window_size AS VARCHAR) AS seconds FROM ranked GROUP BY window_size, window_start""")
def alert_records(spark, sf_dir):
    f = windows.traffic_features(src.flows(spark, sf_dir), SIZES, top=30)
    a = f.select(F.concat_ws("/", "window_size", "window_start").alias("alert_id"), detect.top_addresses(f, "src", 30).alias("source_ips"),
                 detect.top_addresses(f, "dst", 30).alias("target_ips"), "window_size")
    r = ops.to_records(a)
    return r.select("alert_id", F.array_join("source_ips", ",").alias("source_ips"), F.array_join("target_ips", ",").alias("target_ips"),
                    F.col("details")["window_size"].alias("seconds"))


@query("inhibited_alerts", ctes("alerts", extra={"t": "SELECT *, us // 14400000000 AS b FROM alerts"}) + """
    SELECT alert_id, attack_type, severity FROM t WHERE NOT EXISTS (SELECT 1 FROM t s WHERE s.attack_type = t.attack_type AND s.b = t.b
      AND ((s.severity = 'critical' AND t.severity = 'high') OR (s.severity = 'high' AND t.severity = 'medium')))""")
def inhibited_alerts(spark, sf_dir):
    return ops.inhibit(src.alerts(spark, sf_dir), seconds=14400).select("alert_id", "attack_type", "severity")


@query("alert_routes", ctes("alerts") + """
    SELECT alert_id, CASE severity WHEN 'critical' THEN 'critical-receiver' ELSE 'webhook' END AS receiver, 0 AS route_order FROM alerts""")
def alert_routes(spark, sf_dir):
    return ops.route(src.alerts(spark, sf_dir)).select("alert_id", "receiver", "route_order")


@query("alert_groups", ctes("alerts", extra={**greedy("alerts", "attack_type || severity", 7200 * 1_000_000, "alert_id"),
    "j": "SELECT o.attack_type, o.severity, o.us, g.last FROM o JOIN g USING (gk, rn)"}, recursive=True) + """
    SELECT attack_type, severity, last AS opened_us, count(*) AS alerts, max(us) AS last_us, last + 30000000 AS notify_us FROM j GROUP BY attack_type, severity, last""")
def alert_groups(spark, sf_dir):
    g = ops.group_notifications(src.alerts(spark, sf_dir), ["alert_id"], interval_seconds=7200)
    return g.select("attack_type", "severity", F.unix_micros("opened_at").alias("opened_us"), "alerts", F.unix_micros("last_alert").alias("last_us"),
                    F.unix_micros("notify_at").alias("notify_us"))


@query("alert_repeats", ctes("alerts", extra=greedy("alerts", "attack_type || severity", 14400 * 1_000_000, "alert_id"), recursive=True) + """
    SELECT alert_id, attack_type, severity, row_number() OVER (PARTITION BY attack_type, severity ORDER BY us, alert_id) - 1 AS repeat
    FROM o JOIN g USING (gk, rn) WHERE kept""")
def alert_repeats(spark, sf_dir):
    r = ops.repeated_notifications(src.alerts(spark, sf_dir), ["alert_id"], repeat_seconds=14400)
    return r.select("alert_id", "attack_type", "severity", "repeat")


@query("alert_history", ctes("alerts") + "SELECT alert_id, severity FROM alerts ORDER BY us DESC, alert_id DESC LIMIT 100")
def alert_history(spark, sf_dir):
    return ops.history(src.alerts(spark, sf_dir), 100, ["alert_id"]).select("alert_id", "severity")


@query("attack_types", ctes("alerts") + "SELECT DISTINCT attack_type FROM alerts")
def attack_types(spark, sf_dir):
    return src.alerts(spark, sf_dir).select("attack_type").distinct()
