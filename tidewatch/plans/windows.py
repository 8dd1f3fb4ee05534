"""Window, rolling and detection queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FloodLimits, RollingSettings, ThresholdSettings
from ..functions.net import http_request
from ..functions.numeric import finite, r6
from ..operators import detect, rolling, windows
from ..session import cut_lineage
from ..sources import events as src
from .base import SIZES, ctes, query
from .base import r6 as q6

# Limits scaled to the traffic of the test tables.
SCALED = replace(ThresholdSettings(), pps=0.01, bps=10.0, fps=0.001, pps_per_ip=0.01, connections_per_ip=0.0005, syn_ratio=0.5,
                 syn_min_pps=0.01, udp_ratio=0.3, udp_min_pps=0.01, icmp_ratio=0.3, icmp_min_pps=0.01)
KEY = ["window_size", "window_start"]


def features(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    return windows.traffic_features(src.flows(spark, sf_dir), SIZES, top=top)


def stored(windows_frame: DataFrame) -> DataFrame:
    """The window table written once: ranking and frames read it twice, and it is small next to the flows."""
    return cut_lineage(windows_frame)


@query("win_totals", ctes("features") + f"""
    SELECT window_size, window_start, total_packets, total_bytes, total_flows, {q6('pps')} AS pps, {q6('bps')} AS bps,
      {q6('fps')} AS fps FROM features""")
def win_totals(spark, sf_dir):
    t = windows.rates(windows.window_totals(src.flows(spark, sf_dir), SIZES))
    return t.select(*KEY, "total_packets", "total_bytes", "total_flows", r6("packets_per_second").alias("pps"),
                    r6("bytes_per_second").alias("bps"), r6("flows_per_second").alias("fps"))


@query("win_distinct", ctes("summaries") + """
    SELECT window_size, window_start, unique_src_ips, unique_dst_ips, unique_src_ports, unique_dst_ports FROM summaries""")
def win_distinct(spark, sf_dir):
    counts = windows.key_counts(src.flows(spark, sf_dir), SIZES)
    return windows.key_summaries(counts, list(windows.DIMENSIONS)).select(
        *KEY, "unique_src_ips", "unique_dst_ips", "unique_src_ports", "unique_dst_ports")


@query("win_entropy", ctes("features") + f"""
    SELECT window_size, window_start, {q6('entropy_src_ip')} AS entropy_src_ip, {q6('entropy_dst_ip')} AS entropy_dst_ip,
      {q6('entropy_src_port')} AS entropy_src_port, {q6('entropy_dst_port')} AS entropy_dst_port,
      {q6('total_packets / unique_src_ips::DOUBLE')} AS packets_per_ip FROM features""")
def win_entropy(spark, sf_dir):
    f = features(spark, sf_dir, top=0)
    return f.select(*KEY, *[r6(c).alias(c) for c in ("entropy_src_ip", "entropy_dst_ip", "entropy_src_port",
                                                     "entropy_dst_port", "packets_per_ip")])


@query("win_protocol_ratio", ctes("features") + f"""
    SELECT window_size, window_start, {q6('tcp_ratio')} AS tcp_ratio, {q6('udp_ratio')} AS udp_ratio, {q6('icmp_ratio')} AS icmp_ratio
    FROM features""")
def win_protocol_ratio(spark, sf_dir):
    t = windows.rates(windows.window_totals(src.flows(spark, sf_dir), SIZES))
    return t.select(*KEY, *[r6(c).alias(c) for c in ("tcp_ratio", "udp_ratio", "icmp_ratio")])


@query("win_flag_ratio", ctes("features") + f"""
    SELECT window_size, window_start, syn, rst, fin, {q6('syn_ratio')} AS syn_ratio, {q6('rst_ratio')} AS rst_ratio,
      {q6('fin_ratio')} AS fin_ratio FROM features""")
def win_flag_ratio(spark, sf_dir):
    t = windows.rates(windows.window_totals(src.flows(spark, sf_dir), SIZES))
    return t.select(*KEY, "syn", "rst", "fin", *[r6(c).alias(c) for c in ("syn_ratio", "rst_ratio", "fin_ratio")])


@query("win_packet_size", ctes("totals") + f"""
    SELECT window_size, window_start, {q6('size_mean')} AS avg_packet_size, {q6('size_std')} AS packet_size_std, min_packet_size,
      max_packet_size FROM totals""")
def win_packet_size(spark, sf_dir):
    t = windows.rates(windows.window_totals(src.flows(spark, sf_dir), SIZES))
    return t.select(*KEY, r6("avg_packet_size").alias("avg_packet_size"), r6("packet_size_std").alias("packet_size_std"),
                    "min_packet_size", "max_packet_size")


@query("win_top_talkers", ctes("ranked") + """
    SELECT window_size, window_start, dim, key, weight, rank::INT AS rank FROM ranked WHERE rank <= 10""")
def win_top_talkers(spark, sf_dir):
    return windows.top_keys(windows.key_counts(src.flows(spark, sf_dir), SIZES), 10)


@query("win_protocol_counts", ctes("fw") + """
    SELECT window_size, window_start, CAST(protocol AS VARCHAR) AS protocol, CAST(sum(packets) AS BIGINT) AS weight
    FROM fw GROUP BY ALL""")
def win_protocol_counts(spark, sf_dir):
    counts = windows.key_counts(src.flows(spark, sf_dir), SIZES, ["protocol"])
    maps = windows.key_maps(counts, ["protocol"])
    return maps.select(*KEY, F.explode("protocol_counts").alias("protocol", "weight"))


@query("win_current", ctes("totals") + """
    SELECT window_size, window_start, total_packets, total_flows FROM totals t
    WHERE window_start = (SELECT max(window_start) FROM totals u WHERE u.window_size = t.window_size)""")
def win_current(spark, sf_dir):
    t = windows.window_totals(src.flows(spark, sf_dir), SIZES)
    return windows.latest_windows(t).select(*KEY, "total_packets", "total_flows")


@query("win_first_hit", ctes("flows", extra={"lo": "SELECT min(us) AS m FROM flows"}) + """
    SELECT us - (us - m) % 5400000000 AS window_start_us, CAST(sum(packets) AS BIGINT) AS total_packets, count(*) AS total_flows
    FROM flows, lo GROUP BY 1""")
def win_first_hit(spark, sf_dir):
    return windows.first_hit_windows(src.flows(spark, sf_dir), 5400)


@query("traffic_features", ctes("features") + f"""
    SELECT window_size, window_start, total_packets, {q6('pps')} AS pps, unique_src_ips, {q6('entropy_src_ip')} AS entropy_src_ip,
      {q6('tcp_ratio')} AS tcp_ratio, {q6('1 - (tcp_ratio + udp_ratio + icmp_ratio)')} AS other_ratio, {q6('syn_ratio')} AS syn_ratio,
      top_src, top_dst,
      tcp_ratio >= 0.5 AND syn_ratio > 0.8 AND (unique_src_ips > 100 OR pps > 10000) AS is_syn_flood,
      udp_ratio > 0.8 AND pps > 15000 AS is_udp_flood, icmp_ratio > 0.6 AND pps > 5000 AS is_icmp_flood FROM features""")
def traffic_features(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select(
        *KEY, "total_packets", r6("packets_per_second").alias("pps"), "unique_src_ips", r6("entropy_src_ip").alias("entropy_src_ip"),
        r6("tcp_ratio").alias("tcp_ratio"), r6("other_ratio").alias("other_ratio"), r6("syn_ratio").alias("syn_ratio"),
        F.array_join(detect.top_addresses(f, "src"), ",").alias("top_src"),
        F.array_join(detect.top_addresses(f, "dst"), ",").alias("top_dst"), "is_syn_flood", "is_udp_flood", "is_icmp_flood")


def with_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the method of the request line that those to port 80 carry."""
    method = F.expr("case event_id % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'PATCH' else 'HEAD' end")
    line = F.when(F.col("dport") == 80, F.concat(method, F.lit(" /p/"), F.col("k"), F.lit(" HTTP/1.1")))
    return src.flows(spark, sf_dir).withColumn("http_method", http_request(line)["method"])


FLOODS = FloodLimits(syn_ratio=0.45, syn_sources=20, syn_pps=0.1, udp_share=0.22, udp_pps=0.02, icmp_share=0.22, icmp_pps=0.02, http_per_second=0.0004)


@query("flood_flags", ctes("features", extra={"h": """
    SELECT s.window_size, us // 1000000 // s.window_size * s.window_size AS window_start, count(*) AS http FROM flows, sizes s
    WHERE dport = 80 AND event_id % 4 <> 2 GROUP BY 1, 2"""}) + f"""
    SELECT f.window_size, f.window_start, coalesce(http, 0) AS http_requests,
      tcp_ratio >= 0.5 AND syn_ratio > {FLOODS.syn_ratio} AND (unique_src_ips > {FLOODS.syn_sources} OR pps > {FLOODS.syn_pps}) AS is_syn_flood,
      udp_ratio > {FLOODS.udp_share} AND pps > {FLOODS.udp_pps} AS is_udp_flood, icmp_ratio > {FLOODS.icmp_share} AND pps > {FLOODS.icmp_pps} AS is_icmp_flood,
      coalesce(http, 0) / f.window_size::DOUBLE > {FLOODS.http_per_second} AS is_http_flood
    FROM features f LEFT JOIN h ON f.window_size = h.window_size AND f.window_start = h.window_start""")
def flood_flags(spark, sf_dir):
    """Indicators with limits scaled to the test traffic; HTTP requests are read from request lines."""
    f = windows.traffic_features(with_requests(spark, sf_dir), SIZES, top=0, limits=FLOODS)
    return f.select(*KEY, "http_requests", "is_syn_flood", "is_udp_flood", "is_icmp_flood", "is_http_flood")


VECTOR_SQL = ["total_packets", "total_bytes", "total_flows", "pps", "bps", "fps", "unique_src_ips", "unique_dst_ips",
              "entropy_src_ip", "entropy_dst_ip", "entropy_src_port", "entropy_dst_port", "tcp_ratio", "udp_ratio",
              "icmp_ratio", "size_mean", "size_std", "syn_ratio", "rst_ratio",
              "(tcp_ratio >= 0.5 AND syn_ratio > 0.8 AND (unique_src_ips > 100 OR pps > 10000))::INT",
              "(udp_ratio > 0.8 AND pps > 15000)::INT", "(icmp_ratio > 0.6 AND pps > 5000)::INT", "0"]


@query("traffic_vector", ctes("features") + "SELECT window_size, window_start, u.position, " + q6("u.x") + """ AS x FROM features,
    LATERAL (SELECT unnest([""" + ", ".join(f"least(1e6, ({c})::DOUBLE)" for c in VECTOR_SQL) + """]) AS x,
      unnest(range(23)) AS position) u""")
def traffic_vector(spark, sf_dir):
    f = features(spark, sf_dir, top=0)
    clean = F.array(*[finite(F.col(c).cast("double")) for c in windows.TRAFFIC_VECTOR])
    rows = windows.feature_vector(f).select(*KEY, F.posexplode(clean).alias("position", "x"))
    return rows.select(*KEY, F.col("position").cast("bigint").alias("position"), r6("x").alias("x"))


ROLL = {"w": f"""SELECT *, count(*) OVER f AS n, avg(pps) OVER f AS pm, stddev_pop(pps) OVER f AS ps, avg(entropy_src_ip) OVER f AS em,
    stddev_pop(entropy_src_ip) OVER f AS es FROM features
    WINDOW f AS (PARTITION BY window_size ORDER BY window_start ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
        "z": """SELECT *, CASE WHEN n >= 10 AND ps > 1e-12 THEN round(abs(pps - pm) / ps, 9) END AS zp,
    CASE WHEN n >= 10 AND es > 1e-12 THEN round((entropy_src_ip - em) / es, 9) END AS ze FROM w"""}


@query("rolling_zscore", ctes("features", extra=ROLL) + f"""
    SELECT window_size, window_start, {q6('CASE WHEN n >= 10 THEN pm END')} AS mean_packets, {q6('zp')} AS z_packets, {q6('ze')} AS z_entropy,
      coalesce(zp > 3, FALSE) AS is_anomaly_packets, coalesce(ze < -3, FALSE) AS is_anomaly_entropy,
      {q6('greatest(0.0::DOUBLE, CASE WHEN zp > 3 THEN zp END, CASE WHEN ze < -3 THEN -ze END)')} AS anomaly_score FROM z""")
def rolling_zscore(spark, sf_dir):
    z = rolling.rolling_zscore(stored(features(spark, sf_dir, top=0)), RollingSettings())
    return z.select(*KEY, r6("rolling_mean_packets").alias("mean_packets"), r6("z_packets").alias("z_packets"),
                    r6("z_entropy").alias("z_entropy"), "is_anomaly_packets", "is_anomaly_entropy", r6("anomaly_score").alias("anomaly_score"))


@query("packet_rate_events", ctes("features", extra=ROLL) + f"""
    SELECT window_size, window_start, {q6('zp')} AS z_packets, 'packet_rate_anomaly' AS detection_type FROM z WHERE zp > 3""")
def packet_rate_events(spark, sf_dir):
    z = rolling.packet_rate_events(rolling.rolling_zscore(stored(features(spark, sf_dir, top=0))))
    return z.select(*KEY, r6("z_packets").alias("z_packets"), "detection_type")


DYN = {"d0": """SELECT *, count(*) OVER f AS n, avg(pps) OVER f AS pm, stddev_pop(pps) OVER f AS ps, avg(entropy_src_ip) OVER f AS em,
    stddev_pop(entropy_src_ip) OVER f AS es FROM features
    WINDOW f AS (PARTITION BY window_size ORDER BY window_start ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
       "d": f"""SELECT *, CASE WHEN n >= 10 THEN greatest(pm + 3 * ps, {SCALED.pps}::DOUBLE) ELSE {SCALED.pps}::DOUBLE END AS pps_limit,
    CASE WHEN n >= 10 THEN greatest(0.0::DOUBLE, least(em - 3 * es, 0.7::DOUBLE)) ELSE 0.7::DOUBLE END AS entropy_lower,
    CASE WHEN n >= 10 THEN em END AS entropy_baseline,
    CASE WHEN n >= 10 THEN greatest(0.7::DOUBLE, em - 0.2) END AS entropy_limit FROM d0"""}


@query("dyn_threshold", ctes("features", extra=DYN) + f"""
    SELECT window_size, window_start, {q6('pps_limit')} AS pps_limit, {q6('entropy_lower')} AS entropy_lower FROM d""")
def dyn_threshold(spark, sf_dir):
    d = rolling.dynamic_thresholds(stored(features(spark, sf_dir, top=0)), SCALED)
    return d.select(*KEY, r6("pps_limit").alias("pps_limit"), r6("entropy_lower").alias("entropy_lower"))


@query("entropy_baseline", ctes("features", extra=DYN) + f"""
    SELECT window_size, window_start, {q6('entropy_baseline')} AS entropy_baseline, {q6('entropy_limit')} AS entropy_limit FROM d""")
def entropy_baseline(spark, sf_dir):
    d = rolling.dynamic_thresholds(stored(features(spark, sf_dir, top=0)), SCALED)
    return d.select(*KEY, r6("entropy_baseline").alias("entropy_baseline"), r6("entropy_limit").alias("entropy_limit"))


RULES = {**DYN, "raised": f"""
    SELECT window_size, window_start, 'volumetric_pps' AS rule, 'pps_flood' AS attack_type,
      CASE WHEN pps / pps_limit > 5 THEN 'critical' WHEN pps / pps_limit > 2 THEN 'high' ELSE 'medium' END AS severity,
      least(0.99::DOUBLE, 0.5 + (pps / pps_limit - 1) * 0.2) AS confidence, pps AS current_value, pps_limit AS threshold_value, top_src AS ips
      FROM d WHERE pps > {SCALED.pps} AND pps > pps_limit
    UNION ALL SELECT window_size, window_start, 'syn_flood', 'syn_flood', 'high', least(0.95::DOUBLE, syn_ratio), syn_ratio, {SCALED.syn_ratio}, top_dst
      FROM d WHERE syn_ratio > {SCALED.syn_ratio} AND pps > {SCALED.syn_min_pps}
    UNION ALL SELECT window_size, window_start, 'udp_flood', 'udp_flood', 'high', least(0.9::DOUBLE, udp_ratio), udp_ratio, {SCALED.udp_ratio}, top_dst
      FROM d WHERE udp_ratio > {SCALED.udp_ratio} AND pps > {SCALED.udp_min_pps}
    UNION ALL SELECT window_size, window_start, 'entropy_anomaly', 'distributed_entropy', CASE WHEN entropy_src_ip < 0.2 THEN 'high' ELSE 'medium' END,
      least(0.95::DOUBLE, 0.5 + entropy_baseline - entropy_src_ip), entropy_src_ip, entropy_baseline, top_src FROM d WHERE entropy_src_ip < entropy_limit"""}


def raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rolling.dynamic_thresholds(stored(features(spark, sf_dir)), SCALED)
    return detect.raise_alerts(d, detect.threshold_rules(d, SCALED), SCALED)


def alert_columns(alerts: DataFrame) -> DataFrame:
    return alerts.select(*KEY, "rule", "attack_type", "severity", r6("confidence").alias("confidence"),
                         r6("current_value").alias("current_value"), r6("threshold_value").alias("threshold_value"),
                         F.array_join("affected_ips", ",").alias("ips"))


ALERT_SQL = f"""SELECT window_size, window_start, rule, attack_type, severity, {q6('confidence')} AS confidence,
    {q6('current_value')} AS current_value, {q6('threshold_value')} AS threshold_value, ips FROM """


@query("threshold_alerts", ctes("features", extra=RULES) + ALERT_SQL + "raised")
def threshold_alerts(spark, sf_dir):
    return alert_columns(raised(spark, sf_dir))


@query("declared_alerts", ctes("features", extra={"raised": f"""
    SELECT window_size, window_start, 'volumetric_bps' AS rule, 'bandwidth_flood' AS attack_type,
      CASE WHEN bps / {SCALED.bps} > 5 THEN 'critical' WHEN bps / {SCALED.bps} > 2 THEN 'high' ELSE 'medium' END AS severity,
      least(0.99::DOUBLE, 0.5 + (bps / {SCALED.bps} - 1) * 0.2) AS confidence, bps AS current_value, {SCALED.bps} AS threshold_value, top_src AS ips
      FROM features WHERE bps > {SCALED.bps}
    UNION ALL SELECT window_size, window_start, 'flow_rate', 'connection_flood',
      CASE WHEN fps / {SCALED.fps} > 5 THEN 'critical' WHEN fps / {SCALED.fps} > 2 THEN 'high' ELSE 'medium' END,
      least(0.99::DOUBLE, 0.5 + (fps / {SCALED.fps} - 1) * 0.2), fps, {SCALED.fps}, top_src FROM features WHERE fps > {SCALED.fps}
    UNION ALL SELECT window_size, window_start, 'icmp_flood', 'icmp_flood', 'high', least(0.9::DOUBLE, icmp_ratio), icmp_ratio, {SCALED.icmp_ratio}, top_dst
      FROM features WHERE icmp_ratio > {SCALED.icmp_ratio} AND pps > {SCALED.icmp_min_pps}"""}) + ALERT_SQL + "raised")
def declared_alerts(spark, sf_dir):
    f = features(spark, sf_dir)
    return alert_columns(detect.raise_alerts(f, detect.declared_rules(f, SCALED), SCALED))


@query("per_source_alerts", ctes("flows", extra={"r": """
    SELECT us // 3600000000 * 3600 AS window_start, ip_src, sum(packets) / 3600.0::DOUBLE AS pps, count(*) / 3600.0::DOUBLE AS connections
    FROM flows GROUP BY 1, 2"""}) + f"""
    SELECT window_start, ip_src, 'per_ip_pps' AS rule, {q6('pps')} AS value FROM r WHERE pps > {SCALED.pps_per_ip}
    UNION ALL SELECT window_start, ip_src, 'per_ip_connections', {q6('connections')} FROM r WHERE connections > {SCALED.connections_per_ip}""")
def per_source_alerts(spark, sf_dir):
    a = detect.per_source_alerts(src.flows(spark, sf_dir), 3600, SCALED)
    return a.withColumn("value", r6("value"))


@query("per_subnet_rates", ctes("flows", extra={"r": """
    SELECT us // 3600000000 * 3600 AS window_start, ip_src, sum(packets) / 3600.0::DOUBLE AS pps FROM flows GROUP BY 1, 2"""}) + f"""
    SELECT window_start, regexp_replace(ip_src, '[0-9]+$', '0/24') AS subnet, {q6('sum(pps)')} AS pps, count(*) AS sources FROM r GROUP BY 1, 2""")
def per_subnet_rates(spark, sf_dir):
    return detect.per_subnet_rates(src.flows(spark, sf_dir), 3600).withColumn("pps", r6("pps"))


TIERS = {"pps": {"low": 0.02, "medium": 0.2, "high": 1.0, "critical": 4.0}, "fps": {"low": 0.0005, "medium": 0.004, "high": 0.02, "critical": 0.1}}
TIER_ROWS = ", ".join(f"('{m}', '{s}', {i}, {v}::DOUBLE)" for m, levels in TIERS.items() for i, (s, v) in enumerate(levels.items(), 1))


@query("severity_tiers", ctes("features", extra={
    "tiers": f"SELECT * FROM (VALUES {TIER_ROWS}) t(metric, severity, rank, min_value)",
    "v": "SELECT window_size, window_start, 'pps' AS metric, pps AS value FROM features UNION ALL SELECT window_size, window_start, 'fps', fps FROM features"}) + f"""
    SELECT window_size, window_start, v.metric, {q6('any_value(value)')} AS value, arg_max(severity, rank) AS severity, max(min_value) AS limit_value
    FROM v JOIN tiers t ON t.metric = v.metric AND value >= min_value GROUP BY window_size, window_start, v.metric""")
def severity_tiers(spark, sf_dir):
    t = windows.rates(windows.window_totals(src.flows(spark, sf_dir), SIZES))
    values = t.select(*KEY, F.explode(F.array(
        F.struct(F.lit("pps").alias("metric"), F.col("packets_per_second").alias("value")),
        F.struct(F.lit("fps").alias("metric"), F.col("flows_per_second").alias("value")))).alias("m")).select(*KEY, "m.*")
    hit = detect.tier_lookup(values, detect.tier_table(spark, TIERS))
    return hit.select(*KEY, "metric", r6("value").alias("value"), "severity", F.col("limit").alias("limit_value"))


SCALES = {"pps": 2e-6, "bps": 1e-7, "fps": 1e-6, "http_rate": 4e-7, "syn_ratio": 0.6, "syn_rate": 5e-6, "udp_ratio": 0.3, "udp_rate": 2e-6,
          "icmp_ratio": 0.45, "icmp_rate": 5e-6, "pps_per_ip": 5e-7, "pps_per_subnet": 5e-7, "bps_per_ip": 5e-9, "http_per_ip": 2.7e-6}
LADDERS = detect.scaled_tiers(SCALES)


def ladder_sql(value: str, metric: str) -> str:
    steps = sorted(LADDERS[metric].values(), reverse=True)
    return "CASE " + " ".join(f"WHEN {value} >= {v!r}::DOUBLE THEN {4 - i}" for i, v in enumerate(steps)) + " END"


def severity_sql(rank: str) -> str:
    return f"CASE {rank} WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' END"


TIER_UNION = " UNION ALL ".join(
    [f"SELECT window_size, window_start, '{m}' AS metric, {ladder_sql(c, m)} AS rank FROM w" for m, c in (
        ("pps", "pps"), ("bps", "bps"), ("fps", "fps"), ("http_rate", "http / window_size::DOUBLE"))]
    + [f"SELECT window_size, window_start, '{k}_flood', CASE WHEN ({ladder_sql(f'{k}_ratio', f'{k}_ratio')}) IS NOT NULL AND ({ladder_sql('pps', f'{k}_rate')}) IS NOT NULL "
       f"THEN least({ladder_sql(f'{k}_ratio', f'{k}_ratio')}, {ladder_sql('pps', f'{k}_rate')}) END FROM w" for k in ("syn", "udp", "icmp")])


@query("window_tiers", ctes("features", extra={"h": """
    SELECT s.window_size, us // 1000000 // s.window_size * s.window_size AS window_start, count(*) AS http FROM flows, sizes s
    WHERE dport = 80 AND event_id % 4 <> 2 GROUP BY 1, 2""", "w": """
    SELECT f.*, coalesce(http, 0) AS http FROM features f LEFT JOIN h ON f.window_size = h.window_size AND f.window_start = h.window_start""",
    "t": TIER_UNION}) + f"SELECT window_size, window_start, metric, {severity_sql('rank')} AS severity FROM t WHERE rank IS NOT NULL")
def window_tiers(spark, sf_dir):
    return detect.window_tiers(windows.traffic_features(with_requests(spark, sf_dir), SIZES, top=0), LADDERS)


@query("address_tiers", ctes("flows", extra={"r": """
    SELECT us // 3600000000 * 3600 AS window_start, ip_src, sum(packets) / 3600.0::DOUBLE AS pps, sum(bytes) / 3600.0::DOUBLE AS bps,
      count(*) FILTER (dport = 80 AND event_id % 4 <> 2) / 3600.0::DOUBLE AS http FROM flows GROUP BY 1, 2""", "t": f"""
    SELECT window_start, ip_src AS subject, 'pps_per_ip' AS metric, {ladder_sql('pps', 'pps_per_ip')} AS rank FROM r
    UNION ALL SELECT window_start, ip_src, 'bps_per_ip', {ladder_sql('bps', 'bps_per_ip')} FROM r
    UNION ALL SELECT window_start, ip_src, 'http_per_ip', {ladder_sql('http', 'http_per_ip')} FROM r
    UNION ALL SELECT window_start, subnet, 'pps_per_subnet', {ladder_sql('pps', 'pps_per_subnet')}
      FROM (SELECT window_start, regexp_replace(ip_src, '[0-9]+$', '0/24') AS subnet, sum(pps) AS pps FROM r GROUP BY 1, 2)"""}) + f"""
    SELECT window_start, subject, metric, {severity_sql('rank')} AS severity FROM t WHERE rank IS NOT NULL""")
def address_tiers(spark, sf_dir):
    return detect.address_tiers(with_requests(spark, sf_dir), 3600, LADDERS)


@query("declared_tiers", ctes("features", extra={"b": """SELECT window_size, avg(pps) AS m FROM features GROUP BY 1""",
    "c": """SELECT f.*, m, CASE WHEN syn_ratio >= 0.95 AND pps >= 0.1 THEN 'critical' WHEN syn_ratio >= 0.6 AND pps >= 0.05 THEN 'high'
        WHEN syn_ratio >= 0.5 AND pps >= 0.02 THEN 'medium' WHEN syn_ratio >= 0.4 AND pps >= 0.01 THEN 'low' END AS syn_severity,
      CASE WHEN pps >= m * 10 THEN 'critical' WHEN pps >= m * 5 THEN 'high' WHEN pps >= m * 3 THEN 'medium' WHEN pps >= m * 2 THEN 'low' END AS rate_severity,
      CASE WHEN entropy_src_ip > 7 THEN 'high_critical' WHEN entropy_src_ip > 6 THEN 'high_warning' WHEN entropy_src_ip < 1 THEN 'low_critical'
        WHEN entropy_src_ip < 1.5 THEN 'low_warning' ELSE 'normal' END AS entropy_band FROM features f JOIN b USING (window_size)"""}) + """
    SELECT window_size, window_start, syn_severity, rate_severity, entropy_band, CASE syn_severity WHEN 'low' THEN 'log,rate_limit' WHEN 'medium' THEN 'rate_limit,notify'
      WHEN 'high' THEN 'block_ip,notify,cloud_shield' WHEN 'critical' THEN 'block_subnet,notify,cloud_shield,scrubber' END AS actions FROM c""")
def declared_tiers(spark, sf_dir):
    f = stored(features(spark, sf_dir, top=0))
    mean = f.groupBy("window_size").agg(F.avg("packets_per_second").alias("m"))
    pps = F.col("packets_per_second")
    t = f.join(F.broadcast(mean), "window_size")  # one row per window size
    t = t.withColumn("severity", detect.ratio_tier(
        F.col("syn_ratio"), pps, {"low": 0.4, "medium": 0.5, "high": 0.6, "critical": 0.95},
        {"low": 0.01, "medium": 0.02, "high": 0.05, "critical": 0.1})).withColumn("attack_type", F.lit("syn_flood"))
    return detect.with_actions(t).select(
        *KEY, F.col("severity").alias("syn_severity"), detect.baseline_severity(pps, F.col("m")).alias("rate_severity"),
        detect.entropy_band(F.col("entropy_src_ip"), "src_ip").alias("entropy_band"), F.array_join("actions", ",").alias("actions"))


@query("seasonal_baseline", ctes("totals", extra={
    "h": "SELECT window_size, window_start, total_packets / window_size::DOUBLE AS pps, (window_start // 3600) % 24 AS slot FROM totals",
    "s": """SELECT *, avg(pps) OVER f AS m, stddev_pop(pps) OVER f AS d, count(*) OVER f AS n FROM h
      WINDOW f AS (PARTITION BY window_size, slot ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"""}) + f"""
    SELECT window_size, window_start, slot, {q6('m')} AS season_mean, {q6('d')} AS season_std,
      CASE WHEN n >= 2 AND d > 1e-12 THEN CASE WHEN abs(pps - m) / d > 3 THEN 3 WHEN abs(pps - m) / d > 2 THEN 2
        WHEN abs(pps - m) / d > 1 THEN 1 ELSE 0 END END AS band FROM s""")
def seasonal_baseline(spark, sf_dir):
    t = windows.rates(windows.window_totals(src.flows(spark, sf_dir), SIZES))
    s = rolling.seasonal_baseline(t, "packets_per_second")
    return s.select(*KEY, "slot", r6("season_mean").alias("season_mean"), r6("season_std").alias("season_std"), "band")


@query("sequences", ctes("totals", extra={"s": """
    SELECT window_size, window_start, list(total_packets) OVER (PARTITION BY window_size ORDER BY window_start ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l
    FROM totals"""}) + """
    SELECT window_size, window_start, list_aggregate(l, 'string_agg', ',') AS seq FROM s WHERE len(l) = 10""")
def sequences(spark, sf_dir):
    t = stored(windows.window_totals(src.flows(spark, sf_dir), SIZES))
    s = rolling.sequences(t, ["window_size"], ["window_start"], F.expr("window_start div (window_size * 256)"), "total_packets", 10, 256)
    return s.select(*KEY, F.array_join(F.transform("sequence", lambda x: x.cast("string")), ",").alias("seq"))


@query("trend_planted", ctes("totals", extra={"i": """SELECT window_size, total_packets / window_size::DOUBLE + CASE window_size WHEN 3600 THEN 0.05 WHEN 21600 THEN -0.05 ELSE 0 END
      * ((window_start - 1704067200) // window_size) AS pps, row_number() OVER (PARTITION BY window_size ORDER BY window_start)::DOUBLE AS i FROM totals""",
    "s": f"SELECT window_size, count(*) AS n, {q6('regr_slope(pps, i)')} AS slope FROM i GROUP BY 1"}) + """
    SELECT *, CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def trend_planted(spark, sf_dir):
    """One size rises and one falls."""
    t = stored(windows.rates(windows.window_totals(src.flows(spark, sf_dir), SIZES)))
    slope = F.when(F.col("window_size") == 3600, 0.05).when(F.col("window_size") == 21600, -0.05).otherwise(0.0)
    t = t.withColumn("value", F.col("packets_per_second") + slope * F.expr("(window_start - 1704067200) div window_size"))
    return rolling.trend(t, ["window_size"], "window_start", "value", F.expr("window_start div (window_size * 256)"))


@query("trend", ctes("totals", extra={"i": """SELECT window_size, total_packets / window_size::DOUBLE AS pps,
      row_number() OVER (PARTITION BY window_size ORDER BY window_start)::DOUBLE AS i FROM totals""",
    "s": f"SELECT window_size, count(*) AS n, {q6('regr_slope(pps, i)')} AS slope FROM i GROUP BY 1"}) + """
    SELECT *, CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def trend(spark, sf_dir):
    t = stored(windows.rates(windows.window_totals(src.flows(spark, sf_dir), SIZES)))
    return rolling.trend(t, ["window_size"], "window_start", "packets_per_second", F.expr("window_start div (window_size * 256)"))
