"""Flow-record queries: keys, deltas, sessions, features, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.net import has_flag, http_request
from ..functions.numeric import counter, r6
from ..operators import flows as ops
from ..operators import mitigation, rules
from ..sources import events as src
from .base import ctes, greedy, query
from .base import r6 as q6


@query("flow_keys", ctes("packet_ids") + "SELECT event_id, flow_id, split_part(flow_text, '|', 1) AS lo_ip, split_part(flow_text, '|', 3) AS hi_ip FROM packet_ids")
def flow_keys(spark, sf_dir):
    return ops.with_flow_key(src.packets(spark, sf_dir)).select("event_id", "flow_id", F.col("lo.ip").alias("lo_ip"), F.col("hi.ip").alias("hi_ip"))


@query("flow_reverse", ctes("packets") + "SELECT event_id, ip_dst AS ip_src, ip_src AS ip_dst, dport::INT AS sport, sport::INT AS dport FROM packets")
def flow_reverse(spark, sf_dir):
    rows = src.packets(spark, sf_dir).select("event_id", "ip_src", "ip_dst", "sport", "dport")
    return ops.reversed_key(rows)


@query("tcp_flags", ctes("packets") + """
    SELECT event_id, tcp_flags & 2 = 2 AS syn, tcp_flags & 18 = 18 AS syn_ack, tcp_flags & 4 = 4 AS rst, tcp_flags & 1 = 1 AS fin
    FROM packets WHERE protocol = 6""")
def tcp_flags(spark, sf_dir):
    p = src.packets(spark, sf_dir).filter("protocol = 6")
    f = F.col("tcp_flags")
    return p.select("event_id", has_flag(f, 2).alias("syn"), has_flag(f, 18).alias("syn_ack"), has_flag(f, 4).alias("rst"), has_flag(f, 1).alias("fin"))


@query("counter_coercion", ctes("flows", extra={"t": """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN '-' || CAST(k AS VARCHAR) WHEN 2 THEN 'x' WHEN 3 THEN NULL
      ELSE CAST(packets AS VARCHAR) END AS raw FROM flows"""}) + """
    SELECT event_id, greatest(0, coalesce(TRY_CAST(raw AS BIGINT), 0)) AS n FROM t""")
def counter_coercion(spark, sf_dir):
    raw = (F.when(F.expr("event_id % 5 = 0"), F.col("k").cast("string")).when(F.expr("event_id % 5 = 1"), F.concat(F.lit("-"), F.col("k").cast("string")))
           .when(F.expr("event_id % 5 = 2"), "x").when(F.expr("event_id % 5 = 3"), None).otherwise(F.col("packets").cast("string")))
    return src.flows(spark, sf_dir).select("event_id", counter(raw).alias("n"))


@query("http_requests", ctes("flows", extra={"t": """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PATCH' ELSE 'HEAD' END || ' /p/' || k || ' HTTP/1.1' AS line
    FROM flows WHERE dport = 80"""}) + """
    SELECT event_id, regexp_extract(line, '^([A-Z]+) ([^ ]+)', 1) AS method, regexp_extract(line, '^([A-Z]+) ([^ ]+)', 2) AS path
    FROM t WHERE event_id % 4 <> 2""")
def http_requests(spark, sf_dir):
    f = src.flows(spark, sf_dir).filter("dport = 80")
    method = F.expr("case event_id % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'PATCH' else 'HEAD' end")
    lines = f.select("event_id", F.concat(method, F.lit(" /p/"), F.col("k"), F.lit(" HTTP/1.1")).alias("line"))
    return lines.withColumn("r", http_request(F.col("line"))).filter("r is not null").select("event_id", "r.method", "r.path")


DELTA = {"l": """SELECT *, lag(total_packets) OVER w AS pp, lag(total_bytes) OVER w AS pb, lag(tcp_syn_count) OVER w AS s, lag(tcp_rst_count) OVER w AS r,
      lag(tcp_fin_count) OVER w AS f FROM snapshots WINDOW w AS (PARTITION BY flow_id ORDER BY us, event_id)""",
         "m": """SELECT *, pp IS NULL OR total_packets < pp OR total_bytes < pb OR tcp_syn_count < s OR tcp_rst_count < r OR tcp_fin_count < f AS restart FROM l""",
         "deltas": """SELECT event_id, flow_id, us, CASE WHEN restart THEN total_packets ELSE total_packets - pp END AS total_packets,
      CASE WHEN restart THEN total_bytes ELSE total_bytes - pb END AS total_bytes, CASE WHEN restart THEN tcp_syn_count ELSE tcp_syn_count - s END AS tcp_syn_count,
      CASE WHEN restart THEN tcp_rst_count ELSE tcp_rst_count - r END AS tcp_rst_count, CASE WHEN restart THEN tcp_fin_count ELSE tcp_fin_count - f END AS tcp_fin_count FROM m"""}
DELTA_SQL = ctes("snapshots", extra=DELTA) + """SELECT event_id, flow_id, total_packets, total_bytes, tcp_syn_count, tcp_rst_count, tcp_fin_count FROM deltas
    WHERE greatest(total_packets, total_bytes, tcp_syn_count, tcp_rst_count, tcp_fin_count) > 0"""


@query("flow_delta", DELTA_SQL)
def flow_delta(spark, sf_dir):
    snaps = src.snapshots_from(src.flows(spark, sf_dir))
    return ops.counter_deltas(snaps, ["event_id"]).select("event_id", "flow_id", *ops.COUNTERS)


@query("snapshot_throttle", ctes("snapshots", extra=greedy("snapshots", "flow_id", 7200 * 1_000_000, "event_id"), recursive=True) + """
    SELECT o.event_id, o.flow_id FROM o JOIN g USING (gk, rn) WHERE kept""")
def snapshot_throttle(spark, sf_dir):
    snaps = src.snapshots_from(src.flows(spark, sf_dir))
    return mitigation.fresh_snapshots(snaps, 7_200_000, ["event_id"]).select("event_id", "flow_id")


SESSIONS = {
    "o": """SELECT *, row_number() OVER w AS rn, us - lag(us) OVER w AS gap,
        protocol = 6 AND (tcp_flags & 1 = 1 OR tcp_flags & 4 = 4) AS closes FROM packet_ids WINDOW w AS (PARTITION BY flow_id ORDER BY us, event_id)""",
    "g": """SELECT flow_id, rn, us AS start, rn AS first_rn, closes AS done FROM o WHERE rn = 1
        UNION ALL SELECT o.flow_id, o.rn, CASE WHEN g.done OR o.gap > 30000000 THEN o.us ELSE g.start END,
          CASE WHEN g.done OR o.gap > 30000000 THEN o.rn ELSE g.first_rn END,
          o.closes OR (NOT (g.done OR o.gap > 30000000) AND o.us - g.start > 60000000)
        FROM g JOIN o ON o.flow_id = g.flow_id AND o.rn = g.rn + 1""",
    "s": "SELECT o.*, g.start, g.first_rn FROM o JOIN g USING (flow_id, rn)",
    "h": "SELECT flow_id, first_rn, ip_src AS h_src, ip_dst AS h_dst, sport AS h_sport, dport AS h_dport FROM s WHERE rn = first_rn",
    "j": """SELECT s.*, h_src, h_dst, h_sport, h_dport, s.ip_src = h_src AND s.sport = h_sport AS fwd,
        CASE WHEN rn > first_rn AND gap > 0 AND gap < 60000000 THEN gap / 1e6 END AS iat FROM s JOIN h USING (flow_id, first_rn)""",
    "rec": """SELECT flow_id, min(us) AS first_us, max(us) AS last_us, any_value(h_src) AS ip_src, any_value(h_dst) AS ip_dst, count(*) FILTER (fwd) AS packets,
        coalesce(sum(length) FILTER (fwd), 0)::BIGINT AS bytes, count(*) FILTER (NOT fwd) AS packets_reverse, coalesce(sum(length) FILTER (NOT fwd), 0)::BIGINT AS bytes_reverse,
        count(*) FILTER (tcp_flags & 2 = 2) AS tcp_syn_count, count(*) FILTER (tcp_flags & 18 = 18) AS tcp_syn_ack_count,
        count(*) FILTER (tcp_flags & 4 = 4) AS tcp_rst_count, count(*) FILTER (tcp_flags & 1 = 1) AS tcp_fin_count,
        coalesce(avg(tcp_window), 0) AS tcp_window_avg, coalesce(stddev_pop(tcp_window), 0) AS tcp_window_std, coalesce(avg(udp_len), 0) AS udp_payload_avg,
        coalesce(avg(iat), 0) AS interarrival_mean, coalesce(stddev_pop(iat), 0) AS interarrival_std FROM j GROUP BY flow_id, first_rn"""}


def records(spark, sf_dir):
    return ops.flow_records(src.packets(spark, sf_dir), ["event_id"])


@query("packet_sessions", ctes("packet_ids", extra=SESSIONS, recursive=True) + f"""
    SELECT flow_id, first_us, last_us, ip_src, ip_dst, packets, bytes, packets_reverse, bytes_reverse, tcp_syn_count, tcp_syn_ack_count, tcp_rst_count,
      tcp_fin_count, {q6('tcp_window_avg')} AS tcp_window_avg, {q6('tcp_window_std')} AS tcp_window_std, {q6('udp_payload_avg')} AS udp_payload_avg,
      {q6('interarrival_mean * 1000')} AS interarrival_mean_ms, {q6('interarrival_std * 1000')} AS interarrival_std_ms FROM rec""")
def packet_sessions(spark, sf_dir):
    r = records(spark, sf_dir)
    doubles = ["tcp_window_avg", "tcp_window_std", "udp_payload_avg"]
    gaps = ["interarrival_mean", "interarrival_std"]  # in ms: halves of a microsecond stay off the rounding edge
    return r.select("flow_id", "first_us", "last_us", "ip_src", "ip_dst", "packets", "bytes", "packets_reverse", "bytes_reverse", "tcp_syn_count",
                    "tcp_syn_ack_count", "tcp_rst_count", "tcp_fin_count", *[r6(c).alias(c) for c in doubles],
                    *[r6(F.col(c) * 1000).alias(f"{c}_ms") for c in gaps])


@query("flow_rates", ctes("packet_ids", extra={**SESSIONS, "t": """SELECT *, packets + packets_reverse AS n, bytes + bytes_reverse AS b,
      (last_us - first_us) / 1e6 AS d, split_part(any_text, '|', 5) AS protocol FROM rec JOIN (SELECT flow_id, any_value(flow_text) AS any_text FROM packet_ids GROUP BY 1) USING (flow_id)"""},
      recursive=True) + f"""
    SELECT flow_id, first_us, n AS total_packets, b AS total_bytes, {q6('d')} AS duration, {q6('CASE WHEN d > 0 THEN n / d ELSE 0 END')} AS packets_per_sec,
      {q6('CASE WHEN d > 0 THEN b / d ELSE 0 END')} AS bytes_per_sec, {q6('b / n::DOUBLE')} AS avg_packet_size,
      {q6('CASE WHEN tcp_syn_ack_count > 0 THEN tcp_syn_count / tcp_syn_ack_count::DOUBLE ELSE 0 END')} AS tcp_syn_ratio,
      protocol = '6' AND (tcp_fin_count > 0 OR tcp_rst_count > 0) AS is_complete FROM t""")
def flow_rates(spark, sf_dir):
    names = ["duration", "packets_per_sec", "bytes_per_sec", "avg_packet_size", "tcp_syn_ratio"]
    return records(spark, sf_dir).select("flow_id", "first_us", "total_packets", "total_bytes", *[r6(c).alias(c) for c in names], "is_complete")


@query("icmp_types", ctes("packet_ids") + "SELECT flow_id, icmp_type::INT AS icmp_type, count(*) AS packets FROM packet_ids WHERE protocol = 1 GROUP BY ALL")
def icmp_types(spark, sf_dir):
    return ops.icmp_types(ops.with_flow_key(src.packets(spark, sf_dir)), ["flow_id"])


@query("flow_features", ctes("flows", extra={"f": """
    SELECT event_id, protocol, packets, bytes, tcp_syn_count, k, 0.5 + k / 4.0::DOUBLE AS duration, k % 4 AS acks FROM flows""", "v": """
    SELECT event_id, [packets, bytes, bytes / packets::DOUBLE, packets / duration, bytes / duration, duration, k / 8.0::DOUBLE, k / 16.0::DOUBLE,
      CASE WHEN protocol = 6 AND acks > 0 THEN tcp_syn_count / acks::DOUBLE ELSE 0 END,
      CASE WHEN protocol = 6 THEN 1000.0 + k ELSE 0 END, CASE WHEN protocol = 17 THEN 40.0 + k ELSE 0 END]::FLOAT[] AS vector FROM f"""}) + f"""
    SELECT event_id, place - 1 AS place, {q6('vector[place]::DOUBLE')} AS value FROM (SELECT *, unnest(generate_series(1, 11)) AS place FROM v)""")
def flow_features(spark, sf_dir):
    k, duration = F.col("k"), F.lit(0.5) + F.col("k") / 4
    f = src.flows(spark, sf_dir).withColumns({
        "duration": duration, "packets_per_sec": F.col("packets") / duration, "bytes_per_sec": F.col("bytes") / duration, "interarrival_mean": k / 8,
        "interarrival_std": k / 16, "tcp_syn_ack_count": k % 4, "tcp_window_avg": F.lit(1000.0) + k, "udp_payload_avg": F.lit(40.0) + k})
    out = ops.flow_features(f).select("event_id", F.posexplode("vector").alias("place", "value"))
    return out.select("event_id", "place", r6(F.col("value").cast("double")).alias("value"))


@query("ingest_limit", ctes("packets", extra={
    "o": "SELECT *, ip_src AS gk, row_number() OVER (PARTITION BY ip_src ORDER BY us, event_id) AS rn FROM packets",
    "g": """SELECT gk, rn, [us] AS q, TRUE AS allowed FROM o WHERE rn = 1
      UNION ALL SELECT o.gk, o.rn, CASE WHEN len(list_filter(g.q, lambda x: x >= o.us - 1000000)) < 2 THEN list_append(list_filter(g.q, lambda x: x >= o.us - 1000000), o.us)
        ELSE list_filter(g.q, lambda x: x >= o.us - 1000000) END, len(list_filter(g.q, lambda x: x >= o.us - 1000000)) < 2
      FROM g JOIN o ON o.gk = g.gk AND o.rn = g.rn + 1"""}, recursive=True) + "SELECT o.event_id, g.allowed FROM o JOIN g USING (gk, rn)")
def ingest_limit(spark, sf_dir):
    return ops.limit_ingest(src.packets(spark, sf_dir), 2, ["event_id"], ["ip_src"]).select("event_id", "allowed")


@query("flow_query", ctes("flows") + "SELECT event_id, ip_src, protocol FROM flows WHERE protocol = 17 AND us BETWEEN 1704672000000000 AND 1705276800000000")
def flow_query(spark, sf_dir):
    start, end = F.timestamp_seconds(F.lit(1704672000)), F.timestamp_seconds(F.lit(1705276800))
    return ops.flow_query(src.flows(spark, sf_dir), protocol=17, start=start, end=end).select("event_id", "ip_src", "protocol")


@query("flow_query_limited", ctes("flows") + "SELECT event_id, ip_src, protocol FROM flows WHERE protocol = 6 ORDER BY us, event_id LIMIT 50")
def flow_query_limited(spark, sf_dir):
    return ops.flow_query(src.flows(spark, sf_dir), protocol=6, limit=50, tie=["event_id"]).select("event_id", "ip_src", "protocol")


@query("top_flows", ctes("flows") + "SELECT event_id, bytes FROM flows ORDER BY bytes DESC, event_id LIMIT 25")
def top_flows(spark, sf_dir):
    return ops.top_flows(src.flows(spark, sf_dir), "bytes", 25, ["event_id"]).select("event_id", "bytes")


@query("evict_oldest", ctes("flows", extra={"l": "SELECT user_id, max(us) AS last_us, max(event_id) AS e FROM flows GROUP BY 1"}) + """
    SELECT user_id, last_us FROM l WHERE (SELECT count(*) FROM l) > 10 ORDER BY last_us, user_id LIMIT 1""")
def evict_oldest(spark, sf_dir):
    last = src.flows(spark, sf_dir).groupBy("user_id").agg(F.max(F.unix_micros("ts")).alias("last_us"))
    return rules.oldest_tenth(last, ["last_us", "user_id"], 10)
