"""Query registry and the shared SQL building blocks of the checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SIZES = [3600, 21600, 86400]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold zone-less UTC times
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def r6(expression: str) -> str:
    return f"floor(({expression}) * 1000000 + 0.5) / 1000000"


# name -> (names it needs, text). Written for DuckDB.
CTES: dict[str, tuple[list[str], str]] = {
    "base": ([], """
        SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 17 ELSE 6 END AS protocol,
          '10.0.' || CAST(user_id // 250 AS VARCHAR) || '.' || CAST(user_id % 250 + 1 AS VARCHAR) AS ip_src,
          '192.168.0.' || CAST(event_id % 8 + 1 AS VARCHAR) AS ip_dst,
          CAST(1024 + (event_id * 7919) % 60000 AS INTEGER) AS sport,
          CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 8443
            WHEN 'signup' THEN 53 ELSE 0 END AS dport,
          CAST(floor(value) AS BIGINT) + 1 AS packets
        FROM events"""),
    "flows": (["base"], """
        SELECT *, packets * (60 + k * 10) AS bytes, CAST(60 + k * 10 AS DOUBLE) AS avg_packet_size,
          CASE WHEN protocol = 6 THEN (packets * k) // 100 ELSE 0 END AS tcp_syn_count,
          CASE WHEN protocol = 6 AND k % 10 = 0 THEN 1 ELSE 0 END AS tcp_rst_count,
          CASE WHEN protocol = 6 AND k % 3 = 0 THEN 1 ELSE 0 END AS tcp_fin_count,
          CASE WHEN k >= 85 THEN 1 ELSE 0 END AS is_attack, epoch_us(ts) AS us
        FROM base"""),
    "sizes": ([], "SELECT unnest([3600::BIGINT, 21600::BIGINT, 86400::BIGINT]) AS window_size"),
    "fw": (["flows", "sizes"], """
        SELECT f.*, s.window_size, (us // 1000000) // s.window_size * s.window_size AS window_start
        FROM flows f CROSS JOIN sizes s"""),
    "totals": (["fw"], """
        SELECT window_size, window_start, CAST(sum(packets) AS BIGINT) AS total_packets, CAST(sum(bytes) AS BIGINT) AS total_bytes,
          count(*) AS total_flows, CAST(sum(tcp_syn_count) AS BIGINT) AS syn, CAST(sum(tcp_rst_count) AS BIGINT) AS rst,
          CAST(sum(tcp_fin_count) AS BIGINT) AS fin,
          CAST(sum(packets) FILTER (protocol = 6) AS DOUBLE) AS w_tcp, CAST(sum(packets) FILTER (protocol = 17) AS DOUBLE) AS w_udp,
          CAST(sum(packets) FILTER (protocol = 1) AS DOUBLE) AS w_icmp, avg(CAST(avg_packet_size AS BIGINT)) AS size_mean,
          stddev_pop(CAST(avg_packet_size AS BIGINT)) AS size_std, CAST(min(avg_packet_size) AS BIGINT) AS min_packet_size,
          CAST(max(avg_packet_size) AS BIGINT) AS max_packet_size
        FROM fw GROUP BY 1, 2"""),
    "keyed": (["fw"], """
        SELECT window_size, window_start, 'src_ip' AS dim, ip_src AS key, packets FROM fw
        UNION ALL SELECT window_size, window_start, 'dst_ip', ip_dst, packets FROM fw
        UNION ALL SELECT window_size, window_start, 'src_port', CAST(sport AS VARCHAR), packets FROM fw WHERE sport <> 0
        UNION ALL SELECT window_size, window_start, 'dst_port', CAST(dport AS VARCHAR), packets FROM fw WHERE dport <> 0"""),
    "kc": (["keyed"], """
        SELECT window_size, window_start, dim, key, CAST(sum(packets) AS BIGINT) AS weight FROM keyed GROUP BY ALL"""),
    "ks": (["kc"], """
        SELECT window_size, window_start, dim, count(*) AS n, log2(sum(weight)) - sum(weight * log2(weight)) / sum(weight) AS e
        FROM kc GROUP BY ALL"""),
    "summaries": (["ks"], """
        SELECT window_size, window_start,
          coalesce(max(n) FILTER (dim = 'src_ip'), 0) AS unique_src_ips, coalesce(max(n) FILTER (dim = 'dst_ip'), 0) AS unique_dst_ips,
          coalesce(max(n) FILTER (dim = 'src_port'), 0) AS unique_src_ports, coalesce(max(n) FILTER (dim = 'dst_port'), 0) AS unique_dst_ports,
          coalesce(max(e) FILTER (dim = 'src_ip'), 0) AS entropy_src_ip, coalesce(max(e) FILTER (dim = 'dst_ip'), 0) AS entropy_dst_ip,
          coalesce(max(e) FILTER (dim = 'src_port'), 0) AS entropy_src_port, coalesce(max(e) FILTER (dim = 'dst_port'), 0) AS entropy_dst_port
        FROM ks GROUP BY 1, 2"""),
    "ranked": (["kc"], """
        SELECT *, row_number() OVER (PARTITION BY window_size, window_start, dim ORDER BY weight DESC, key) AS rank FROM kc"""),
    "tops": (["ranked"], """
        SELECT window_size, window_start, string_agg(key, ',' ORDER BY rank) FILTER (dim = 'src_ip' AND rank <= 5) AS top_src,
          string_agg(key, ',' ORDER BY rank) FILTER (dim = 'dst_ip' AND rank <= 5) AS top_dst
        FROM ranked GROUP BY 1, 2"""),
    "features": (["totals", "summaries", "tops"], """
        SELECT t.*, s.* EXCLUDE (window_size, window_start), p.top_src, p.top_dst,
          total_packets / t.window_size::DOUBLE AS pps, total_bytes / t.window_size::DOUBLE AS bps, total_flows / t.window_size::DOUBLE AS fps,
          coalesce(w_tcp, 0) / total_packets AS tcp_ratio, coalesce(w_udp, 0) / total_packets AS udp_ratio,
          coalesce(w_icmp, 0) / total_packets AS icmp_ratio,
          CASE WHEN w_tcp > 0 THEN syn / w_tcp ELSE 0 END AS syn_ratio, CASE WHEN w_tcp > 0 THEN rst / w_tcp ELSE 0 END AS rst_ratio,
          CASE WHEN w_tcp > 0 THEN fin / w_tcp ELSE 0 END AS fin_ratio
        FROM totals t JOIN summaries s USING (window_size, window_start) JOIN tops p USING (window_size, window_start)"""),
    "alerts": (["flows"], """
        SELECT event_id AS alert_id, ts, us, CASE protocol WHEN 6 THEN 'syn_flood' WHEN 17 THEN 'udp_flood' ELSE 'icmp_flood' END AS attack_type,
          CASE WHEN k >= 95 THEN 'critical' WHEN k >= 90 THEN 'high' WHEN k >= 80 THEN 'medium' ELSE 'low' END AS severity,
          k / 100.0::DOUBLE AS confidence, ip_src, ip_dst, packets, bytes
        FROM flows WHERE k >= 70"""),
    "scored": (["flows"], """
        SELECT event_id, ts, us, k / 99.0::DOUBLE AS score, CAST(k / 99.0::DOUBLE >= 0.7::DOUBLE AS INTEGER) AS pred,
          CAST((k * 7 + event_id) % 100 >= 70 OR k >= 90 AS INTEGER) AS label
        FROM flows"""),
    "packets": (["flows"], """
        SELECT event_id, (us - 1704067200000000) // 4000 + 1704067200000000 AS us, 60 + k * 10 AS length,
          CASE WHEN event_id % 2 = 0 THEN ip_src ELSE '192.168.0.' || CAST(user_id % 2 + 1 AS VARCHAR) END AS ip_src,
          CASE WHEN event_id % 2 = 0 THEN '192.168.0.' || CAST(user_id % 2 + 1 AS VARCHAR) ELSE ip_src END AS ip_dst,
          CASE WHEN event_id % 2 = 0 THEN 40000 + user_id ELSE 443 END AS sport,
          CASE WHEN event_id % 2 = 0 THEN 443 ELSE 40000 + user_id END AS dport, protocol,
          CASE WHEN protocol = 6 THEN (CASE WHEN k >= 80 THEN 2 ELSE 0 END) + (CASE WHEN k >= 90 THEN 16 ELSE 0 END)
            + (CASE WHEN k = 7 THEN 4 ELSE 0 END) + (CASE WHEN k < 4 THEN 1 ELSE 0 END) END AS tcp_flags,
          CASE WHEN protocol = 6 THEN 1000 + k END AS tcp_window, CASE WHEN protocol = 17 THEN 40 + k END AS udp_len,
          CASE WHEN protocol = 1 THEN k % 9 END AS icmp_type
        FROM flows"""),
    "packet_keys": (["packets"], """
        SELECT *, CASE WHEN ip_src < ip_dst OR (ip_src = ip_dst AND sport <= dport)
            THEN ip_src || '|' || sport || '|' || ip_dst || '|' || dport
            ELSE ip_dst || '|' || dport || '|' || ip_src || '|' || sport END || '|' || protocol AS flow_text
        FROM packets"""),
    "packet_ids": (["packet_keys"], "SELECT *, substr(sha256(flow_text), 1, 16) AS flow_id FROM packet_keys"),
    "snapshots": (["flows"], """
        SELECT event_id, ts, us, 'f' || CAST(user_id AS VARCHAR) AS flow_id, ip_src, ip_dst, protocol,
          CAST(sum(packets) OVER w AS BIGINT) AS total_packets, CAST(sum(bytes) OVER w AS BIGINT) AS total_bytes,
          CAST(sum(tcp_syn_count) OVER w AS BIGINT) AS tcp_syn_count, CAST(sum(tcp_rst_count) OVER w AS BIGINT) AS tcp_rst_count,
          CAST(sum(tcp_fin_count) OVER w AS BIGINT) AS tcp_fin_count
        FROM flows WINDOW w AS (PARTITION BY user_id, us // 604800000000 ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
}


def ctes(*names: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """`WITH` text for the named blocks and all they need, followed by the extra blocks in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({text})" for n, text in (extra or {}).items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def greedy(source: str, key: str, gap_us: int, tie: str) -> dict[str, str]:
    """Blocks `o` (rows with `key` and rank) and `g` (kept flag and last kept time) for greedy spacing."""
    return {
        "o": f"SELECT *, {key} AS gk, row_number() OVER (PARTITION BY {key} ORDER BY us, {tie}) AS rn FROM {source}",
        "g": f"""SELECT gk, rn, us AS last, TRUE AS kept FROM o WHERE rn = 1
            UNION ALL SELECT o.gk, o.rn, CASE WHEN o.us - g.last >= {gap_us} THEN o.us ELSE g.last END, o.us - g.last >= {gap_us}
            FROM g JOIN o ON o.gk = g.gk AND o.rn = g.rn + 1"""}
