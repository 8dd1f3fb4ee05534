"""Rule matching and replay, mitigation plans, redirects, enrichment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..config import RedirectSettings, ShieldSettings
from ..functions.net import cidr_high, cidr_low, ipv4_number
from ..functions.numeric import r6
from ..operators import metrics, mitigation, windows
from ..operators import rules as ops
from ..operators.enrich import range_lookup
from ..sources import events as src
from .base import SIZES, ctes, query
from .base import r6 as q6
from .windows import stored

DAY = 86400
START = datetime(2024, 1, 5)
RULES = [
    ops.limit_ip("r1", "10.0.0.7", START, pps=3, seconds=10 * DAY), ops.limit_subnet("r2", "10.0.0.0/26", START, pps=5, seconds=20 * DAY),
    ops.limit_protocol("r3", 17, 4, START, seconds=15 * DAY), ops.limit_protocol("r4", 6, 6, START, seconds=25 * DAY, port=443),
    ops.limit_bandwidth("r5", "10.0.0.9", 4096, START, seconds=20 * DAY), ops.limit_subnet("r6", "10.0.0.77/12", START, pps=2, seconds=DAY)]
RULE_SQL = """SELECT *, epoch_us(created_at) AS c_us, epoch_us(expires_at) AS e_us FROM (VALUES
    ('r1', 'packet', 3, 3, '10.0.0.7', NULL, NULL, NULL, NULL, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15'),
    ('r2', 'packet', 5, 5, NULL, '10.0.0.0/26', 167772160, 167772223, NULL, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-25'),
    ('r3', 'packet', 4, 4, NULL, NULL, NULL, NULL, 17, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20'),
    ('r4', 'packet', 6, 6, NULL, NULL, NULL, NULL, 6, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-30'),
    ('r5', 'byte', 512, 1024, '10.0.0.9', NULL, NULL, NULL, NULL, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-25'),
    ('r6', 'packet', 2, 2, NULL, '10.0.0.77/12', 167772160, 168820735, NULL, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06'))
    t(rule_id, limit_type, limit_value, burst_value, target_ip, target_subnet, lo, hi, rule_protocol, created_at, expires_at)"""
IP_NUMBER = "list_sum(list_transform(range(1, 5), lambda i: CAST(split_part({c}, '.', i) AS BIGINT) * CAST(pow(256, 4 - i) AS BIGINT)))"
MATCH = {"rules": RULE_SQL, "n": f"SELECT *, {IP_NUMBER.format(c='ip_src')}::BIGINT AS num FROM flows", "m": """
    SELECT n.*, r.* FROM n JOIN rules r ON (target_ip IS NULL OR target_ip = ip_src) AND (lo IS NULL OR num BETWEEN lo AND hi)
      AND (rule_protocol IS NULL OR rule_protocol = protocol) AND (rule_id <> 'r4' OR dport = 443) AND us BETWEEN c_us AND e_us"""}


@query("rule_match_cidr", ctes("flows", extra=MATCH) + "SELECT event_id, rule_id FROM m")
def rule_match_cidr(spark, sf_dir):
    return ops.match_rules(src.flows(spark, sf_dir), ops.rule_table(spark, RULES)).select("event_id", "rule_id")


def bucket_sql(source: str, key: str, rate: str, burst: str, cost: str) -> dict[str, str]:
    level = f"least(({burst}) * 1000000, g.level + (o.us - g.at) * ({rate}))"
    return {"o": f"SELECT *, {key} AS gk, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS rn FROM {source}",
            "g": f"""SELECT gk, rn, ({burst}) * 1000000 - CASE WHEN ({burst}) >= ({cost}) THEN ({cost}) * 1000000 ELSE 0 END AS level, us AS at, ({burst}) >= ({cost}) AS allowed
              FROM o WHERE rn = 1
              UNION ALL SELECT o.gk, o.rn, {level} - CASE WHEN {level} >= ({cost}) * 1000000 THEN ({cost}) * 1000000 ELSE 0 END, o.us, {level} >= ({cost}) * 1000000
              FROM g JOIN o ON o.gk = g.gk AND o.rn = g.rn + 1"""}


# One token an hour and a burst of 3, as rates per 3600 seconds of event time squeezed into seconds.
SLOW = "SELECT event_id, user_id, us // 3600 AS us, packets FROM flows"


def slow_flows(spark, sf_dir):
    """Flows with event time running 3600 times faster, so that limits per second have work to do."""
    f = src.flows(spark, sf_dir)
    return f.select("event_id", "user_id", "ip_src", F.timestamp_micros(F.expr("unix_micros(ts) div 3600")).alias("ts"), "packets", "bytes")


@query("rate_replay_token", ctes("flows", extra={"slow": SLOW, **bucket_sql("slow", "user_id", "2", "120", "packets")}, recursive=True) + """
    SELECT o.event_id, g.allowed FROM o JOIN g USING (gk, rn)""")
def rate_replay_token(spark, sf_dir):
    return ops.replay_token_bucket(slow_flows(spark, sf_dir), ["user_id"], ["event_id"], 2, 120, "packets").select("event_id", "allowed")


KEEP = "list_filter(g.q, lambda x: x >= o.us - 30000000)"


@query("rate_replay_sliding", ctes("flows", extra={"slow": SLOW,
    "o": "SELECT *, user_id AS gk, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM slow",
    "g": f"""SELECT gk, rn, [us] AS q, TRUE AS allowed FROM o WHERE rn = 1
      UNION ALL SELECT o.gk, o.rn, CASE WHEN len({KEEP}) < 3 THEN list_append({KEEP}, o.us) ELSE {KEEP} END, len({KEEP}) < 3
      FROM g JOIN o ON o.gk = g.gk AND o.rn = g.rn + 1"""}, recursive=True) + "SELECT o.event_id, g.allowed FROM o JOIN g USING (gk, rn)")
def rate_replay_sliding(spark, sf_dir):
    return ops.replay_sliding_window(slow_flows(spark, sf_dir), ["user_id"], ["event_id"], 30, 3).select("event_id", "allowed")


@query("rate_replay_fixed", ctes("flows", extra={"slow": SLOW,
    "o": "SELECT *, user_id AS gk, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM slow",
    "g": """SELECT gk, rn, us AS first, 1 AS hit FROM o WHERE rn = 1
      UNION ALL SELECT o.gk, o.rn, CASE WHEN o.us - g.first >= 60000000 THEN o.us ELSE g.first END, CASE WHEN o.us - g.first >= 60000000 THEN 1 ELSE g.hit + 1 END
      FROM g JOIN o ON o.gk = g.gk AND o.rn = g.rn + 1"""}, recursive=True) + "SELECT o.event_id, g.hit::BIGINT AS hit, g.hit <= 2 AS allowed FROM o JOIN g USING (gk, rn)")
def rate_replay_fixed(spark, sf_dir):
    r = ops.replay_fixed_window(slow_flows(spark, sf_dir), ["user_id"], ["event_id"], 60, 2)
    return r.select("event_id", "hit", "allowed")


@query("rules_evaluated", ctes("flows", extra={**MATCH,
    "mm": """SELECT *, CASE limit_type WHEN 'byte' THEN bytes ELSE packets END AS cost, rule_id || ':' || coalesce('subnet:' || target_subnet, ip_src) || ':' || protocol AS sk FROM m""",
    **bucket_sql("mm", "sk", "limit_value", "burst_value", "cost")}, recursive=True) + """
    SELECT o.event_id, count(*) AS rules, bool_and(g.allowed) AS allowed FROM o JOIN g USING (gk, rn) GROUP BY 1""")
def rules_evaluated(spark, sf_dir):
    return ops.evaluate_rules(src.flows(spark, sf_dir), ops.rule_table(spark, RULES), "event_id", sliding=False)


WITHIN = "list_filter(h.q, lambda x: x >= w.us - 1000000)"
BYTE_RULES = bucket_sql("bytes_", "sk", "limit_value", "burst_value", "bytes")


@query("rules_evaluated_sliding", ctes("flows", extra={**MATCH,
    "mm": "SELECT *, rule_id || ':' || coalesce('subnet:' || target_subnet, ip_src) || ':' || protocol AS sk FROM m",
    "bytes_": "SELECT * FROM mm WHERE limit_type = 'byte'", **BYTE_RULES,
    "w": "SELECT *, row_number() OVER (PARTITION BY sk ORDER BY us, event_id) AS rn FROM mm WHERE limit_type <> 'byte'",
    "h": f"""SELECT sk, rn, [us] AS q, limit_value > 0 AS allowed FROM w WHERE rn = 1
      UNION ALL SELECT w.sk, w.rn, CASE WHEN len({WITHIN}) < limit_value THEN list_append({WITHIN}, w.us) ELSE {WITHIN} END, len({WITHIN}) < limit_value
      FROM h JOIN w ON w.sk = h.sk AND w.rn = h.rn + 1""",
    "u": "SELECT event_id, allowed FROM o JOIN g USING (gk, rn) UNION ALL SELECT event_id, allowed FROM w JOIN h USING (sk, rn)"}, recursive=True) + """
    SELECT event_id, count(*) AS rules, bool_and(allowed) AS allowed FROM u GROUP BY 1""")
def rules_evaluated_sliding(spark, sf_dir):
    return ops.evaluate_rules(src.flows(spark, sf_dir), ops.rule_table(spark, RULES), "event_id", sliding=True)


@query("rules_active", f"""WITH rules AS ({RULE_SQL}), d AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events)
    SELECT epoch_us(day) AS us, count(*) FILTER (epoch_us(day) BETWEEN c_us AND e_us) AS active, count(*) FILTER (epoch_us(day) > e_us) AS expired
    FROM d, rules GROUP BY 1""")
def rules_active(spark, sf_dir):
    days = src.flows(spark, sf_dir).select(F.date_trunc("day", "ts").alias("day")).distinct()
    spans = F.array(*[F.struct(F.lit(r[9]).alias("created_at"), F.lit(r[10]).alias("expires_at")) for r in RULES])
    each = days.select("day", F.explode(spans).alias("r")).select("day", "r.*")
    live, over = ops.active_rules(each, F.col("day")), ops.expired_rules(each, F.col("day"))
    marked = each.select("day", F.lit(0).alias("a"), F.lit(0).alias("e")).unionByName(live.select("day", F.lit(1).alias("a"), F.lit(0).alias("e"))
                         ).unionByName(over.select("day", F.lit(0).alias("a"), F.lit(1).alias("e")))
    return marked.groupBy(F.unix_micros("day").alias("us")).agg(F.sum("a").alias("active"), F.sum("e").alias("expired"))


BLOCK_SQL = """SELECT alert_id, ip_src AS ip, us AS c_us, us + 21600000000 AS e_us FROM alerts WHERE severity = 'critical'"""


def block_rules(spark, sf_dir):
    a = src.alerts(spark, sf_dir).filter("severity = 'critical'")
    return a.select(F.col("ip_src").alias("ip"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 6 hours")).alias("expires_at"))


@query("unblocked_flows", ctes("alerts", extra={"bl": BLOCK_SQL}) + """
    SELECT event_id, ip_src FROM flows f WHERE NOT EXISTS (SELECT 1 FROM bl WHERE ip = ip_src AND f.us BETWEEN c_us AND e_us)""")
def unblocked_flows(spark, sf_dir):
    return ops.blocked(src.flows(spark, sf_dir), block_rules(spark, sf_dir)).select("event_id", "ip_src")


@query("blocked_flows", ctes("alerts", extra={"bl": BLOCK_SQL}) + """
    SELECT event_id, ip_src FROM flows f WHERE EXISTS (SELECT 1 FROM bl WHERE ip = ip_src AND f.us BETWEEN c_us AND e_us)""")
def blocked_flows(spark, sf_dir):
    return ops.blocked(src.flows(spark, sf_dir), block_rules(spark, sf_dir), "left_semi").select("event_id", "ip_src")


@query("valid_addresses", ctes("flows") + """
    SELECT event_id, event_id % 3 <> 1 AS valid FROM flows""")
def valid_addresses(spark, sf_dir):
    text = F.expr("case event_id % 3 when 0 then ip_src when 1 then concat('x;', ip_src) else concat(ip_src, '/24') end")
    return src.flows(spark, sf_dir).select("event_id", ops.valid_address(text).alias("valid"))


@query("mitigation_plan", ctes("alerts", extra={
    "s": "SELECT * FROM (VALUES ('critical', 'block_ip', 5), ('critical', 'rate_limit', 5), ('critical', 'cloud_shield', 1), ('high', 'block_ip', 5), ('high', 'rate_limit', 5), ('medium', 'rate_limit', 3)) t(severity, action, most)"}) + """
    SELECT alert_id, action, position, CASE position WHEN 0 THEN ip_src ELSE ip_dst END AS ip,
      CASE WHEN action = 'rate_limit' THEN CASE severity WHEN 'medium' THEN 1000 ELSE 500 END END AS rate_pps, CASE WHEN action = 'block_ip' THEN 3600 END AS duration_seconds
    FROM alerts JOIN s USING (severity), (VALUES (0), (1)) p(position) WHERE position < most""")
def mitigation_plan(spark, sf_dir):
    a = src.alerts(spark, sf_dir).withColumn("affected_ips", F.array("ip_src", "ip_dst"))
    return mitigation.plan(a).select("alert_id", "action", "position", "ip", "rate_pps", "duration_seconds")


EPISODES = {"a": "SELECT window_size, window_start, total_packets / window_size::DOUBLE AS pps, total_bytes / window_size::DOUBLE AS bps FROM totals",
            "i": "SELECT a.*, window_start // window_size - row_number() OVER (PARTITION BY window_size ORDER BY window_start) AS island FROM a WHERE pps > 0.1",
            "e": """SELECT window_size, min(window_start) AS starts, max(window_start) + window_size AS ends, count(*) AS windows, max(pps) AS peak_pps, max(bps) AS peak_bps
              FROM i GROUP BY window_size, island"""}


def window_episodes(spark, sf_dir):
    t = stored(windows.rates(windows.window_totals(src.flows(spark, sf_dir), SIZES)))
    return mitigation.episodes(t, F.col("packets_per_second") > 0.1, ["window_size"])


@query("attack_episodes", ctes("totals", extra=EPISODES) + f"SELECT window_size, starts, ends, windows, ends - starts AS seconds, {q6('peak_pps')} AS peak_pps FROM e")
def attack_episodes(spark, sf_dir):
    return window_episodes(spark, sf_dir).select("window_size", "starts", "ends", "windows", "seconds", r6("peak_pps").alias("peak_pps"))


@query("attack_durations", ctes("totals", extra={**EPISODES, "b": f"SELECT unnest([{', '.join(map(str, metrics.ATTACK_DURATION_BOUNDS))}, 7200, 36000, 1e18]) AS le"}) + """
    SELECT CASE WHEN le > 1e17 THEN -1.0 ELSE le END AS le, count(*) FILTER (ends - starts <= le) AS n, sum(ends - starts)::DOUBLE AS total FROM e, b GROUP BY le""")
def attack_durations(spark, sf_dir):
    """Histogram of episode lengths; two bounds more, for the windows of the test tables are hours long."""
    h = metrics.histogram(window_episodes(spark, sf_dir), [], F.col("seconds"), [*metrics.ATTACK_DURATION_BOUNDS, 7200, 36000])
    return h.select(F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "n", F.col("sum").cast("double").alias("total"))


@query("redirect_decision", ctes("totals", extra=EPISODES) + """
    SELECT window_size, starts, ends, (peak_pps >= 0.3 OR peak_bps >= 1000) AND ends - starts >= 7200 AS redirect FROM e""")
def redirect_decision(spark, sf_dir):
    s = RedirectSettings(min_pps=0.3, min_bps=1000.0, min_seconds=7200)
    e = window_episodes(spark, sf_dir)
    return e.select("window_size", "starts", "ends", mitigation.should_redirect(F.col("peak_pps"), F.col("peak_bps"), F.col("seconds"), s).alias("redirect"))


def targets(spark, sf_dir):
    a = src.alerts(spark, sf_dir).filter("severity = 'critical'")
    return a.select(F.col("ip_src").alias("target_ip"), F.col("ts").alias("started_at"))


@query("redirect_rules", ctes("alerts") + """
    SELECT ip_src || '_' || CAST(us // 1000000 AS VARCHAR) AS redirect_id, ip_src || '/32' AS destination_prefix,
      '{"action":"redirect","priority":100,"destination_prefix":"' || ip_src || '/32","redirect":"192.0.2.1","community":"64512:666"}' AS flow_rule
    FROM alerts WHERE severity = 'critical'""")
def redirect_rules(spark, sf_dir):
    return mitigation.redirects(targets(spark, sf_dir)).select("redirect_id", "destination_prefix", "flow_rule")


@query("redirect_status", ctes("alerts") + """
    SELECT ip_src || '_' || CAST(us // 1000000 AS VARCHAR) AS redirect_id, CASE WHEN us + 3600000000 < 1705320000000000 THEN 'completed' ELSE 'active' END AS status
    FROM alerts WHERE severity = 'critical'""")
def redirect_status(spark, sf_dir):
    rows = mitigation.redirects(targets(spark, sf_dir))
    return mitigation.redirect_status(rows, F.timestamp_seconds(F.lit(1705320000))).select("redirect_id", "status")


@query("redirects_expired", ctes("alerts") + """
    SELECT DISTINCT ip_src || '_' || CAST(us // 1000000 AS VARCHAR) AS redirect_id FROM alerts WHERE severity = 'critical' AND 1705320000000000 - us > 3600000000""")
def redirects_expired(spark, sf_dir):
    rows = mitigation.redirects(targets(spark, sf_dir))
    return mitigation.expired_redirects(rows, rows, F.timestamp_seconds(F.lit(1705320000))).select("redirect_id").distinct()


@query("redirect_lookup", ctes("alerts", extra={"r": "SELECT ip_src, us, ip_src || '_' || CAST(us // 1000000 AS VARCHAR) AS redirect_id FROM alerts WHERE severity = 'critical'"}) + """
    SELECT DISTINCT f.ip_src AS target_ip, redirect_id FROM (SELECT DISTINCT ip_src FROM flows) f JOIN (SELECT ip_src, arg_min(redirect_id, us) AS redirect_id FROM r GROUP BY 1) x USING (ip_src)""")
def redirect_lookup(spark, sf_dir):
    wanted = src.flows(spark, sf_dir).select(F.col("ip_src").alias("target_ip")).distinct()
    return mitigation.redirect_for(wanted, mitigation.redirects(targets(spark, sf_dir)))


@query("shield_candidates", ctes("flows", extra={
    "r": "SELECT ip_src, us // 3600000000 * 3600000000 AS us, sum(packets) / 3600.0::DOUBLE AS pps, sum(bytes) / 3600.0::DOUBLE AS bps FROM flows GROUP BY 1, 2",
    "v": "SELECT * FROM r WHERE pps >= 0.03 OR bps >= 20",
    "o": "SELECT *, ip_src AS gk, row_number() OVER (PARTITION BY ip_src ORDER BY us) AS rn FROM v",
    "g": """SELECT gk, rn, us AS last, TRUE AS kept FROM o WHERE rn = 1 UNION ALL
      SELECT o.gk, o.rn, CASE WHEN o.us - g.last >= 86400000000 THEN o.us ELSE g.last END, o.us - g.last >= 86400000000 FROM g JOIN o ON o.gk = g.gk AND o.rn = g.rn + 1"""}, recursive=True) + f"""
    SELECT o.ip_src, o.us, {q6('o.pps')} AS pps FROM o JOIN g USING (gk, rn) WHERE kept""")
def shield_candidates(spark, sf_dir):
    hour = F.expr("unix_micros(ts) div 3600000000 * 3600000000")
    rates = src.flows(spark, sf_dir).groupBy("ip_src", F.timestamp_micros(hour).alias("ts")).agg(
        (F.sum("packets") / F.lit(3600.0)).alias("pps"), (F.sum("bytes") / F.lit(3600.0)).alias("bps"))
    c = mitigation.shield_candidates(rates, "ip_src", ShieldSettings(0.03, 20.0, 86400))
    return c.select("ip_src", F.unix_micros("ts").alias("us"), r6("pps").alias("pps"))


@query("mitigation_last", ctes("alerts") + "SELECT alert_id FROM alerts ORDER BY us DESC, alert_id DESC LIMIT 50")
def mitigation_last(spark, sf_dir):
    return mitigation.last_actions(src.alerts(spark, sf_dir), 50, ["alert_id"]).select("alert_id")


@query("geo_enrich", ctes("flows", extra={"n": MATCH["n"], "geo": """
    SELECT c_nationkey AS nation, 167772161 + c_custkey AS lo, 167772161 + c_custkey AS hi FROM customer"""}) + """
    SELECT event_id, ip_src, nation FROM n LEFT JOIN geo ON num BETWEEN lo AND hi""")
def geo_enrich(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    geo = customer.select(F.col("c_nationkey").alias("nation"), (F.lit(167772161) + F.col("c_custkey")).cast("bigint").alias("lo"),
                          (F.lit(167772161) + F.col("c_custkey")).cast("bigint").alias("hi"))
    f = src.flows(spark, sf_dir).withColumn("num", ipv4_number(F.col("ip_src")))
    return range_lookup(f, geo, "num", "lo", "hi", ["nation"]).select("event_id", "ip_src", "nation")


@query("cidr_bounds", ctes("flows", extra={"n": MATCH["n"]}) + """
    SELECT event_id, num - num % 64 AS lo, num - num % 64 + 63 AS hi FROM n""")
def cidr_bounds(spark, sf_dir):
    c = F.concat("ip_src", F.lit("/26"))
    return src.flows(spark, sf_dir).select("event_id", cidr_low(c).alias("lo"), cidr_high(c).alias("hi"))
