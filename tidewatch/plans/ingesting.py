"""Ingest, message and governance queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import r6
from ..functions.privacy import pseudonym_email, pseudonym_ip, pseudonym_ip_sha
from ..operators import governance as gov
from ..schemas import PACKET
from ..session import fresh_path, side_by_side
from ..sources import cloud, files, messages
from ..sources import events as src
from .base import ctes, query
from .base import r6 as q6

SALT = "salt"
NOW = 1707091200  # 2024-02-05


def aws_lines(spark, sf_dir):
    """Flow-log lines; one in ten has a dash for its packets, one in ten misses its last field."""
    f = src.flows(spark, sf_dir)
    packets = F.when(F.expr("event_id % 10 = 3"), "-").otherwise(F.col("packets").cast("string"))
    status = F.when(F.expr("event_id % 10 = 7"), "").otherwise(" OK")
    seconds = F.unix_seconds("ts").cast("string")
    line = F.concat(F.concat_ws(" ", F.lit("2"), F.concat(F.lit("acct"), "event_id"), F.lit("eni-1"), "ip_src", "ip_dst", F.col("sport").cast("string"),
                                F.col("dport").cast("string"), F.col("protocol").cast("string"), packets, F.col("bytes").cast("string"), seconds, seconds,
                                F.lit("ACCEPT")), status)
    return f.select(line.alias("value"), F.expr("unix_micros(ts) div 1000").alias("arrival_ms"))


@query("aws_ingest", ctes("flows") + """
    SELECT 'acct' || event_id AS account_id, us // 1000 AS ms, ip_src, ip_dst, sport, dport, protocol, packets, bytes, 'ACCEPT' AS action
    FROM flows WHERE event_id % 10 NOT IN (3, 7)""")
def aws_ingest(spark, sf_dir):
    rows = cloud.parse_aws(aws_lines(spark, sf_dir))
    return rows.select("account_id", F.expr("unix_micros(timestamp) div 1000").alias("ms"), "ip_src", "ip_dst", "sport", "dport", "protocol", "packets", "bytes", "action")


def azure_entries(spark, sf_dir):
    """NSG entries: ISO or numeric times under either name, some without a source, some unreadable."""
    f = src.flows(spark, sf_dir)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    numeric = F.unix_seconds("ts").cast("string")
    kind = F.expr("event_id % 4")
    time = F.when(kind == 0, iso).when(kind == 1, numeric).when(kind == 2, "not a time")
    stamp = F.when(kind == 3, iso)
    name = F.when(F.col("protocol") == 6, "tcp").when(F.col("protocol") == 17, "UDP").otherwise("ICMP")
    entry = F.struct(time.alias("time"), stamp.alias("timestamp"), name.alias("protocol"), F.when(F.expr("event_id % 11 <> 0"), F.col("ip_src")).alias("srcIP"),
                     F.col("ip_dst").alias("dstIP"), F.col("sport").alias("srcPort"), F.col("dport").alias("dstPort"),
                     F.when(F.expr("event_id % 5 <> 0"), F.col("packets")).alias("packetsSent"), F.col("bytes").alias("bytesSent"))
    return f.select(F.to_json(entry, {"ignoreNullFields": "true"}).alias("value"))


@query("azure_ingest", ctes("flows") + """
    SELECT us // 1000000 AS s, ip_src, ip_dst, sport, dport, protocol, CASE WHEN event_id % 5 <> 0 THEN packets ELSE 0 END AS packets, bytes, 'ALLOWED' AS action
    FROM flows WHERE event_id % 4 <> 2 AND event_id % 11 <> 0""")
def azure_ingest(spark, sf_dir):
    rows = cloud.parse_azure(azure_entries(spark, sf_dir))
    return rows.select(F.unix_seconds("timestamp").alias("s"), "ip_src", "ip_dst", "sport", "dport", "protocol", "packets", "bytes", "action")


def gcp_entries(spark, sf_dir):
    f = src.flows(spark, sf_dir)
    connection = F.struct(F.col("ip_src").alias("src_ip"), F.col("ip_dst").alias("dest_ip"), F.col("sport").alias("src_port"), F.col("dport").alias("dest_port"),
                          F.when(F.expr("event_id % 3 <> 0"), F.col("protocol")).alias("protocol"))
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.when(F.expr("event_id % 9 <> 0"), connection).alias("connection"),
                     F.col("packets").alias("packets_sent"), F.col("bytes").alias("bytes_sent"),
                     F.when(F.col("k") > 90, "denied").when(F.col("k") > 80, "other").alias("disposition"))
    return f.select(F.to_json(entry, {"ignoreNullFields": "true"}).alias("value"))


@query("gcp_ingest", ctes("flows") + """
    SELECT us // 1000000 AS s, ip_src, ip_dst, sport, dport, CASE WHEN event_id % 3 <> 0 THEN protocol ELSE 17 END AS protocol, packets, bytes,
      CASE WHEN k > 90 THEN 'DENIED' ELSE 'ALLOWED' END AS action FROM flows WHERE event_id % 9 <> 0""")
def gcp_ingest(spark, sf_dir):
    rows = cloud.parse_gcp(gcp_entries(spark, sf_dir))
    return rows.select(F.unix_seconds("timestamp").alias("s"), "ip_src", "ip_dst", "sport", "dport", "protocol", "packets", "bytes", "action")


@query("cloud_unified", ctes("flows") + """
    SELECT 'aws_vpc_flow_logs' AS source, protocol, count(*) AS packets, sum(bytes)::BIGINT AS length FROM flows WHERE event_id % 10 NOT IN (3, 7) GROUP BY 2
    UNION ALL SELECT 'azure_nsg_flow_logs', protocol, count(*), sum(bytes)::BIGINT FROM flows WHERE event_id % 4 <> 2 AND event_id % 11 <> 0 GROUP BY 2
    UNION ALL SELECT 'gcp_vpc_flow_logs', CASE WHEN event_id % 3 <> 0 THEN protocol ELSE 17 END, count(*), sum(bytes)::BIGINT FROM flows WHERE event_id % 9 <> 0 GROUP BY 2""")
def cloud_unified(spark, sf_dir):
    parts = [cloud.parse_aws(aws_lines(spark, sf_dir)), cloud.parse_azure(azure_entries(spark, sf_dir)), cloud.parse_gcp(gcp_entries(spark, sf_dir))]
    return cloud.unify(*parts).groupBy("source", "protocol").agg(F.count("*").alias("packets"), F.sum("bytes").alias("length"))


@query("cloud_packets", ctes("flows") + "SELECT ip_src, count(*) AS packets, sum(bytes)::BIGINT AS length FROM flows WHERE event_id % 10 NOT IN (3, 7) GROUP BY 1")
def cloud_packets(spark, sf_dir):
    p = cloud.as_packets(cloud.parse_aws(aws_lines(spark, sf_dir)))
    return p.groupBy("ip_src").agg(F.count("*").alias("packets"), F.sum("length").alias("length"))


@query("webhook_alerts", ctes("alerts") + """
    SELECT alert_id, 'firing' AS status, attack_type AS alertname, severity, us // 1000000 AS starts FROM alerts
    UNION ALL SELECT alert_id, 'resolved', attack_type, severity, us // 1000000 FROM alerts""")
def webhook_alerts(spark, sf_dir):
    a = src.alerts(spark, sf_dir)

    def one(status: str):
        labels = F.create_map(F.lit("alertname"), F.col("attack_type"), F.lit("severity"), F.col("severity"), F.lit("id"), F.col("alert_id").cast("string"))
        return F.struct(F.lit(status).alias("status"), labels.alias("labels"), F.create_map(F.lit("summary"), F.lit("x")).alias("annotations"),
                        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startsAt"))

    payload = F.to_json(F.struct(F.lit("webhook").alias("receiver"), F.array(one("firing"), one("resolved")).alias("alerts")))
    rows = cloud.webhook_alerts(a.select(payload.alias("value")))
    return rows.select(F.col("labels")["id"].cast("bigint").alias("alert_id"), "status", F.col("labels")["alertname"].alias("alertname"),
                       F.col("labels")["severity"].alias("severity"), F.unix_seconds("starts_at").alias("starts"))


SMALL = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ip_src", T.StringType()), T.StructField("rate", T.DoubleType())])


def raw_messages(spark, sf_dir):
    """JSON messages of flows in two topics; one in twenty is cut off, one in twenty empty."""
    f = src.flows(spark, sf_dir).select("event_id", "ip_src", (F.col("packets") / 7.0).alias("rate"), "k")
    sent = messages.to_messages(f.select("event_id", "ip_src", "rate"), "flows")
    kind = F.expr("cast(get_json_object(value, '$.event_id') as bigint) % 20")
    topic = F.when(kind < 5, messages.TOPICS["alerts"]).otherwise(F.col("topic"))
    return sent.select(topic.alias("topic"), "key", F.when(kind == 6, F.substring("value", 1, 12)).when(kind == 7, F.lit(None)).otherwise(F.col("value")).alias("value"))


@query("message_decode", ctes("flows") + f"SELECT event_id, ip_src, {q6('packets / 7.0::DOUBLE')} AS rate FROM flows WHERE event_id % 20 NOT IN (6, 7)")
def message_decode(spark, sf_dir):
    good, _ = messages.decode(raw_messages(spark, sf_dir), SMALL)
    return good.select("event_id", "ip_src", r6("rate").alias("rate"))


@query("message_dead_letter", ctes("flows") + "SELECT ip_src AS key, count(*) AS bad FROM flows WHERE event_id % 20 IN (6, 7) GROUP BY 1")
def message_dead_letter(spark, sf_dir):
    _, bad = messages.decode(raw_messages(spark, sf_dir), SMALL)
    return bad.groupBy("key").agg(F.count("*").alias("bad"))


@query("message_routing", ctes("flows") + """
    SELECT CASE WHEN event_id % 20 < 5 THEN 'alerts' ELSE 'flows' END AS role, count(*) AS n FROM flows WHERE event_id % 20 NOT IN (6, 7) GROUP BY 1""")
def message_routing(spark, sf_dir):
    routed = messages.route(raw_messages(spark, sf_dir), {"flows": SMALL, "alerts": SMALL})
    parts = [df.select(F.lit(role).alias("role")) for role, df in routed.items()]
    return parts[0].unionByName(parts[1]).groupBy("role").agg(F.count("*").alias("n"))


@query("message_metrics", ctes("alerts") + "SELECT 'detection_metrics' AS topic, 'unknown' AS key, attack_type AS name, count(*)::DOUBLE AS value FROM alerts GROUP BY attack_type")
def message_metrics(spark, sf_dir):
    rows = src.alerts(spark, sf_dir).groupBy(F.col("attack_type").alias("name")).agg(F.count("*").cast("double").alias("value"))
    out = messages.to_messages(rows, "metrics")
    return out.select("topic", "key", F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.value").cast("double").alias("value"))


@query("message_alerts", ctes("alerts") + f"""
    SELECT 'ddos_alerts' AS topic, 'unknown' AS key, alert_id, severity, {q6('confidence')} AS confidence, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, TRUE AS stamped FROM alerts""")
def message_alerts(spark, sf_dir):
    """Alert messages read back from the sink: times as ISO text, doubles at six decimals, the producer's stamps."""
    path = fresh_path(spark, "alert-topic")
    rows = src.alerts(spark, sf_dir).select("alert_id", "severity", "ts", (F.col("confidence") + 1e-9).alias("confidence"))
    files.send_batch(messages.to_messages(rows, "alerts"), path, records_per_file=500)
    back = spark.read.schema("topic string, key string, value string").json(path)
    v = F.from_json("value", "alert_id bigint, severity string, ts string, confidence double, alert_timestamp string, _producer_timestamp string")
    return back.withColumn("v", v).select("topic", "key", "v.alert_id", "v.severity", r6("v.confidence").alias("confidence"), "v.ts",
                                          (F.col("v.alert_timestamp").isNotNull() & F.col("v._producer_timestamp").isNotNull()).alias("stamped"))


@query("archive_split", ctes("flows") + """
    SELECT '20240116' AS archive_date, count(*) FILTER (us < 1705363200000000) AS archived, count(*) FILTER (us >= 1705363200000000) AS kept,
      sum(bytes) FILTER (us < 1705363200000000)::BIGINT AS bytes FROM flows""")
def archive_split(spark, sf_dir):
    """Rows older than the cutoff in the archive file, the others kept."""
    path, cutoff = fresh_path(spark, "archive"), F.timestamp_seconds(F.lit(1705363200))
    rows = src.flows(spark, sf_dir).select("event_id", "ts", "bytes")
    files.archive_older(rows, "ts", cutoff, path, "20240116")
    old = spark.read.schema("event_id bigint, bytes bigint, archive_date string").json(path)
    kept = rows.filter(F.col("ts") >= cutoff).agg(F.count("*").alias("kept"))
    return side_by_side(old.agg(F.max("archive_date").alias("archive_date"), F.count("*").alias("archived"), F.sum("bytes").alias("bytes")), kept)


@query("packet_scan", ctes("packets") + """
    SELECT protocol::INT AS protocol, count(*) AS packets, sum(length)::BIGINT AS bytes FROM packets WHERE event_id % 5 <> 0 GROUP BY 1""")
def packet_scan(spark, sf_dir):
    """Packet metadata written and scanned again; rows without an IP layer are dropped."""
    path = fresh_path(spark, "packets") + ".parquet"
    rows = src.packets(spark, sf_dir).withColumn("ip_src", F.when(F.col("event_id") % 5 != 0, F.col("ip_src")))
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PACKET.fields]).write.parquet(path)
    return files.read_packets(spark, path).groupBy("protocol").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


@query("daily_sink", ctes("flows") + "SELECT CAST(ts AS DATE)::VARCHAR AS date, count(*) AS rows, sum(bytes)::BIGINT AS bytes FROM flows GROUP BY 1")
def daily_sink(spark, sf_dir):
    rows = src.flows(spark, sf_dir).select("event_id", "bytes", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit("h").alias("host"))
    path = fresh_path(spark, "daily")
    files.write_daily(rows, path)
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))


def audit_rows(spark, sf_dir):
    a = src.alerts(spark, sf_dir)
    return a.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.concat(F.lit("alert_"), "severity").alias("action"), F.lit("system").alias("user"),
                    F.col("ip_src").alias("resource"), F.create_map(F.lit("id"), F.col("alert_id").cast("string")).alias("details"), F.lit("x").alias("compliance_reason"))


@query("audit_log", ctes("alerts") + """
    SELECT alert_id, severity FROM alerts WHERE severity = 'high' AND us // 1000000 BETWEEN 1704672000 AND 1705881600""")
def audit_log(spark, sf_dir):
    path = fresh_path(spark, "audit")
    files.append_audit(audit_rows(spark, sf_dir), path)
    found = files.filter_audit(files.read_audit(spark, path), datetime(2024, 1, 8), datetime(2024, 1, 22), "alert_high")
    return found.select(F.col("details")["id"].cast("bigint").alias("alert_id"), F.substring("action", 7, 20).alias("severity"))


# ---- governance -------------------------------------------------------------------------------

PEOPLE_SQL = "SELECT c_custkey, c_name || CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '@' || lower(c_mktsegment) || '.example' END AS email FROM customer"


def people(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    tail = F.when(F.expr("c_custkey % 10 = 0"), "").otherwise(F.concat(F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")))
    return c.select("c_custkey", F.concat("c_name", tail).alias("email"), "c_acctbal")


@query("pseudonym_email", f"WITH p AS ({PEOPLE_SQL}) " + """
    SELECT c_custkey, 'user_' || substr(sha256(split_part(email, '@', 1)), 1, 8) || '@' || CASE WHEN contains(email, '@') THEN split_part(email, '@', 2) ELSE 'unknown' END AS email FROM p""")
def email_pseudonyms(spark, sf_dir):
    return people(spark, sf_dir).select("c_custkey", pseudonym_email(F.col("email")).alias("email"))


@query("pseudonymize", ctes("flows") + f"SELECT event_id, 'pseudonym:' || substr(sha256(ip_src || '{SALT}'), 1, 32) AS ip FROM flows")
def pseudonymize(spark, sf_dir):
    return src.flows(spark, sf_dir).select("event_id", pseudonym_ip_sha(F.col("ip_src"), SALT).alias("ip"))


@query("pseudonymize_blake")
def pseudonymize_blake(spark, sf_dir):
    return src.flows(spark, sf_dir).select("event_id", pseudonym_ip(F.col("ip_src"), SALT).alias("ip"))


@query("mask_pii", ctes("flows") + f"""
    SELECT event_id, 'pseudonym:' || substr(sha256(ip_src || '{SALT}'), 1, 32) AS ip_src, 'pseudonym:' || substr(sha256(ip_dst || '{SALT}'), 1, 32) AS ip_dst,
      '***MASKED***' AS phone, 'user_' || substr(sha256('u' || user_id), 1, 8) || '@x.example' AS email, bytes FROM flows""")
def mask_pii(spark, sf_dir):
    f = src.flows(spark, sf_dir).select("event_id", "ip_src", "ip_dst", F.col("user_id").cast("string").alias("phone"),
                                        F.concat(F.lit("u"), "user_id", F.lit("@x.example")).alias("email"), "bytes")
    return gov.mask(f, SALT, native=True)


CATEGORY = "CASE event_id % 4 WHEN 0 THEN 'raw_packets' WHEN 1 THEN 'flows' WHEN 2 THEN 'alerts' ELSE 'configuration' END"
CUT = 86400000000


@query("retention", ctes("flows", extra={"c": f"SELECT us, {CATEGORY} AS category FROM flows",
    "p": "SELECT * FROM (VALUES ('raw_packets', 1), ('flows', 30), ('alerts', 90), ('metrics', 30), ('audit_logs', 365)) t(category, days)"}) + f"""
    SELECT p.category, days, count(us) FILTER (us >= {NOW}000000 - days * {CUT}) AS kept, count(us) FILTER (us < {NOW}000000 - days * {CUT}) AS deleted, 0::BIGINT AS archived
    FROM p LEFT JOIN c USING (category) GROUP BY 1, 2""")
def retention(spark, sf_dir):
    f = src.flows(spark, sf_dir).withColumn("category", F.expr(CATEGORY))
    return gov.retention_plan(f, F.timestamp_seconds(F.lit(NOW)), "category")


@query("retention_kept", ctes("flows") + f"SELECT event_id, us FROM flows WHERE us >= {NOW}000000 - 20 * {CUT}")
def retention_kept(spark, sf_dir):
    """The whole job: write, archive, delete, audit; the kept table is read back."""
    folder = fresh_path(spark, "retention")
    src.flows(spark, sf_dir).select("event_id", "ts", F.unix_micros("ts").alias("us")).write.parquet(f"{folder}/table")
    policy = gov.RetentionPolicy("flows", 20, archive=True, archive_path=f"{folder}/archive")
    gov.apply_retention(spark, f"{folder}/table", f"{folder}/kept", F.timestamp_seconds(F.lit(NOW)), policy, f"{folder}/audit")
    return spark.read.parquet(f"{folder}/kept").select("event_id", "us")


@query("count_older", ctes("flows") + f"SELECT count(*) AS rows FROM flows WHERE us < {NOW}000000 - 20 * {CUT}")
def count_older(spark, sf_dir):
    return gov.count_older(src.flows(spark, sf_dir), F.timestamp_seconds(F.lit(NOW)), 20)


@query("retention_rollup", ctes("flows") + "SELECT us // 86400000000 AS day, protocol, count(*) AS rows, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes FROM flows GROUP BY 1, 2")
def retention_rollup(spark, sf_dir):
    r = gov.roll_up(src.flows(spark, sf_dir), ["protocol"], ["packets", "bytes"])
    return r.select(F.expr("unix_micros(period_start) div 86400000000").alias("day"), "protocol", "rows", "packets", "bytes")


REQUESTS = "SELECT DISTINCT ip_src AS identifier FROM flows WHERE k = 99 AND event_id % 2 = 0 UNION SELECT '192.168.0.3'"


def requests(spark, sf_dir):
    f = src.flows(spark, sf_dir).filter("k = 99 and event_id % 2 = 0").select(F.col("ip_src").alias("identifier"))
    return f.distinct().unionByName(spark.range(1).select(F.lit("192.168.0.3").alias("identifier")))


@query("erasure", ctes("flows", extra={"r": REQUESTS}) + "SELECT event_id FROM flows WHERE ip_src NOT IN (FROM r) AND ip_dst NOT IN (FROM r)")
def erasure(spark, sf_dir):
    return gov.matching_rows(src.flows(spark, sf_dir), requests(spark, sf_dir), erase=True).select("event_id")


@query("export", ctes("flows", extra={"r": REQUESTS}) + "SELECT event_id, ip_src, ip_dst FROM flows WHERE ip_src IN (FROM r) OR ip_dst IN (FROM r)")
def export(spark, sf_dir):
    return gov.matching_rows(src.flows(spark, sf_dir), requests(spark, sf_dir)).select("event_id", "ip_src", "ip_dst")


@query("compliance_report", ctes("alerts") + "SELECT 7::BIGINT AS policies, count(*) AS audit_entries FROM alerts")
def compliance_report(spark, sf_dir):
    policies = spark.createDataFrame([(p.category, p.days) for p in gov.POLICIES], "category string, days int")
    return gov.compliance_report(policies, audit_rows(spark, sf_dir)).select("policies", "audit_entries")
