"""Cloud flow-log ingest: provider lines to one flow shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import AZURE_ENTRY, GCP_ENTRY, WEBHOOK

COMMON = ["timestamp", "source", "ip_src", "ip_dst", "sport", "dport", "protocol", "packets", "bytes", "action"]


def _once(rows: DataFrame, parsed: Column, name: str) -> DataFrame:
    """Adds a parsed column that later filters cannot push down and evaluate again."""
    return rows.select("*", F.explode(F.array(parsed)).alias(name))


def parse_aws(lines: DataFrame, value: str = "value", arrival_ms: str = "arrival_ms") -> DataFrame:
    """VPC flow-log lines; fewer than 14 fields or an unreadable number drops the line."""
    lines = _once(lines, F.split(F.trim(F.col(value)), r"\s+"), "_f")
    f = F.col("_f")

    def number(i: int, kind: str) -> Column:
        return F.try_element_at(f, F.lit(i)).try_cast(kind)

    rows = lines.filter(F.size(f) >= 14).select(
        F.timestamp_millis(F.col(arrival_ms)).alias("timestamp"), F.lit("aws_vpc_flow_logs").alias("source"),
        f[3].alias("ip_src"), f[4].alias("ip_dst"), number(6, "int").alias("sport"), number(7, "int").alias("dport"),
        number(8, "int").alias("protocol"), number(9, "bigint").alias("packets"), number(10, "bigint").alias("bytes"),
        f[12].alias("action"), f[13].alias("log_status"), f[2].alias("interface_id"), f[1].alias("account_id"),
        F.lit("forward").alias("flow_direction"))
    return rows.dropna(subset=["sport", "dport", "protocol", "packets", "bytes"])


def _when(text: Column) -> Column:
    """ISO-8601 text (a trailing Z allowed) or numeric epoch seconds."""
    iso = F.try_to_timestamp(F.regexp_replace(text, "Z$", ""))
    return F.coalesce(F.timestamp_micros((text.try_cast("double") * 1e6).cast("bigint")), iso)


def parse_azure(entries: DataFrame, value: str = "value") -> DataFrame:
    """NSG entries; entries without both addresses or with an unreadable time are dropped.

    An entry with no time at all keeps a null timestamp (event time is never invented).
    """
    entries = _once(entries, F.from_json(value, AZURE_ENTRY), "e")
    stamp = F.coalesce(F.when(F.col("e.time") != "", F.col("e.time")), F.col("e.timestamp"))
    protocol = F.upper(F.coalesce(F.col("e.protocol"), F.lit("TCP")))
    rows = entries.select("e", stamp.alias("stamp"), protocol.alias("name")).select(
        "stamp", _when(F.col("stamp")).alias("timestamp"), F.lit("azure_nsg_flow_logs").alias("source"),
        F.col("e.srcIP").alias("ip_src"), F.col("e.dstIP").alias("ip_dst"), F.col("e.srcPort").alias("sport"),
        F.col("e.dstPort").alias("dport"),
        F.when(F.col("name") == "TCP", 6).when(F.col("name") == "UDP", 17).otherwise(1).alias("protocol"),
        F.coalesce("e.packetsSent", F.lit(0)).alias("packets"), F.coalesce("e.bytesSent", F.lit(0)).alias("bytes"),
        F.coalesce("e.flowStatus", F.lit("ALLOWED")).alias("action"))
    readable = F.col("stamp").isNull() | F.col("timestamp").isNotNull()
    return rows.filter(readable & (F.col("ip_src") != "") & (F.col("ip_dst") != "")).drop("stamp")


def parse_gcp(entries: DataFrame, value: str = "value") -> DataFrame:
    """VPC entries with a nested connection; anything but DENIED counts as ALLOWED."""
    rows = _once(entries, F.from_json(value, GCP_ENTRY), "e").filter(F.col("e.connection").isNotNull())
    denied = F.upper(F.coalesce("e.disposition", F.lit("ALLOWED"))) == "DENIED"
    return rows.select(
        _when(F.col("e.timestamp")).alias("timestamp"), F.lit("gcp_vpc_flow_logs").alias("source"),
        F.col("e.connection.src_ip").alias("ip_src"), F.col("e.connection.dest_ip").alias("ip_dst"),
        F.coalesce("e.connection.src_port", F.lit(0)).alias("sport"),
        F.coalesce("e.connection.dest_port", F.lit(0)).alias("dport"),
        F.coalesce("e.connection.protocol", F.lit(17)).alias("protocol"),
        F.coalesce("e.packets_sent", F.lit(0)).alias("packets"), F.coalesce("e.bytes_sent", F.lit(0)).alias("bytes"),
        F.when(denied, "DENIED").otherwise("ALLOWED").alias("action"))


def unify(*parsed: DataFrame) -> DataFrame:
    """All providers in one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parsed)


def as_packets(flows: DataFrame) -> DataFrame:
    """Flow rows in packet shape: the byte count becomes the packet length."""
    return flows.select(
        F.col("timestamp").alias("ts"), "ip_src", "ip_dst", "sport", "dport", "protocol",
        F.coalesce("bytes", F.lit(0)).cast("bigint").alias("length"))


def webhook_alerts(payloads: DataFrame, value: str = "value") -> DataFrame:
    """One row per alert of an alert-router payload, labels and annotations as maps."""
    return _once(payloads, F.from_json(value, WEBHOOK), "p").select(
        F.col("p.receiver").alias("receiver"), F.explode("p.alerts").alias("a")).select(
        "receiver", F.col("a.status").alias("status"), F.col("a.labels").alias("labels"),
        F.col("a.annotations").alias("annotations"), F.try_to_timestamp("a.startsAt").alias("starts_at"),
        F.try_to_timestamp("a.endsAt").alias("ends_at"))
