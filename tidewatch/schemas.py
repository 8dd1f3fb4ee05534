"""Explicit schemas; nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_s, _i, _l, _d, _ts, _b = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(),
                           T.BooleanType())
STRINGS = T.ArrayType(_s)
TEXT_MAP = T.MapType(_s, _s)

PACKET = _struct(
    ts=_ts, length=_l, eth_src=_s, eth_dst=_s, ip_src=_s, ip_dst=_s, protocol=_i, ttl=_i, ip_len=_i, ip_id=_i,
    tos=_i, sport=_i, dport=_i, tcp_flags=_i, tcp_seq=_l, tcp_ack=_l, tcp_window=_i, udp_len=_i, icmp_type=_i,
    icmp_code=_i, http_method=_s, http_path=_s, dns_query=_s)

FLOW = _struct(
    flow_id=_s, ip_src=_s, ip_dst=_s, sport=_i, dport=_i, protocol=_i, first_seen=_ts, last_seen=_ts, duration=_d,
    packets=_l, bytes=_l, packets_reverse=_l, bytes_reverse=_l, total_packets=_l, total_bytes=_l,
    packets_per_sec=_d, bytes_per_sec=_d, avg_packet_size=_d, tcp_syn_count=_l, tcp_syn_ack_count=_l,
    tcp_rst_count=_l, tcp_fin_count=_l, tcp_syn_ratio=_d, tcp_window_avg=_d, tcp_window_std=_d, udp_payload_avg=_d,
    udp_payload_std=_d, interarrival_mean=_d, interarrival_std=_d, application_protocol=_s, vlan_id=_i,
    flow_state=_s, is_snapshot=_b, timestamp=_ts, source=_s, action=_s, log_status=_s, interface_id=_s,
    account_id=_s, flow_direction=_s)

VOTE = _struct(detector=_s, attack_type=_s, confidence=_d, severity=_s, affected_ips=STRINGS)

ALERT = _struct(
    alert_id=_s, title=_s, description=_s, severity=_s, ts=_ts, attack_type=_s, confidence=_d, source_ips=STRINGS,
    target_ips=STRINGS, details=TEXT_MAP)

AUDIT = _struct(timestamp=_s, action=_s, user=_s, resource=_s, details=TEXT_MAP, compliance_reason=_s)

RATE_RULE = _struct(
    rule_id=_s, limit_type=_s, limit_value=_d, burst_value=_d, target_ip=_s, target_subnet=_s, protocol=_i, port=_i,
    duration_seconds=_l, created_at=_ts, expires_at=_ts)

TIER = _struct(metric=_s, severity=_s, rank=_i, min_value=_d)

METRIC = _struct(ts=_ts, name=_s, labels=TEXT_MAP, value=_d)

LABELLED_WINDOW_CSV = _struct(
    timestamp=_ts, src_ip=_s, dst_ip=_s, protocol=_i, sport=_i, dport=_i, packets=_l, bytes=_l, duration=_d,
    packets_per_sec=_d, bytes_per_sec=_d, unique_src_ips=_l, entropy_src_ip=_d, tcp_ratio=_d, udp_ratio=_d,
    icmp_ratio=_d, syn_ratio=_d, avg_packet_size=_d, is_attack=_i, attack_type=_s)

AZURE_ENTRY = _struct(
    time=_s, timestamp=_s, protocol=_s, srcIP=_s, dstIP=_s, srcPort=_i, dstPort=_i, packetsSent=_l, bytesSent=_l,
    flowStatus=_s)

GCP_ENTRY = _struct(
    timestamp=_s, connection=_struct(src_ip=_s, dest_ip=_s, src_port=_i, dest_port=_i, protocol=_i),
    packets_sent=_l, bytes_sent=_l, disposition=_s)

WEBHOOK = _struct(
    receiver=_s, status=_s,
    alerts=T.ArrayType(_struct(status=_s, labels=TEXT_MAP, annotations=TEXT_MAP, startsAt=_s, endsAt=_s)))
