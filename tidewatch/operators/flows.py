"""Packets to bidirectional flow records, and derived flow columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FlowSettings
from ..functions.net import FIN, RST, SYN, SYN_ACK, TCP, UDP, endpoints, flow_id, has_flag
from ..functions.numeric import MICROS, counter, ratio
from .ordered import CHUNK_ROWS, lag_by_chunks, run_fold, sessions, sliding_window

# Cumulative counters of a flow snapshot.
COUNTERS = ["total_packets", "total_bytes", "tcp_syn_count", "tcp_rst_count", "tcp_fin_count"]

# Fixed values, in the order that stored models read: the per-flow feature vector.
FLOW_VECTOR = ["total_packets", "total_bytes", "avg_packet_size", "packets_per_second", "bytes_per_second", "duration",
               "interarrival_mean", "interarrival_std", "tcp_syn_ratio", "tcp_window_avg", "udp_payload_avg"]


def with_flow_key(rows: DataFrame) -> DataFrame:
    """Direction-free endpoints `lo`, `hi` and the `flow_id` they give."""
    port = [F.coalesce(c, F.lit(0)) for c in ("sport", "dport")]
    lo, hi = endpoints(F.col("ip_src"), port[0], F.col("ip_dst"), port[1])
    keyed = rows.withColumn("lo", lo).withColumn("hi", hi)
    return keyed.withColumn("flow_id", flow_id(F.col("lo"), F.col("hi"), F.coalesce("protocol", F.lit(0))))


def reversed_key(rows: DataFrame) -> DataFrame:
    """Source and destination swapped."""
    swap = {"ip_src": "ip_dst", "ip_dst": "ip_src", "sport": "dport", "dport": "sport"}
    return rows.select(*[F.col(swap.get(c, c)).alias(c) for c in rows.columns])


def with_sessions(packets: DataFrame, tie: list[str], s: FlowSettings = FlowSettings(),
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Session name (`session_us`, `session_part`), direction and gap of every packet.

    A record ends with a FIN or RST packet, before a gap longer than the idle timeout, or with the
    first packet later than the active timeout.
    """
    flags = F.coalesce("tcp_flags", F.lit(0))
    closes = (F.col("protocol") == TCP) & (has_flag(flags, FIN) | has_flag(flags, RST))
    size = F.when(F.col("protocol") == TCP, F.col("tcp_window")).when(F.col("protocol") == UDP, F.col("udp_len"))
    keyed = with_flow_key(packets).withColumns({
        "closes": F.coalesce(closes, F.lit(False)), "size": size.cast("double"),
        "from_lo": F.struct(F.col("ip_src").alias("ip"), F.coalesce("sport", F.lit(0)).alias("port")) == F.col("lo")})
    fold = sessions(s.idle_seconds * MICROS, s.active_seconds * MICROS, side="from_lo", size="size",
                    last_sizes=s.size_history, last_gaps=s.gap_history, gap_limit_us=s.gap_limit_seconds * MICROS)
    return run_fold(keyed.drop("lo", "hi"), ["flow_id"], ["us", *tie], fold, chunk_rows=chunk_rows)


def flow_records(packets: DataFrame, tie: list[str], s: FlowSettings = FlowSettings(), direction_aware: bool = True,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Bidirectional flow records from packet rows.

    The packets are shuffled once, by flow and time chunk. What leaves that step per session and
    chunk is already combined: counters, and at most the last sizes and gaps that the record's
    bounded histories can need. `direction_aware=False` counts every packet as forward.
    """
    ends = ["ip_src", "ip_dst", "sport", "dport", "protocol"]
    needed = ["us", *tie, *ends, "length", "tcp_flags", "tcp_window", "udp_len"]
    rows = with_sessions(packets.select(*dict.fromkeys(needed)), tie, s, chunk_rows)
    rows = rows.na.fill(0, ["sport", "dport", "protocol", "length"])
    keys = ["flow_id", "session_us", "session_part"]
    place = F.struct("us", *tie)
    forward = F.col("forward") if direction_aware else F.lit(True)
    flags = F.when(F.col("protocol") == TCP, F.coalesce("tcp_flags", F.lit(0))).otherwise(0)
    length = F.col("length").cast("bigint")
    grouped = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*ends), place).alias("h"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.count_if(forward).alias("packets"), F.sum(F.when(forward, length).otherwise(0)).alias("bytes"),
        F.count_if(~forward).alias("packets_reverse"), F.sum(F.when(~forward, length).otherwise(0)).alias("bytes_reverse"),
        *[F.count_if(has_flag(flags, mask)).alias(name) for name, mask in (
            ("tcp_syn_count", SYN), ("tcp_syn_ack_count", SYN_ACK), ("tcp_rst_count", RST), ("tcp_fin_count", FIN))],
        F.collect_list(F.when(F.col("late_size"), F.struct(place.alias("at"), F.col("size").alias("x")))).alias("_sizes"),
        F.collect_list(F.when(F.col("late_gap"), F.struct(place.alias("at"), (F.col("gap_us") / F.lit(float(MICROS))).alias("x")))).alias("_gaps"))

    def last(entries: str, n: int) -> Column:
        newest = F.when(F.size(entries) > n, F.slice(F.sort_array(entries, asc=False), 1, n)).otherwise(F.col(entries))
        return F.transform(newest, lambda e: e["x"])

    listed = grouped.withColumn("_s", last("_sizes", s.size_history)).withColumn("_g", last("_gaps", s.gap_history))
    means = listed.withColumn("_sm", _mean("_s")).withColumn("_gm", _mean("_g"))
    tcp, udp = F.col("h.protocol") == TCP, F.col("h.protocol") == UDP
    deviation = _deviation("_s", "_sm")
    return with_rates(means.select(
        *keys, *[F.col(f"h.{e}").alias(e) for e in ends], "first_us", "last_us", "packets", "bytes",
        "packets_reverse", "bytes_reverse", "tcp_syn_count", "tcp_syn_ack_count", "tcp_rst_count", "tcp_fin_count",
        F.when(tcp, F.col("_sm")).otherwise(0.0).alias("tcp_window_avg"), F.when(tcp, deviation).otherwise(0.0).alias("tcp_window_std"),
        F.when(udp, F.col("_sm")).otherwise(0.0).alias("udp_payload_avg"), F.when(udp, deviation).otherwise(0.0).alias("udp_payload_std"),
        F.col("_gm").alias("interarrival_mean"), _deviation("_g", "_gm").alias("interarrival_std")))


def _mean(values: str) -> Column:
    total = F.reduce(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def _deviation(values: str, mean: str) -> Column:
    """Population deviation of a short array."""
    squares = F.reduce(values, F.lit(0.0), lambda a, x: a + (x - F.col(mean)) * (x - F.col(mean)))
    return F.when(F.size(values) > 0, F.sqrt(squares / F.size(values))).otherwise(F.lit(0.0))


def with_rates(flows: DataFrame) -> DataFrame:
    """Totals, duration, rates, mean size, SYN ratio and completeness of flow records."""
    f = flows.withColumns({
        "total_packets": F.col("packets") + F.col("packets_reverse"), "total_bytes": F.col("bytes") + F.col("bytes_reverse"),
        "duration": (F.col("last_us") - F.col("first_us")) / F.lit(float(MICROS)),
        "first_seen": F.timestamp_micros("first_us"), "last_seen": F.timestamp_micros("last_us")})
    return f.withColumns({
        "packets_per_sec": ratio(F.col("total_packets"), F.col("duration")),
        "bytes_per_sec": ratio(F.col("total_bytes"), F.col("duration")),
        "avg_packet_size": ratio(F.col("total_bytes"), F.col("total_packets")),
        "tcp_syn_ratio": ratio(F.col("tcp_syn_count"), F.col("tcp_syn_ack_count")),
        "is_complete": (F.col("protocol") == TCP) & ((F.col("tcp_fin_count") > 0) | (F.col("tcp_rst_count") > 0))})


def icmp_types(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Count of each ICMP type per key."""
    return packets.filter((F.col("protocol") == 1) & F.col("icmp_type").isNotNull()).groupBy(*keys, "icmp_type").agg(
        F.count("*").alias("packets"))


def flow_features(flows: DataFrame) -> DataFrame:
    """The eleven per-flow features; missing fields count as 0, TCP and UDP fields only for their protocol."""

    def get(*names: str, default: float = 0) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in flows.columns], F.lit(default))

    tcp, udp = F.col("protocol") == TCP, F.col("protocol") == UDP
    total, size = get("total_packets", "packets"), get("total_bytes", "bytes")
    zero = F.lit(0.0)
    out = flows.withColumns({
        "total_packets": total, "total_bytes": size, "avg_packet_size": ratio(size, total),
        "packets_per_second": get("packets_per_sec").cast("double"), "bytes_per_second": get("bytes_per_sec").cast("double"),
        "duration": get("duration").cast("double"), "interarrival_mean": get("interarrival_mean").cast("double"),
        "interarrival_std": get("interarrival_std").cast("double"),
        "tcp_syn_ratio": F.when(tcp, ratio(get("tcp_syn_count"), get("tcp_syn_ack_count"))).otherwise(zero),
        "tcp_window_avg": F.when(tcp, get("tcp_window_avg").cast("double")).otherwise(zero),
        "udp_payload_avg": F.when(udp, get("udp_payload_avg").cast("double")).otherwise(zero)})
    return out.withColumn("vector", F.array(*[F.col(c).cast("float") for c in FLOW_VECTOR]))


def counter_deltas(snapshots: DataFrame, tie: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per-update deltas of cumulative counters per `flow_id`.

    A counter that fell means a restart: the full values count. Updates that change nothing are
    dropped; rows without a flow id pass through.
    """
    clean = snapshots.withColumns({c: counter(F.col(c)) for c in COUNTERS if c in snapshots.columns})
    clean = clean.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    known = F.coalesce(F.col("flow_id"), F.lit("")) != ""
    lagged = lag_by_chunks(clean.filter(known), ["flow_id"], ["us", *tie], COUNTERS, chunk_rows=chunk_rows)
    restart = F.col("prev_total_packets").isNull()
    for c in COUNTERS:
        restart = restart | (F.col(c) < F.col(f"prev_{c}"))
    deltas = lagged.withColumn("_restart", restart)
    deltas = deltas.withColumns({c: F.when(F.col("_restart"), F.col(c)).otherwise(F.col(c) - F.col(f"prev_{c}")) for c in COUNTERS})
    changed = F.greatest(*[F.col(c) for c in COUNTERS]) > 0
    kept = deltas.filter(changed).select(clean.columns)
    return kept.unionByName(clean.filter(~known)).drop("us")


def limit_ingest(packets: DataFrame, per_second: int, tie: list[str], by: list[str] | None = None,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cap on accepted packets per second (per capture point when `by` is given), flagged in `allowed`."""
    rows = packets if by else packets.withColumn("_point", F.lit(0))
    out = run_fold(rows, by or ["_point"], ["us", *tie], sliding_window(MICROS, per_second), chunk_rows=chunk_rows)
    return out if by else out.drop("_point")


def flow_query(flows: DataFrame, src: str | None = None, dst: str | None = None, protocol: int | None = None,
               start: Column | None = None, end: Column | None = None, ts: str = "ts", limit: int | None = None,
               tie: list[str] | None = None) -> DataFrame:
    """Flow filter; a row without a time passes the time range. `limit` keeps that many rows, the oldest first."""
    out = flows
    if src:
        out = out.filter(F.col("ip_src") == src)
    if dst:
        out = out.filter(F.col("ip_dst") == dst)
    if protocol is not None:
        out = out.filter(F.col("protocol") == protocol)
    if start is not None:
        out = out.filter(F.col(ts).isNull() | (F.col(ts) >= start))
    if end is not None:
        out = out.filter(F.col(ts).isNull() | (F.col(ts) <= end))
    return out if limit is None else out.orderBy(ts, *(tie or [])).limit(limit)


def top_flows(flows: DataFrame, metric: str = "packets", limit: int = 10, tie: list[str] | None = None) -> DataFrame:
    """The heaviest flows by packets, bytes or rate; an unknown metric means packets, the limit is 1 to 100."""
    columns = {"packets": "packets", "bytes": "bytes", "rate": "packets_per_sec"}
    by = columns.get(metric, "packets")
    return flows.orderBy(F.desc(by), *(tie or [])).limit(max(1, min(100, limit)))
