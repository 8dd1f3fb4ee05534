"""Streaming queries: the events table is read as a stream and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import r6
from ..operators.windows import key_counts
from ..session import fresh_path
from ..sources import events as src
from ..sources import messages
from ..streaming import sketches, stateful, windows
from .base import ORACLES, SIZES, ctes, greedy, query
from .base import r6 as q6
from .alerting import SETTINGS, model_opinion
from .windows import KEY, SCALED, alert_columns


MESSAGE = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ip_src", T.StringType()), T.StructField("bytes", T.LongType())])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(src.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def flow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.flows_from(event_stream(spark, sf_dir))


@query("stream_windows", ctes("features") + f"""
    SELECT window_size, window_start, total_packets, total_flows, {q6('pps')} AS pps, unique_src_ips, {q6('entropy_src_ip')} AS entropy_src_ip,
      {q6('syn_ratio')} AS syn_ratio FROM features""")
def stream_windows(spark, sf_dir):
    folder = fresh_path(spark, "stream-windows")
    level = windows.run_windows(flow_stream(spark, sf_dir), f"{folder}/level", f"{folder}/checkpoint", SIZES)
    w = windows.windows_from(level, SIZES, list(windows.DIMENSIONS), top=0)
    return w.select(*KEY, "total_packets", "total_flows", r6("packets_per_second").alias("pps"), "unique_src_ips",
                    r6("entropy_src_ip").alias("entropy_src_ip"), r6("syn_ratio").alias("syn_ratio"))


@query("stream_sketches", ctes("features") + """
    SELECT window_size, window_start, total_packets, total_flows, TRUE AS distinct_within, TRUE AS entropy_within, TRUE AS top_within FROM features""")
def stream_sketches(spark, sf_dir):
    """Windows from bounded summaries of 64 keys, and whether each is within its stated error of the exact windows."""
    flows = flow_stream(spark, sf_dir)
    job = sketches.SketchedWindows(fresh_path(spark, "stream-sketches"), SIZES, counters=64)
    job.run(flows)
    totals, found = job.windows(flows)
    exact = key_counts(src.flows(spark, sf_dir), SIZES)
    weight = F.col("weight").cast("double")
    sums = exact.groupBy(*KEY, "dim").agg(F.count("*").alias("keys"), (F.log2(F.sum(weight)) - F.sum(weight * F.log2(weight)) / F.sum(weight)).alias("entropy"))
    listed = found.select(*KEY, "dim", "missed", F.explode("counters").alias("c")).select(*KEY, "dim", "c.*")
    placed = exact.withColumnRenamed("weight", "true_weight").join(listed, [*KEY, "dim", "key"], "left").join(found.select(*KEY, "dim", "missed"), [*KEY, "dim"])
    low = F.coalesce("weight", F.lit(0))
    right = placed.groupBy(*KEY).agg(F.bool_and((F.col("true_weight") >= low) & (F.col("true_weight") <= low + F.col("missed"))).alias("top_within"))
    judged = found.join(sums, [*KEY, "dim"]).groupBy(*KEY).agg(
        F.bool_and(F.abs(F.col("unique") - F.col("keys")) <= 0.05 * F.col("keys")).alias("distinct_within"),
        F.bool_and(F.col("entropy").between(F.col("entropy_low") - 1e-9, F.col("entropy_high") + 1e-9)).alias("entropy_within"))
    return totals.join(judged, KEY).join(right, KEY).select(*KEY, "total_packets", "total_flows", "distinct_within", "entropy_within", "top_within")


@query("stream_detect", ORACLES["threshold_alerts"])
def stream_detect(spark, sf_dir):
    d = windows.Detector(spark, fresh_path(spark, "stream-detect"), SIZES, settings=SCALED)
    d.run(flow_stream(spark, sf_dir))
    return alert_columns(d.alert_rows())


@query("stream_verdicts", ORACLES["verdict_throttle"])
def stream_verdicts(spark, sf_dir):
    """The whole detector: rules, model and entropy votes, the weighted verdict and the throttle."""
    d = windows.Detector(spark, fresh_path(spark, "stream-verdicts"), SIZES, settings=SCALED, model=model_opinion, ensemble_settings=SETTINGS)
    d.run(flow_stream(spark, sf_dir))
    return d.table("verdicts").select(*KEY, "attack_type", "kept")


@query("stream_delta", ctes("flows", extra={
    "s": """SELECT event_id, 'f' || CAST(user_id AS VARCHAR) AS flow_id, us, (event_id // 7) * 10 + packets % 5 AS total_packets, (event_id // 7) * 700 + packets % 5 AS total_bytes,
        tcp_syn_count, tcp_rst_count, tcp_fin_count FROM flows""",
    "l": """SELECT *, lag(total_packets) OVER w AS pp, lag(total_bytes) OVER w AS pb, lag(tcp_syn_count) OVER w AS a, lag(tcp_rst_count) OVER w AS r, lag(tcp_fin_count) OVER w AS f
        FROM s WINDOW w AS (PARTITION BY flow_id ORDER BY us, event_id)""",
    "m": "SELECT *, pp IS NULL OR total_packets < pp OR total_bytes < pb OR tcp_syn_count < a OR tcp_rst_count < r OR tcp_fin_count < f AS restart FROM l",
    "d": """SELECT event_id, flow_id, CASE WHEN restart THEN total_packets ELSE total_packets - pp END AS total_packets, CASE WHEN restart THEN total_bytes ELSE total_bytes - pb END AS total_bytes,
        CASE WHEN restart THEN tcp_syn_count ELSE tcp_syn_count - a END AS tcp_syn_count, CASE WHEN restart THEN tcp_rst_count ELSE tcp_rst_count - r END AS tcp_rst_count,
        CASE WHEN restart THEN tcp_fin_count ELSE tcp_fin_count - f END AS tcp_fin_count FROM m"""}) + """
    SELECT event_id, flow_id, total_packets, total_bytes, tcp_syn_count, tcp_rst_count::BIGINT AS tcp_rst_count, tcp_fin_count::BIGINT AS tcp_fin_count
    FROM d WHERE greatest(total_packets, total_bytes, tcp_syn_count, tcp_rst_count, tcp_fin_count) > 0""")
def stream_delta(spark, sf_dir):
    snaps = flow_stream(spark, sf_dir).selectExpr(
        "event_id", "ts", "concat('f', cast(user_id as string)) as flow_id", "(event_id div 7) * 10 + packets % 5 as total_packets",
        "(event_id div 7) * 700 + packets % 5 as total_bytes", "tcp_syn_count", "tcp_rst_count", "tcp_fin_count")
    folder = fresh_path(spark, "stream-delta")
    return stateful.drain(stateful.delta_stream(snaps, "event_id"), f"{folder}/table", f"{folder}/checkpoint")


@query("stream_dedup", ctes("alerts", extra=greedy("alerts", "attack_type || severity", 3600 * 1_000_000, "alert_id"), recursive=True) + """
    SELECT attack_type, severity, o.alert_id, o.us FROM o JOIN g USING (gk, rn) WHERE kept""")
def stream_dedup(spark, sf_dir):
    folder = fresh_path(spark, "stream-dedup")
    kept = stateful.spaced_stream(src.alerts_from(flow_stream(spark, sf_dir)), ["attack_type", "severity"], "alert_id", 3600)
    return stateful.drain(kept, f"{folder}/table", f"{folder}/checkpoint")


@query("stream_sessions", ORACLES["packet_sessions"])
def stream_sessions(spark, sf_dir):
    closed = stateful.closed_sessions(src.packets_from(flow_stream(spark, sf_dir)), "event_id", fresh_path(spark, "stream-sessions"))
    doubles, gaps = ["tcp_window_avg", "tcp_window_std", "udp_payload_avg"], ["interarrival_mean", "interarrival_std"]
    return closed.select("flow_id", "first_us", "last_us", "ip_src", "ip_dst", *stateful.COUNTS, *[r6(c).alias(c) for c in doubles],
                         *[r6(F.col(c) * 1000).alias(f"{c}_ms") for c in gaps])


@query("stream_first_hit", ctes("flows") + """
    SELECT us - (us - 1800000000) % 5400000000 AS window_start_us, CAST(sum(packets) AS BIGINT) AS total_packets, count(*) AS total_flows FROM flows GROUP BY 1""")
def stream_first_hit(spark, sf_dir):
    """Windows that start at an offset, as a stream; every version of a window is written and the last one stands."""
    folder = fresh_path(spark, "stream-first-hit")
    totals = windows.first_hit_window_stream(flow_stream(spark, sf_dir), 5400, 1800)
    messages.for_each_batch(totals, windows.upsert(f"{folder}/table"), f"{folder}/checkpoint", "update").awaitTermination()
    newest = windows.latest(spark.read.parquet(f"{folder}/table"), ["win"])
    return newest.select((F.unix_micros(F.col("win.start"))).alias("window_start_us"), "total_packets", "total_flows")


@query("stream_messages", ctes("flows") + "SELECT event_id, ip_src AS key, bytes FROM flows")
def stream_messages(spark, sf_dir):
    """Flows to JSON messages into a sink, then the sink read back as a stream and decoded."""
    folder = fresh_path(spark, "stream-messages")
    out = messages.to_messages(flow_stream(spark, sf_dir).select("event_id", "ip_src", "bytes"), "flows")
    sent = stateful.drain(out, f"{folder}/topic", f"{folder}/checkpoint-out")
    back = spark.readStream.schema(sent.schema).parquet(f"{folder}/topic")
    good, _ = messages.decode(back, MESSAGE)
    rows = stateful.drain(good, f"{folder}/table", f"{folder}/checkpoint-in")
    return rows.select("event_id", F.col("ip_src").alias("key"), "bytes")

