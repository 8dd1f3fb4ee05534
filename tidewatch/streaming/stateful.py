"""Per-key state in streams: counter deltas, flow sessions, spacing of alerts.

State is a few numbers per key with an event-time timeout, so idle keys are evicted. Flow sessions keep the open flows of
a group of flows together, for a call of the update function takes far longer than the few packets of a flow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import FlowSettings
from ..functions.net import FIN, RST, SYN, SYN_ACK, TCP, UDP
from ..functions.numeric import MICROS, counter
from ..operators.flows import COUNTERS, with_flow_key
from ..operators.ordered import sessions, spacing


def _prepared(stream: DataFrame, lateness: str) -> DataFrame:
    return stream.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))


def delta_stream(snapshots: DataFrame, tie: str, lateness: str = "60 seconds", ttl_seconds: int = 86400) -> DataFrame:
    """Deltas of cumulative counters per flow; state is dropped `ttl_seconds` after a flow's last update."""
    rows = _prepared(snapshots, lateness).select("flow_id", "ts", "us", tie, *[counter(F.col(c)).alias(c) for c in COUNTERS])
    fields = ", ".join(f"{c} long" for c in COUNTERS)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values(["us", tie])
        now = pdf[COUNTERS].to_numpy(dtype=np.int64)
        first = np.array([state.get], dtype=np.int64).reshape(1, -1) if state.exists else np.full((1, len(COUNTERS)), -1)
        before = np.vstack([first, now[:-1]])
        restart = (now < before).any(axis=1) | (before < 0).any(axis=1)
        delta = np.where(restart[:, None], now, now - before)
        state.update(tuple(int(v) for v in now[-1]))
        limit = max(int(pdf["us"].iloc[-1]) // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(limit)
        keep = delta.any(axis=1)
        out = pd.DataFrame(delta[keep], columns=COUNTERS)
        out.insert(0, "flow_id", key[0])
        out.insert(1, tie, pdf[tie].to_numpy()[keep])
        yield out

    return rows.groupBy("flow_id").applyInPandasWithState(
        update, f"flow_id string, {tie} long, {fields}", fields, "append", GroupStateTimeout.EventTimeTimeout)


ENDS = ["ip_src", "ip_dst", "sport", "dport", "protocol"]
COUNTS = ["packets", "bytes", "packets_reverse", "bytes_reverse", "tcp_syn_count", "tcp_syn_ack_count", "tcp_rst_count", "tcp_fin_count"]
MEANS = ["tcp_window_avg", "tcp_window_std", "udp_payload_avg", "udp_payload_std", "interarrival_mean", "interarrival_std"]
KINDS = ["long", "long", "long", "string", "string", "int", "int", "int", *["long"] * len(COUNTS), "array<double>", "array<double>"]
#: The open flows of a group: a list of each field.
OPEN = ", ".join(f"{name} array<{kind}>" for name, kind in zip(
    ["flow_id", "due_ms", "start_us", "part", "last_us", *ENDS, *COUNTS, "sizes", "gaps"], ["string", "long", *KINDS], strict=True))
#: Flows are dealt to so many groups; a call of the update function serves one.
FLOW_GROUPS = 1024


def session_stream(packets: DataFrame, tie: str, s: FlowSettings = FlowSettings(), lateness: str = "60 seconds",
                   groups: int = FLOW_GROUPS) -> DataFrame:
    """Closed flow records of a packet stream, as `operators.flows.flow_records` has them without the derived rates.

    The state of a flow is its open record: counters, and the bounded histories of sizes and gaps. A record is emitted
    when a later packet closes it or when the watermark passes its idle timeout. Flows are dealt to `groups` by a hash. A
    micro-batch's packets of a group are put in order in one place, with the group's open records, so bound the input per
    trigger and raise `groups` with the number of flows. Rows of `end_marks` only move the watermark.
    """
    tcp = F.col("protocol") == TCP
    flags = F.when(tcp, F.coalesce("tcp_flags", F.lit(0))).otherwise(0)
    size = F.when(tcp, F.col("tcp_window")).when(F.col("protocol") == UDP, F.col("udp_len")).cast("double")
    keyed = with_flow_key(packets.withWatermark("ts", lateness)).withColumn("us", F.unix_micros("ts"))
    marked = F.when(F.col("ip_src").isNull() & F.col("ip_dst").isNull() & F.col(tie).isNull(), F.lit("")).otherwise(F.col("flow_id"))
    numbers = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ENDS[2:]]
    from_lo = F.coalesce(F.struct(F.col("ip_src").alias("ip"), F.coalesce("sport", F.lit(0)).alias("port")) == F.col("lo"), F.lit(False))
    rows = keyed.select(F.pmod(F.xxhash64(marked), F.lit(groups)).alias("flow_group"), marked.alias("flow_id"), "ts", "us", F.coalesce(tie, F.lit(0)).alias(tie), F.coalesce("ip_src", F.lit("")).alias("ip_src"),
                        F.coalesce("ip_dst", F.lit("")).alias("ip_dst"), *numbers, F.coalesce("length", F.lit(0)).cast("bigint").alias("length"),
                        flags.cast("int").alias("flags"), F.coalesce(size, F.lit(float("nan"))).alias("size"), from_lo.alias("from_lo"),
                        (flags.bitwiseAND(F.lit(FIN | RST)) != 0).alias("closes"))
    fold = sessions(s.idle_seconds * MICROS, s.active_seconds * MICROS, side="from_lo", size="size",
                    last_sizes=s.size_history, last_gaps=s.gap_history, gap_limit_us=s.gap_limit_seconds * MICROS)
    names = ["flow_id", "first_us", "last_us", *ENDS, *COUNTS, *MEANS]

    def record(flow: str, r: tuple) -> tuple:
        def spread(x: list[float]) -> tuple[float, float]:
            return (float(np.mean(x)), float(np.std(x))) if len(x) else (0.0, 0.0)
        sizes, gaps = spread(r[-2]), spread(r[-1])
        window, payload = (sizes if r[7] == kind else (0.0, 0.0) for kind in (TCP, UDP))
        return (flow, r[0], r[2], *r[3:8], *r[8:16], *window, *payload, *gaps)

    def joined(earlier: tuple, later: tuple) -> tuple:
        added = [a + b for a, b in zip(earlier[8:16], later[8:16])]
        return (*earlier[:2], later[2], *earlier[3:8], *added, (list(earlier[16]) + later[16])[-s.size_history:], (list(earlier[17]) + later[17])[-s.gap_history:])

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = {r[0]: r[1:] for r in zip(*state.get)} if state.exists else {}
        done: list[tuple] = []
        opened: list[tuple] = []
        pdf = pd.concat(list(parts)) if not state.hasTimedOut else pd.DataFrame({"flow_id": []})
        pdf = pdf[pdf["flow_id"].notna() & (pdf["flow_id"] != "")]
        if len(pdf):
            flow, flows = pd.factorize(pdf["flow_id"])
            order = np.lexsort((pdf[tie].to_numpy(), pdf["us"].to_numpy(), flow))
            flow, cols = flow[order], {c: pdf[c].to_numpy()[order] for c in pdf.columns}
            first = np.flatnonzero(np.r_[True, flow[1:] != flow[:-1]])
            after, found = [], []
            for a, z in zip(first, [*first[1:], len(flow)]):
                some, earlier = {c: cols[c][a:z] for c in fold.inputs}, held.get(flows[flow[a]])
                entry = [int(v) for v in earlier[1:4]] if earlier else []
                found.append(fold.replay(some, entry))
                after.append(fold.follow(fold.summarize(some), entry))
            told = {c: np.concatenate([x[c] for x in found]) for c in ("session_us", "session_part", "forward", "gap_us")}
            begins = np.flatnonzero(np.r_[True, (np.diff(flow) != 0) | (np.diff(told["session_us"]) != 0) | (np.diff(told["session_part"]) != 0)])
            forward, flags = told["forward"], cols["flags"]
            counted = [forward, np.where(forward, cols["length"], 0), ~forward, np.where(forward, 0, cols["length"]),
                       *[(flags & mask) == mask for mask in (SYN, SYN_ACK, RST, FIN)]]
            sums = np.array([np.add.reduceat(c.astype(np.int64), begins) for c in counted]).T.tolist()
            for i, (a, z) in enumerate(zip(begins, [*begins[1:], len(flow)])):
                name = flows[flow[a]]
                sizes, gaps = cols["size"][a:z], told["gap_us"][a:z]
                part = told["session_part"][a] * 2 + int(cols["from_lo"][a])
                one = (int(told["session_us"][a]), int(part), int(cols["us"][z - 1]), *[cols[c][a] if c.startswith("ip") else int(cols[c][a]) for c in ENDS], *sums[i],
                       sizes[~np.isnan(sizes)][-s.size_history:].tolist(), (gaps[gaps >= 0][-s.gap_history:] / MICROS).tolist())
                earlier = held.pop(name, None)  # the flow's first session here may go on with it
                if earlier:
                    if (one[0], told["session_part"][a]) == (int(earlier[1]), int(earlier[2]) // 2):
                        one = joined(earlier[1:], one)
                    else:
                        done.append(record(name, earlier[1:]))
                if (z < len(flow) and flow[z] == flow[a]) or not after[flow[a]]:
                    done.append(record(name, one))
                else:
                    opened.append((name, max((one[2] + s.idle_seconds * MICROS) // 1000 + 1, now + 1), *one))
        for name, r in held.items():
            if r[0] < now:
                done.append(record(name, r[1:]))
            else:
                opened.append((name, *r))
        if opened:
            state.update(tuple(map(list, zip(*opened))))
            state.setTimeoutTimestamp(max(min(r[1] for r in opened), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=names)

    output = ("flow_id string, first_us long, last_us long, ip_src string, ip_dst string, sport int, dport int, protocol int, "
              + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in MEANS))
    return rows.groupBy("flow_group").applyInPandasWithState(update, output, OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def end_marks(packets: DataFrame, folder: str) -> DataFrame:
    """`packets` and the rows of a stream of end marks in `folder`, which `mark_end` writes."""
    spark = packets.sparkSession
    spark.createDataFrame([], packets.schema).write.mode("append").parquet(folder)
    return packets.unionByName(spark.readStream.schema(packets.schema).parquet(folder))


def mark_end(packets: DataFrame, folder: str, at: str) -> None:
    """Ends the input: a row that is only a time moves the watermark past every open record."""
    fields = [F.lit(at).cast("timestamp").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in packets.schema.fields]
    packets.sparkSession.range(1).select(*fields).write.mode("append").parquet(folder)


def closed_sessions(packets: DataFrame, tie: str, folder: str, s: FlowSettings = FlowSettings(), lateness: str = "60 seconds") -> DataFrame:
    """Drains the available packets and then ends the input, so that the records still open are emitted as well."""
    marks, table, checkpoint = f"{folder}/marks", f"{folder}/table", f"{folder}/checkpoint"
    stream = session_stream(end_marks(packets, marks), tie, s, lateness)
    drain(stream, table, checkpoint)
    for year in (2200, 2201):  # the first moves the watermark, the second is judged by it
        mark_end(packets, marks, f"{year}-01-01 00:00:00")
        out = drain(session_stream(end_marks(packets, marks), tie, s, lateness), table, checkpoint)
    return out


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the progress that the query still holds (its last
    hundred batches; `batches.LateRows` counts all)."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])


def spaced_stream(alerts: DataFrame, keys: list[str], tie: str, gap_seconds: int, lateness: str = "60 seconds") -> DataFrame:
    """Alerts kept by cooldown or deduplication: (keys, tie, us) of the kept ones."""
    fold = spacing(gap_seconds * MICROS)
    kinds = dict(alerts.dtypes)
    rows = _prepared(alerts, lateness).select(*keys, "ts", "us", tie)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values(["us", tie])
        entry = list(state.get) if state.exists else []
        result = fold.replay({"us": pdf["us"].to_numpy()}, entry)
        last = int(result["leader_us"][-1])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + gap_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pdf[result["kept"]][[*keys, tie, "us"]]

    output = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{tie} {kinds[tie]}", "us long"])
    return rows.groupBy(*keys).applyInPandasWithState(update, output, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over the available input into a Parquet table and reads it back."""
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
