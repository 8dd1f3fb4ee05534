"""Tumbling event-time windows of several sizes over flow rows.

Keys are pre-aggregated per smallest common bucket before the larger windows are formed, so a hot
talker reaches the window level as one row per bucket and map task, whatever its share of the rows.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FloodLimits
from ..functions.net import ICMP, TCP, UDP
from ..functions.numeric import MICROS, bucket_start, entropy_from_sums, micros, ratio
from ..session import written

DIMENSIONS = {"src_ip": "ip_src", "dst_ip": "ip_dst", "src_port": "sport", "dst_port": "dport"}

ALL = "*"  # names the first-level row that carries the totals

# Fixed order: the traffic feature vector.
TRAFFIC_VECTOR = [
    "total_packets", "total_bytes", "total_flows", "packets_per_second", "bytes_per_second", "flows_per_second",
    "unique_src_ips", "unique_dst_ips", "entropy_src_ip", "entropy_dst_ip", "entropy_src_port", "entropy_dst_port",
    "tcp_ratio", "udp_ratio", "icmp_ratio", "avg_packet_size", "packet_size_std", "syn_ratio", "rst_ratio",
    "is_syn_flood", "is_udp_flood", "is_icmp_flood", "is_http_flood"]


def _present(flows: DataFrame, *names: str, default: Column) -> Column:
    """The first non-null of the named columns that exist, else the default."""
    return F.coalesce(*[F.col(n) for n in names if n in flows.columns], default)


def packet_count(flows: DataFrame) -> Column:
    """Packets of a flow row; a row that names none counts as one packet."""
    return _present(flows, "total_packets", "packets", default=F.lit(1)).cast("bigint")


def weight(flows: DataFrame) -> Column:
    """Weight in the key counts: the packets, but 1 for a row with zero packets."""
    count = packet_count(flows)
    return F.when(count == 0, F.lit(1).cast("bigint")).otherwise(count)


def common_bucket(sizes: list[int]) -> int:
    return reduce(gcd, sizes)


def _fan_out(df: DataFrame, sizes: list[int], bucket: str = "bucket") -> DataFrame:
    """Each smallest bucket into the window of every size that holds it."""
    sized = df.withColumn("window_size", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in sizes])))
    start = F.col(bucket) - F.pmod(F.col(bucket), F.col("window_size"))
    return sized.withColumn("window_start", start).drop(bucket)


def _widen(fine: DataFrame, sizes: list[int], keys: list[str], aggs: list[Column]) -> DataFrame:
    """Windows of every size from the smallest buckets; the size equal to the bucket is taken as it is."""
    base = common_bucket(sizes)
    parts = []
    if base in sizes:
        parts.append(_fan_out(fine, [base]))
    if wider := [s for s in sizes if s != base]:
        parts.append(_fan_out(fine, wider).groupBy("window_size", "window_start", *keys).agg(*aggs))
    return reduce(DataFrame.unionByName, parts)


def measured(flows: DataFrame) -> list[Column]:
    """Per-row inputs of the window totals."""
    proto = _present(flows, "protocol", default=F.lit(0))
    size = _present(flows, "avg_packet_size", default=F.lit(0.0))
    http = F.col("http_method").isNotNull().cast("bigint") if "http_method" in flows.columns else F.lit(0).cast("bigint")

    def flag(name: str) -> Column:
        return _present(flows, name, default=F.lit(0)).cast("bigint")

    return [
        packet_count(flows).alias("n"), weight(flows).alias("w"), proto.alias("proto"),
        _present(flows, "total_bytes", "bytes", default=F.lit(0)).cast("bigint").alias("b"),
        flag("tcp_syn_count").alias("syn"), flag("tcp_rst_count").alias("rst"), flag("tcp_fin_count").alias("fin"),
        F.when(size > 0, size.cast("bigint")).alias("size"), http.alias("http")]


def total_aggregates(keep: Column | None = None) -> list[Column]:
    """Aggregates over `measured` rows; `keep` restricts them to some rows."""

    def only(x: Column) -> Column:
        return x if keep is None else F.when(keep, x)

    w, proto, size = F.col("w"), F.col("proto"), F.col("size")
    return [
        F.sum(only(F.col("n"))).alias("total_packets"), F.sum(only(F.col("b"))).alias("total_bytes"),
        F.count(only(F.lit(1))).alias("total_flows"), F.sum(only(F.col("syn"))).alias("syn"),
        F.sum(only(F.col("rst"))).alias("rst"), F.sum(only(F.col("fin"))).alias("fin"), F.sum(only(w)).alias("w_all"),
        F.sum(only(F.when(proto == TCP, w).otherwise(0))).alias("w_tcp"),
        F.sum(only(F.when(proto == UDP, w).otherwise(0))).alias("w_udp"),
        F.sum(only(F.when(proto == ICMP, w).otherwise(0))).alias("w_icmp"), F.count(only(size)).alias("size_n"),
        F.sum(only(size)).alias("size_sum"), F.sum(only(size.cast("double") * size)).alias("size_sq"),
        F.min(only(size)).alias("min_packet_size"), F.max(only(size)).alias("max_packet_size"),
        F.sum(only(F.col("http"))).alias("http_requests")]


def dimension_keys(flows: DataFrame, dims: list[str]) -> list[Column]:
    """(dim, key) structs of a row; the key is null where the dimension is not counted (port 0, empty address)."""
    pairs = []
    for d in dims:
        c = F.col(DIMENSIONS.get(d, d))
        present = (c.cast("string") != "") if d.endswith("ip") else (c != 0 if d.endswith("port") else F.lit(True))
        pairs.append(F.struct(F.lit(d).alias("dim"), F.when(present, c.cast("string")).alias("key")))
    return pairs


def window_totals(flows: DataFrame, sizes: list[int], ts: str = "ts") -> DataFrame:
    """Packets, bytes, flows, flags, protocol weights and packet-size moments per window."""
    base = common_bucket(sizes)
    rows = flows.select(bucket_start(micros(ts), base).alias("bucket"), *measured(flows))
    return totals_from_buckets(rows.groupBy("bucket").agg(*total_aggregates()), sizes)


def totals_from_buckets(fine: DataFrame, sizes: list[int]) -> DataFrame:
    merge = {"min_packet_size": F.min, "max_packet_size": F.max}
    aggs = [merge.get(c, F.sum)(c).alias(c) for c in fine.columns if c != "bucket"]
    return _widen(fine, sizes, [], aggs)


def key_counts(flows: DataFrame, sizes: list[int], dims: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Packet-weighted count per (window, dimension, key): one row per distinct key."""
    dims = dims or [d for d, c in DIMENSIONS.items() if c in flows.columns]
    keyed = flows.select(bucket_start(micros(ts), common_bucket(sizes)).alias("bucket"), weight(flows).alias("w"),
                         F.explode(F.array(*dimension_keys(flows, dims))).alias("p")).filter(F.col("p.key").isNotNull())
    fine = keyed.groupBy("bucket", F.col("p.dim").alias("dim"), F.col("p.key").alias("key")).agg(F.sum("w").alias("weight"))
    return counts_from_buckets(fine, sizes)


def counts_from_buckets(fine: DataFrame, sizes: list[int]) -> DataFrame:
    return _widen(fine, sizes, ["dim", "key"], [F.sum("weight").alias("weight")])


def level_rows(flows: DataFrame, dims: list[str]) -> Column:
    """The (dim, key) pairs of a row; the pair with dim ALL carries the totals."""
    return F.explode(F.array(F.struct(F.lit(ALL).alias("dim"), F.lit("").alias("key")), *dimension_keys(flows, dims)))


def first_level(flows: DataFrame, sizes: list[int], dims: list[str], ts: str = "ts") -> DataFrame:
    """Totals and key weights per smallest common bucket, written from one pass over the flows."""
    rows = flows.select(bucket_start(micros(ts), common_bucket(sizes)).alias("bucket"), *measured(flows), level_rows(flows, dims).alias("p")).select("*", "p.*")
    grouped = rows.filter(F.col("key").isNotNull()).groupBy("bucket", "dim", "key")
    return written(grouped.agg(F.sum("w").alias("weight"), *total_aggregates(F.col("dim") == ALL)), "first-level")


def from_level(level: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """Window totals and key counts of every size from a first-level table."""
    fine = level.filter(F.col("dim") == ALL).drop("dim", "key", "weight")
    counts = level.filter(F.col("dim") != ALL).select("bucket", "dim", "key", "weight")
    return totals_from_buckets(fine, sizes), counts_from_buckets(counts, sizes)


def key_summaries(counts: DataFrame, dims: list[str]) -> DataFrame:
    """Distinct keys and Shannon entropy of every dimension, one row per window."""
    w = F.col("weight").cast("double")
    aggs = []
    for d in dims:
        mine = F.col("dim") == d
        total = F.sum(F.when(mine, w))
        aggs.append(F.count(F.when(mine, 1)).alias(f"unique_{d}s"))
        aggs.append(F.coalesce(entropy_from_sums(total, F.sum(F.when(mine, w * F.log2(w)))), F.lit(0.0))
                    .alias(f"entropy_{d}"))
    return counts.groupBy("window_size", "window_start").agg(*aggs)


def top_keys(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k heaviest keys per window and dimension, ties broken by key."""
    w = Window.partitionBy("window_size", "window_start", "dim").orderBy(F.desc("weight"), F.asc("key"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_lists(counts: DataFrame, dims: list[str], k: int = 20) -> DataFrame:
    """`top_<dim>s` arrays of (key, weight), heaviest first; at most k entries each.

    Not filtered to `dims` first: the counts then share their shuffle with `key_summaries`.
    """
    ranked = top_keys(counts, k)
    entry = F.struct("rank", "key", "weight")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("dim") == d, entry))),
                         lambda x: F.struct(x["key"].alias("key"), x["weight"].alias("weight"))).alias(f"top_{d}s")
             for d in dims]
    return ranked.groupBy("window_size", "window_start").agg(*lists)


def key_maps(counts: DataFrame, dims: list[str], k: int | None = None) -> DataFrame:
    """`<dim>_counts` maps. Only for dimensions of few keys (protocols, ports); use `key_counts` otherwise."""
    rows = counts.filter(F.col("dim").isin(dims))
    if k:
        rows = top_keys(rows, k)
    return rows.groupBy("window_size", "window_start").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("dim") == d, F.struct("key", "weight")))).alias(f"{d}_counts")
        for d in dims])


def rates(totals: DataFrame) -> DataFrame:
    """Per-second rates, ratios and packet-size figures from the window totals."""
    size = F.col("window_size").cast("double")
    n = F.col("size_n").cast("double")
    mean = F.col("size_sum") / n
    variance = F.greatest(F.lit(0.0), F.col("size_sq") / n - mean * mean)
    any_size = F.col("size_n") > 0
    return totals.select(
        "*", (F.col("total_packets") / size).alias("packets_per_second"),
        (F.col("total_bytes") / size).alias("bytes_per_second"), (F.col("total_flows") / size).alias("flows_per_second"),
        ratio(F.col("w_tcp"), F.col("w_all")).alias("tcp_ratio"), ratio(F.col("w_udp"), F.col("w_all")).alias("udp_ratio"),
        ratio(F.col("w_icmp"), F.col("w_all")).alias("icmp_ratio"),
        F.when(F.col("w_all") > 0, 1 - (F.col("w_tcp") + F.col("w_udp") + F.col("w_icmp")) / F.col("w_all"))
        .otherwise(0.0).alias("other_ratio"),
        ratio(F.col("syn"), F.col("w_tcp")).alias("syn_ratio"), ratio(F.col("rst"), F.col("w_tcp")).alias("rst_ratio"),
        ratio(F.col("fin"), F.col("w_tcp")).alias("fin_ratio"),
        F.when(any_size, mean).otherwise(0.0).alias("avg_packet_size"),
        F.when(any_size, F.sqrt(variance)).otherwise(0.0).alias("packet_size_std"))


def flood_flags(features: DataFrame, s: FloodLimits = FloodLimits()) -> DataFrame:
    """Boolean flood indicators over the window ratios."""
    pps, syn = F.col("packets_per_second"), F.col("syn_ratio")
    return features.select(
        "*",
        ((F.col("tcp_ratio") >= s.tcp_share) & (syn > s.syn_ratio) & ((F.col("unique_src_ips") > s.syn_sources) | (pps > s.syn_pps)))
        .alias("is_syn_flood"),
        ((F.col("udp_ratio") > s.udp_share) & (pps > s.udp_pps)).alias("is_udp_flood"),
        ((F.col("icmp_ratio") > s.icmp_share) & (pps > s.icmp_pps)).alias("is_icmp_flood"),
        (F.col("http_requests") / F.col("window_size") > s.http_per_second).alias("is_http_flood"))


def traffic_features(flows: DataFrame, sizes: list[int], ts: str = "ts", top: int = 20, limits: FloodLimits = FloodLimits()) -> DataFrame:
    """The full window row: totals, rates, ratios, distincts, entropies, top talkers and indicators."""
    dims = [d for d, c in DIMENSIONS.items() if c in flows.columns]
    return assemble(*from_level(first_level(flows, sizes, dims, ts), sizes), dims, top, limits)


def assemble(totals: DataFrame, counts: DataFrame, dims: list[str], top: int = 20, limits: FloodLimits = FloodLimits()) -> DataFrame:
    """Window rows from totals and key counts."""
    keys = ["window_size", "window_start"]
    out = rates(totals).join(key_summaries(counts, dims), keys, "left")
    if top:
        out = out.join(top_lists(counts, [d for d in dims if d.endswith("ip")], top), keys, "left")
    fill = {f"{p}_{d}{s}": 0 for d in dims for p, s in (("unique", "s"), ("entropy", ""))}
    out = out.na.fill(fill)
    per_ip = ratio(F.col("total_packets"), F.col("unique_src_ips")) if "src_ip" in dims else F.lit(0.0)
    return flood_flags(out.withColumn("packets_per_ip", per_ip), limits)


def feature_vector(features: DataFrame, name: str = "vector") -> DataFrame:
    """The 23 traffic features as one float array, in the fixed order."""
    return features.withColumn(name, F.array(*[F.col(c).cast("float") for c in TRAFFIC_VECTOR]))


def latest_windows(windows: DataFrame) -> DataFrame:
    """The current window of every size."""
    names = [c for c in windows.columns if c != "window_size"]
    best = windows.groupBy("window_size").agg(F.max_by(F.struct(*names), F.col("window_start")).alias("w"))
    return best.select("window_size", "w.*")


def first_hit_windows(flows: DataFrame, seconds: int, origin: Column | None = None, ts: str = "ts") -> DataFrame:
    """Totals of one window size that starts at the first event instead of the epoch.

    `origin` (microseconds) avoids the extra pass that looks for the first event.
    """
    base = flows.withColumn("us", micros(ts))
    if origin is None:
        origin = F.lit(base.agg(F.min("us")).first()[0])
    width = F.lit(seconds * MICROS).cast("bigint")
    start = F.col("us") - F.pmod(F.col("us") - origin, width)
    totals = base.withColumn("window_start_us", start).groupBy("window_start_us")
    return totals.agg(F.sum(packet_count(flows)).alias("total_packets"), F.count("*").alias("total_flows"))
