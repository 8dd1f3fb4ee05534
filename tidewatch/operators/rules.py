"""Rate-limit and block rules: construction, life cycle, matching and replay over traffic."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.net import ADDRESS_PATTERN, address_range, cidr_high, cidr_low, ipv4_number
from ..functions.numeric import MICROS
from ..schemas import RATE_RULE
from ..session import small_side, written
from .ordered import CHUNK_ROWS, hit_windows, run_fold, sliding_window, token_bucket

# Default rate and rule capacity.
DEFAULT_PPS = 1000
MAX_RULES = 10_000
BYTE_BURST = 2.0
RULE_SECONDS = 300


def _rule(rule_id: str, kind: str, value: float, burst: float, created: datetime, seconds: int, **target) -> tuple:
    return (rule_id, kind, float(value), float(burst), target.get("ip"), target.get("subnet"), target.get("protocol"),
            target.get("port"), seconds, created, created + timedelta(seconds=seconds))


def limit_ip(rule_id: str, ip: str, created: datetime, pps: int | None = None, seconds: int = RULE_SECONDS) -> tuple:
    rate = pps or DEFAULT_PPS
    return _rule(rule_id, "packet", rate, rate, created, seconds, ip=ip)


def limit_subnet(rule_id: str, subnet: str, created: datetime, pps: int | None = None,
                 seconds: int = RULE_SECONDS) -> tuple:
    rate = pps or DEFAULT_PPS
    return _rule(rule_id, "packet", rate, rate, created, seconds, subnet=subnet)


def limit_protocol(rule_id: str, protocol: int, pps: int, created: datetime, seconds: int = RULE_SECONDS,
                   port: int | None = None) -> tuple:
    return _rule(rule_id, "packet", pps, pps, created, seconds, protocol=protocol, port=port)


def limit_bandwidth(rule_id: str, ip: str, bps: int, created: datetime, seconds: int = RULE_SECONDS,
                    burst_multiplier: float = BYTE_BURST) -> tuple:
    rate = bps // 8
    return _rule(rule_id, "byte", rate, rate * max(2.0, burst_multiplier), created, seconds, ip=ip)


def limit_connections(rule_id: str, created: datetime, per_second: int, seconds: int = RULE_SECONDS, **target) -> tuple:
    return _rule(rule_id, "connection", per_second, per_second, created, seconds, **target)


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RATE_RULE)


def valid_address(text: Column) -> Column:
    return F.coalesce(text.rlike(ADDRESS_PATTERN), F.lit(False))


def active_rules(rules: DataFrame, moment: Column) -> DataFrame:
    """Rules in force at `moment`; a rule is over strictly after its expiry."""
    return rules.filter((F.col("created_at") <= moment) & (F.col("expires_at").isNull() | (moment <= F.col("expires_at"))))


def expired_rules(rules: DataFrame, moment: Column) -> DataFrame:
    return rules.filter(F.col("expires_at").isNotNull() & (moment > F.col("expires_at")))


def oldest_tenth(rows: DataFrame, order: list[str], capacity: int, by_capacity: bool = True) -> DataFrame:
    """Rows to evict when the table is over capacity: a tenth of the capacity (at least one row) or of the rows.

    The count is one pass; the selection is a top-n, so nothing is sorted as a whole.
    """
    n = rows.count()
    if n <= capacity:
        return rows.limit(0)
    take = max(1, capacity // 10) if by_capacity else n // 10
    return rows.orderBy(*order).limit(take)


def evict_rules(rules: DataFrame, capacity: int = MAX_RULES) -> DataFrame:
    """The rules to drop when the table is over its capacity: the oldest tenth."""
    return oldest_tenth(rules, ["created_at", "rule_id"], capacity, by_capacity=False)


SALTS = 32


def _rule_key() -> Column:
    """The one lookup key of a rule: its address, its /16 or /8 bucket, IPv6, or any."""
    v4 = ipv4_number(F.split("target_subnet", "/")[0]).isNotNull()
    length = F.coalesce(F.try_element_at(F.split("target_subnet", "/"), F.lit(2)).try_cast("int"), F.lit(32))
    low = cidr_low(F.col("target_subnet"))
    return (F.when(F.col("target_ip").isNotNull(), F.concat(F.lit("ip:"), F.col("target_ip")))
            .when(F.col("target_subnet").isNull(), F.lit("any"))
            .when(v4 & (length >= 16), F.concat(F.lit("16:"), F.shiftright(low, 16).cast("string")))
            .when(v4 & (length >= 8), F.concat(F.lit("8:"), F.shiftright(low, 24).cast("string")))
            .when(v4, F.lit("any")).otherwise(F.lit("v6")))


def match_rules(traffic: DataFrame, rules: DataFrame, ip: str = "ip_src", port: str = "dport",
                timed: bool = True, ipv6: bool = False) -> DataFrame:
    """Traffic rows with every rule they match: address, subnet, protocol and port; a null field matches all.

    Each rule has one lookup key and each row at most five, so this is an equi-join followed by a
    range test, never rows times rules. Every row has the key of the rules without an address, so these
    rules are repeated under SALTS keys and the rows are dealt among them. `ipv6` adds the Arrow function
    that reads v6 subnets.
    """
    keyed = rules.select(
        "rule_id", "limit_type", "limit_value", "burst_value", "target_ip", "target_subnet",
        F.col("protocol").alias("rule_protocol"), F.col("port").alias("rule_port"), "created_at", "expires_at",
        cidr_low(F.col("target_subnet")).alias("_lo"), cidr_high(F.col("target_subnet")).alias("_hi"),
        _rule_key().alias("_key"),
        *([address_range("target_subnet").alias("_r6")] if ipv6 else []))
    wide = F.col("_key").isin("any", "v6")
    copies = F.when(wide, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    keyed = keyed.withColumn("_salt", F.explode(copies)).withColumn("_key", F.when(wide, F.concat_ws("#", "_key", "_salt")).otherwise(F.col("_key"))).drop("_salt")
    keyed = small_side(keyed)
    number, salt = F.col("_num"), F.pmod(F.xxhash64(ip, port, "protocol", *(["ts"] if "ts" in traffic.columns else [])), F.lit(SALTS)).cast("string")
    keys = [F.concat(F.lit("ip:"), F.col(ip)), F.concat(F.lit("16:"), F.shiftright(number, 16).cast("string")),
            F.concat(F.lit("8:"), F.shiftright(number, 24).cast("string")), F.concat(F.lit("any#"), salt)]
    if ipv6:
        keys.append(F.when(F.col(ip).contains(":"), F.concat(F.lit("v6#"), salt)))
        traffic = traffic.withColumn("_a6", address_range(ip))
    rows = traffic.withColumn("_num", ipv4_number(F.col(ip))).withColumn(
        "_key", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())))
    joined = rows.join(keyed, "_key")
    in_subnet = F.col("target_subnet").isNull() | F.col("_num").between(F.col("_lo"), F.col("_hi"))
    if ipv6:
        same = (F.col("_a6.version") == F.col("_r6.version")) & (F.col("_a6.version") == 6)
        in_subnet = in_subnet | (same & F.col("_a6.lo").between(F.col("_r6.lo"), F.col("_r6.hi")))
    keep = (F.coalesce(in_subnet, F.lit(False))
            & (F.col("rule_protocol").isNull() | (F.col("protocol") == F.col("rule_protocol")))
            & (F.col("rule_port").isNull() | (F.col(port) == F.col("rule_port"))))
    if timed:
        keep = keep & (F.col("created_at") <= F.col("ts")) & (
            F.col("expires_at").isNull() | (F.col("ts") <= F.col("expires_at")))
    return joined.filter(keep).drop("_key", "_num", "_lo", "_hi", "_a6", "_r6")


def state_key(ip: str = "ip_src") -> Column:
    """Limiter state is kept per subnet for subnet rules, per address otherwise."""
    subject = F.when(F.col("target_subnet").isNotNull(), F.concat(F.lit("subnet:"), F.col("target_subnet"))).otherwise(F.col(ip))
    protocol = F.when(F.coalesce("protocol", F.lit(0)) == 0, F.lit("any")).otherwise(F.col("protocol").cast("string"))
    return F.concat_ws(":", F.col("rule_id"), subject, protocol)


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def replay_token_bucket(rows: DataFrame, keys: list[str], tie: list[str], rate: int | str, burst: int | str,
                        cost: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Admits rows whose cost the bucket of their key can pay (`allowed`)."""
    return run_fold(_timed(rows), keys, ["us", *tie], token_bucket(rate, burst, cost=cost), chunk_rows=chunk_rows).drop("us")


def replay_sliding_window(rows: DataFrame, keys: list[str], tie: list[str], seconds: float, limit: int | str,
                          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    fold = sliding_window(int(seconds * MICROS), limit)
    return run_fold(_timed(rows), keys, ["us", *tie], fold, chunk_rows=chunk_rows).drop("us")


def replay_fixed_window(rows: DataFrame, keys: list[str], tie: list[str], seconds: float, limit: int,
                        chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Windows start at their first hit; the first `limit` hits of each are admitted.

    A hit at exactly the window length opens the next one.
    """
    led = run_fold(_timed(rows), keys, ["us", *tie], hit_windows(int(seconds * MICROS)), chunk_rows=chunk_rows)
    return led.withColumn("allowed", F.col("hit") <= limit).drop("us", "leader_us")


def evaluate_rules(traffic: DataFrame, rules: DataFrame, event: str, sliding: bool = True,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(event, matched rules, allowed): every matching rule consumes, any denial denies.

    Events that match no rule are allowed and not listed.
    """
    matched = match_rules(traffic, rules).withColumn("state_key", state_key())
    windowed = (F.col("limit_type") != "byte") if sliding else F.lit(False)
    base = matched.select(
        event, "ts", "rule_id", "state_key", windowed.alias("_windowed"),
        F.col("limit_value").cast("bigint").alias("_limit"), F.col("burst_value").cast("bigint").alias("_burst"),
        F.when(F.col("limit_type") == "byte", F.coalesce("bytes", F.lit(0))).when(F.col("limit_type") == "packet", F.coalesce("packets", F.lit(1)))
        .otherwise(1).cast("bigint").alias("_cost"))
    base = written(base, "rule-matches")
    decided = replay_token_bucket(base.filter(~F.col("_windowed")), ["state_key"], [event], "_limit", "_burst", "_cost", chunk_rows)
    if sliding:
        counted = replay_sliding_window(base.filter("_windowed"), ["state_key"], [event], 1, "_limit", chunk_rows)
        decided = decided.unionByName(counted)
    return decided.groupBy(event).agg(F.count("*").alias("rules"), F.bool_and("allowed").alias("allowed"))


def blocked(flows: DataFrame, blocks: DataFrame, how: str = "left_anti", ip: str = "ip_src") -> DataFrame:
    """Flows not under (`left_anti`) or under (`left_semi`) an active block at their event time."""
    b = small_side(merged_blocks(blocks).withColumnRenamed("ip", "_ip"))
    on = (F.col(ip) == F.col("_ip")) & (F.col("created_at") <= F.col("ts")) & (F.col("ts") <= F.col("expires_at"))
    return flows.join(b, on, how)


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """Overlapping blocks of an address as one: a flow then meets at most one interval per address.

    A missing expiry means for ever.
    """
    ends = F.coalesce("expires_at", F.lit(datetime(9999, 1, 1)))
    spans = blocks.select("ip", "created_at", ends.alias("expires_at")).distinct()
    order = Window.partitionBy("ip").orderBy("created_at", "expires_at")
    covered = F.max("expires_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("created_at") > covered, F.lit(True)).cast("int")
    numbered = spans.withColumn("_o", opens).withColumn("_i", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("ip", "_i").agg(F.min("created_at").alias("created_at"), F.max("expires_at").alias("expires_at")).drop("_i")
