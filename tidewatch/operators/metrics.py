"""Metric roll-ups over event and sample tables: counters, gauges, histograms, rates, sustained alerts.

Samples are (series..., ts, value) rows; `series` names the columns that identify one time series.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.net import label_safe
from ..functions.numeric import MICROS
from .ordered import CHUNK_ROWS, lag_by_chunks
from .rolling import global_rank

# Histogram bounds.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]
ATTACK_DURATION_BOUNDS = [5, 10, 30, 60, 120, 300, 600, 1800, 3600]
PACKET_SIZE_BOUNDS = [64, 128, 256, 512, 1024, 1500, 4096, 8192, 16384]


def counters(rows: DataFrame, name: str, labels: list[str], amount: Column | None = None) -> DataFrame:
    """Count (or sum of `amount`) per label combination as metric rows."""
    total = (F.count("*") if amount is None else F.sum(amount)).cast("double")
    grouped = rows.groupBy(*labels).agg(total.alias("value"))
    pairs = [c for label in labels for c in (F.lit(label), F.col(label).cast("string"))]
    return grouped.select(F.lit(name).alias("name"), F.create_map(*pairs).alias("labels"), "value")


def gauges(rows: DataFrame, labels: list[str], values: list[str], ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """Latest value of each column per label combination."""
    latest = F.struct(ts, *(tie or []))
    return rows.groupBy(*labels).agg(*[F.max_by(v, latest).alias(v) for v in values])


def top_source_gauges(counts: DataFrame, ip: str = "ip_src", k: int = 10) -> DataFrame:
    """The k heaviest sources with label-safe names."""
    return counts.orderBy(F.desc("weight"), ip).limit(k).select(label_safe(F.col(ip)).alias("label"), "weight")


def histogram(rows: DataFrame, labels: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative buckets (`le`), sum and count; one conditional count per bound, no row is multiplied."""
    aggs = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*labels).agg(*aggs, F.count(value).alias("count"), F.sum(value).alias("sum"))
    buckets = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n")))
    return wide.select(*labels, "sum", "count", F.explode(F.array(*buckets)).alias("b")).select(*labels, "b.le", "b.n", "sum", "count")


def with_time_reach(df: DataFrame, us: str, reach_us: int, block_us: int) -> DataFrame:
    """Time blocks in which the last `reach_us` of the previous block are repeated."""
    if reach_us > block_us:
        raise ValueError("a range may not reach over more than one block")
    b = F.expr(f"`{us}` div {block_us}")
    late = F.pmod(F.col(us), F.lit(block_us)) >= block_us - reach_us
    return df.withColumn("_home", b).withColumn("_block", F.explode(F.when(late, F.array(b, b + 1)).otherwise(F.array(b))))


def over_time(samples: DataFrame, series: list[str], aggregate: Callable[[Column], Column], seconds: int,
              out: str, value: str = "value", ts: str = "ts", block_seconds: int = 3600) -> DataFrame:
    """Aggregate over the trailing `seconds` (both ends included), e.g. the maximum of the last minute."""
    reach = seconds * MICROS
    block = max(block_seconds * MICROS, reach)
    timed = with_time_reach(samples.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp"))), "us", reach, block)
    frame = Window.partitionBy(*series, "_block").orderBy("us").rangeBetween(-reach, 0)
    return timed.withColumn(out, aggregate(F.col(value)).over(frame)).filter("_home = _block").drop("_home", "_block", "us")


def increase(samples: DataFrame, series: list[str], seconds: int, tie: list[str], value: str = "value", ts: str = "ts",
             block_seconds: int = 3600, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Counter growth over the trailing `seconds` and its rate; a fall is a restart and counts in full.

    No extrapolation to the window edges.
    """
    timed = samples.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp")))
    lagged = lag_by_chunks(timed, series, ["us", *tie], [value], chunk_rows=chunk_rows)
    prev = F.col(f"prev_{value}")
    step = F.when(prev.isNull(), F.lit(0.0)).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
    grown = lagged.withColumn("_step", step.cast("double")).drop(f"prev_{value}", "us")
    summed = over_time(grown, series, F.sum, seconds, "increase", "_step", ts, block_seconds)
    return summed.withColumn("rate", F.col("increase") / seconds).drop("_step")


def increase_by(samples: DataFrame, series: list[str], by: list[str], seconds: int, step_seconds: int, tie: list[str], value: str = "value",
                ts: str = "ts", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`by`, at, increase: at every multiple of `step_seconds` the growth of all counters of a group over the `seconds`
    before it (its own instant included), a fall counting as a restart; points that no growth reaches have no row.

    A sample counts at the few points whose range it lies in, added up before the shuffle, so a group may hold any share
    of the samples. `step_seconds` must divide `seconds`.
    """
    if seconds % step_seconds:
        raise ValueError("the step must divide the range")
    timed = samples.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp")))
    lagged = lag_by_chunks(timed, series, ["us", *tie], [value], chunk_rows=chunk_rows)
    prev, now = F.col(f"prev_{value}"), F.col(value)
    grown = lagged.withColumn("_step", F.when(now < prev, now).otherwise(now - prev).cast("double")).where("_step is not null")
    first = F.expr(f"(us + {step_seconds * MICROS - 1}) div {step_seconds * MICROS}")
    points = F.sequence(first, first + (seconds // step_seconds - 1))
    placed = grown.select(*by, "_step", F.explode(points).alias("_point"))
    return placed.groupBy(*by, (F.col("_point") * step_seconds).alias("at")).agg(F.sum("_step").alias("increase"))


def sustained(samples: DataFrame, series: list[str], condition: Column, seconds: int, tie: list[str], ts: str = "ts",
              chunk_seconds: int = 3600) -> DataFrame:
    """Runs of consecutive samples that meet the condition for at least `seconds`."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    chunk = F.expr(f"us div {chunk_seconds * MICROS}")
    timed = samples.withColumn("us", us)
    ranked = global_rank(timed, series, ["us", *tie], chunk, "_all").filter(condition)
    again = global_rank(ranked, series, ["us", *tie], chunk, "_true")
    runs = again.groupBy(*series, (F.col("_all") - F.col("_true")).alias("_run")).agg(
        F.min(ts).alias("starts"), F.max(ts).alias("ends"), F.count("*").alias("samples"))
    length = F.unix_micros("ends") - F.unix_micros("starts")
    return runs.filter(length >= seconds * MICROS).drop("_run")


def top_series(samples: DataFrame, series: list[str], k: int = 10, value: str = "value", ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """The k series with the highest latest value (a report); of equal times the largest `tie` is the latest."""
    return gauges(samples, series, [value], ts, tie).orderBy(F.desc(value), *series).limit(k)


def observed(rows: DataFrame, name: str, conditions: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """Counts rows that meet each condition while the frame is used anyway (no extra pass)."""
    seen = Observation(name)
    counts = [F.count_if(c).alias(k) for k, c in conditions.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def export_snapshot(metric_rows: list[DataFrame], path: str, taken_at: Column, batch: int) -> None:
    """All metric rows of one moment as a partition; repeating a batch replaces it."""
    stacked = reduce(DataFrame.unionByName, metric_rows)
    stacked.select(taken_at.alias("ts"), "name", "labels", "value").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def custom(rows: DataFrame, name: str, labels: list[str], aggregate: Column) -> DataFrame:
    """A user-supplied aggregate as metric rows."""
    grouped = rows.groupBy(*labels).agg(aggregate.cast("double").alias("value"))
    pairs = [c for label in labels for c in (F.lit(label), F.col(label).cast("string"))]
    labelled = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return grouped.select(F.lit(name).alias("name"), labelled.alias("labels"), "value")
