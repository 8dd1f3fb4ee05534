"""Streaming windows and the streaming detector.

A stream keeps only the first level: totals and key weights per smallest bucket, with a watermark
that evicts finished buckets. Each micro-batch writes the buckets it changed as its own partition,
so a repeated batch replaces itself. Distinct counts, entropies, larger windows, rolling limits and
alerts are batch operators over that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EnsembleSettings, ThresholdSettings
from ..operators import detect, ensemble, metrics, rolling
from ..operators.alerts import throttle
from ..operators.windows import ALL, DIMENSIONS, assemble, common_bucket, from_level, level_rows, measured, total_aggregates
from ..sources.messages import for_each_batch, to_messages
from .batches import BatchTable

KEYS = ["bucket", "dim", "key"]
START_OF_TIME = -(1 << 40)
LAST_BATCH = 1 << 30
COMPACT_EVERY = 32


def first_level(flows: DataFrame, seconds: int, dims: list[str], lateness: str = "60 seconds") -> DataFrame:
    """Streaming aggregate of (bucket, dim, key); the row with dim `*` carries the totals."""
    rows = flows.withWatermark("ts", lateness).select("ts", *measured(flows), level_rows(flows, dims).alias("p")).select("*", "p.*")
    grouped = rows.filter(F.col("key").isNotNull()).groupBy(F.window("ts", f"{seconds} seconds").alias("win"), "dim", "key")
    out = grouped.agg(F.sum("w").alias("weight"), *total_aggregates(F.col("dim") == ALL))
    return out.withColumn("bucket", F.unix_seconds(F.col("win.start"))).drop("win")


def upsert(path: str, every: int | None = None):
    """foreachBatch handler: the batch's rows under `batch=N`, replaced when the batch is repeated; every so many batches
    only the newest version of each row is kept."""
    every = every or COMPACT_EVERY

    def write(rows: DataFrame, batch: int) -> None:
        table = BatchTable(rows.sparkSession, path)
        table.write(rows, batch)
        if batch % every == every - 1:
            table.compact(lambda found: latest(found, KEYS))

    return write


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of every row of an upserted table."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    best = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return best.select(*keys, "r.*")


def windows_from(level: DataFrame, sizes: list[int], dims: list[str], top: int = 20) -> DataFrame:
    """Full window rows of every size from the first-level table."""
    return assemble(*from_level(level, sizes), dims, top)


def run_windows(flows: DataFrame, path: str, checkpoint: str, sizes: list[int], dims: list[str] | None = None,
                lateness: str = "60 seconds") -> DataFrame:
    """Drains the available input and returns the first-level table."""
    dims = dims or list(DIMENSIONS)
    stream = first_level(flows, common_bucket(sizes), dims, lateness)
    query = for_each_batch(stream, upsert(path), checkpoint, "update")
    query.awaitTermination()
    return latest(BatchTable(flows.sparkSession, path).read(), KEYS)


def first_hit_window_stream(flows: DataFrame, seconds: int, offset_seconds: int, lateness: str = "60 seconds") -> DataFrame:
    """One window size that starts at an offset instead of the epoch."""
    window = F.window("ts", f"{seconds} seconds", startTime=f"{offset_seconds % seconds} seconds")
    return flows.withWatermark("ts", lateness).groupBy(window.alias("win")).agg(
        F.sum("packets").alias("total_packets"), F.count("*").alias("total_flows"))


class Detector:
    """Flows to alerts: one stream keeps the first level, its batches judge the windows that have closed.

    A window closes when the newest bucket starts `lateness_seconds` past its end and is judged once: threshold rules,
    the entropy vote and, with `model` (adds `ml_is_attack` and `ml_confidence` to window rows), the model's vote make a
    verdict by `strategy`; verdicts pass the throttle; admitted ones become alert messages and metric rows.

    What a batch reads does not grow with the batches before it: the first level is stored by day, compacted every
    COMPACT_EVERY batches and pruned to the days that the closing windows need; the last windows of every size, the last
    admitted verdicts and how far the batch before has judged are carried from batch to batch as small tables. Every output is a partition per batch, so a repeated batch replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, folder: str, sizes: list[int], dims: list[str] | None = None,
                 settings: ThresholdSettings = ThresholdSettings(), lateness_seconds: int = 60,
                 model: Callable[[DataFrame], DataFrame] | None = None, strategy: str = "weighted",
                 ensemble_settings: EnsembleSettings = EnsembleSettings()):
        self.spark, self.folder, self.sizes = spark, folder, sizes
        self.dims = dims or list(DIMENSIONS)
        self.settings, self.lateness = settings, lateness_seconds
        self.model, self.strategy, self.rules = model, strategy, ensemble_settings

    def run(self, flows: DataFrame, finish: bool = True) -> None:
        """Drains the available input; `finish` judges the windows still open at the end."""
        stream = first_level(flows, common_bucket(self.sizes), self.dims, f"{self.lateness} seconds")
        self.query = for_each_batch(stream, self._batch, f"{self.folder}/checkpoint", "update")
        self.query.awaitTermination()
        if finish:
            self._judge(LAST_BATCH, START_OF_TIME, everything=True)

    def table(self, name: str) -> DataFrame:
        """An output: windows, alerts, verdicts (with `kept`), messages or metrics."""
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def alert_rows(self) -> DataFrame:
        return self.table("alerts")

    def _level(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.folder}/level", ("day",))

    def _write(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _carried(self, name: str, mark: Row | None) -> DataFrame | None:
        return None if mark is None else self.spark.read.parquet(f"{self.folder}/{name}/batch={mark['mark']}")

    def _batch(self, rows: DataFrame, batch: int) -> None:
        level = self._level()
        level.write(rows.withColumn("day", F.expr("bucket div 86400")), batch)
        if batch % COMPACT_EVERY == COMPACT_EVERY - 1:
            level.compact(lambda found: latest(found, [*KEYS, "day"]))
        newest = rows.agg(F.coalesce(F.max("bucket"), F.lit(START_OF_TIME))).first()[0]
        self._judge(batch, newest, everything=False)

    def _judge(self, batch: int, newest: int, everything: bool) -> None:
        mark = self._last_mark(batch)
        before = mark["closed"] if mark else START_OF_TIME
        newest = max(newest, mark["newest"] if mark else START_OF_TIME)
        if newest == START_OF_TIME:
            return
        largest, base = max(self.sizes), common_bucket(self.sizes)
        closed = max(before, newest + base + largest if everything else newest - self.lateness)
        end = F.col("window_start") + F.col("window_size")
        stored = self._level().read().filter((F.col("day") >= (before - largest) // 86400) & (F.col("bucket") >= before - largest))
        level = latest(stored.drop("day"), KEYS)
        closing = self._write(windows_from(level, self.sizes, self.dims).filter((end > before) & (end <= closed)), "windows", batch)
        earlier = self._carried("recent", mark)
        known = closing if earlier is None else closing.unionByName(earlier)
        newest_first = Window.partitionBy("window_size").orderBy(F.desc("window_start"))
        recent = known.withColumn("_r", F.row_number().over(newest_first)).filter(F.col("_r") < max(self.settings.history, self.settings.min_history)).drop("_r")
        self._write(recent, "recent", batch)
        limits = self._write(rolling.dynamic_thresholds(known, self.settings).filter(end > before), "limits", batch)
        alerts = self._write(detect.raise_alerts(limits, detect.threshold_rules(limits, self.settings), self.settings), "alerts", batch)
        self._decide(limits, alerts, batch, mark, before)
        self._write(self.spark.range(1).select(F.lit(batch).cast("bigint").alias("mark"), F.lit(closed).cast("bigint").alias("closed"),
                                               F.lit(newest).cast("bigint").alias("newest")), "marks", batch)

    def _decide(self, limits: DataFrame, alerts: DataFrame, batch: int, mark: Row | None, before: int) -> None:
        votes = [ensemble.threshold_votes(alerts)]
        if self.model:
            limits = self.model(limits)
            votes.append(ensemble.ml_votes(limits))
        votes = ensemble.collect_votes(*votes, ensemble.entropy_votes(limits, self.rules))
        if self.strategy == "hierarchical":
            verdicts = ensemble.hierarchical(votes, limits if self.model else None, self.rules)
        else:
            verdicts = ensemble.STRATEGIES[self.strategy](votes, self.rules)
        end = F.col("window_start") + F.col("window_size")
        timed = verdicts.withColumn("ts", F.timestamp_seconds(end))
        earlier = self._carried("admitted", mark)
        # Verdicts admitted before are admitted again, for they kept the limits among themselves.
        judged = self._write(throttle(timed if earlier is None else timed.unionByName(earlier), ["window_size", "attack_type"], self.rules).drop("leader_us"),
                             "judged", batch)
        kept = judged.filter("kept").drop("kept")
        last = kept.agg(F.unix_seconds(F.max("ts"))).first()[0] or 0
        self._write(kept.filter(F.unix_seconds("ts") >= last - 60 - self.rules.throttle_gap_seconds), "admitted", batch)
        new = self._write(judged.filter(end > before), "verdicts", batch)
        admitted = new.filter("kept")
        payload = ensemble.alert_payload(admitted, limits)
        self._write(to_messages(payload, "alerts"), "messages", batch)
        found = metrics.counters(admitted, "attacks_detected_total", ["attack_type", "severity"])
        pps = metrics.gauges(limits.withColumn("ts", F.timestamp_seconds(end)), ["window_size"], ["packets_per_second"])
        gauge = pps.select(F.lit("packets_per_second").alias("name"), F.create_map(F.lit("window_size"), F.col("window_size").cast("string")).alias("labels"),
                           F.col("packets_per_second").cast("double").alias("value"))
        self._write(found.unionByName(gauge), "metrics", batch)

    def _last_mark(self, batch: int) -> Row | None:
        """How far the batch before has judged (one stored row per batch)."""
        before = BatchTable(self.spark, f"{self.folder}/marks").last_before(batch)
        return None if before is None else self.spark.read.parquet(f"{self.folder}/marks/batch={before}").first()
