"""File scans and file sinks with explicit schemas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import AUDIT, PACKET


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV or Parquet by suffix; anything else is an error."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV scan needs a schema")
        return spark.read.schema(schema).csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    raise ValueError(f"unsupported file format: {path}")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines audit log; blank and unreadable lines are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def filter_audit(audit: DataFrame, start: datetime | None = None, end: datetime | None = None,
                 action: str | None = None) -> DataFrame:
    """Inclusive date range and action."""
    at = F.to_timestamp("timestamp")
    if start is not None:
        audit = audit.filter(at >= F.lit(start))
    if end is not None:
        audit = audit.filter(at <= F.lit(end))
    return audit.filter(F.col("action") == action) if action else audit


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Captured packet metadata (Parquet or JSON); rows without an IP layer are dropped."""
    reader = spark.read.schema(PACKET)
    frame = reader.parquet(path) if path.endswith(".parquet") else reader.json(path)
    return frame.filter(F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull())


def write_daily(events: DataFrame, path: str, ts: str = "timestamp", drop: tuple[str, ...] = ("host", "@version")) -> None:
    """ISO-8601 time parsed to `event_time`, one folder per day; `drop` columns are removed."""
    parsed = events.withColumn("event_time", F.try_to_timestamp(F.col(ts))).drop(*drop)
    parsed.withColumn("date", F.to_date("event_time")).write.mode("append").partitionBy("date").parquet(path)


def archive_older(table: DataFrame, ts: str, cutoff: Column, path: str, archive_date: str) -> None:
    """Rows before the cutoff as JSON under `archive_date=YYYYMMDD`."""
    table.filter(F.col(ts) < cutoff).write.mode("overwrite").json(f"{path}/archive_date={archive_date}")


def send_batch(rows: DataFrame, path: str, fmt: str = "json", records_per_file: int = 0) -> None:
    writer = rows.write.mode("append").format(fmt)
    if records_per_file:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    writer.save(path)
