"""Message-stream records: JSON values, keys, topics and the options of the Kafka source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Topic names.
TOPICS = {"flows": "network_flows", "alerts": "ddos_alerts", "metrics": "detection_metrics",
          "mitigation": "mitigation_events"}


def kafka_options(servers: str, topics: list[str], group: str | None = None, start: str = "latest",
                  max_records: int | None = None, security: dict[str, str] | None = None) -> dict[str, str]:
    """Options for `readStream.format("kafka")`. Offsets live in the query's checkpoint."""
    if start not in ("earliest", "latest", "none"):
        raise ValueError(f"unknown starting position: {start}")
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics)}
    if start == "none":
        options["failOnDataLoss"] = "true"
    else:
        options["startingOffsets"] = start
    if group:
        options["kafka.group.id"] = group
    if max_records:
        options["maxOffsetsPerTrigger"] = str(max_records)
    for key, value in (security or {}).items():
        options[f"kafka.{key}"] = value
    return options


def read_kafka(spark: SparkSession, **kwargs) -> DataFrame:
    """Topic, key and value as text. Needs the Kafka connector on the class path."""
    source = spark.readStream.format("kafka").options(**kafka_options(**kwargs)).load()
    return source.select("topic", F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def decode(messages: DataFrame, schema: T.StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(decoded rows, undecodable messages): the second part is the dead-letter table."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # Through a generator, so that the filters below do not parse the value again.
    parsed = messages.select("*", F.explode(F.array(F.from_json(value, with_bad, options))).alias("_row"))
    bad = F.col(value).isNull() | F.col("_row").isNull() | F.col("_row._corrupt").isNotNull()
    good = parsed.filter(~bad).select(*[F.col(f"_row.{f.name}") for f in schema.fields])
    return good, parsed.filter(bad).select(messages.columns)


def route(messages: DataFrame, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """One decoded frame per topic role (flows, alerts, metrics, mitigation)."""
    return {role: decode(messages.filter(F.col("topic") == TOPICS[role]), schema)[0]
            for role, schema in schemas.items()}


def _encoded(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.round(column, 6).alias(field.name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(field.name)
    return column


def to_messages(rows: DataFrame, role: str, key: Column | None = None, stamp: Column | None = None) -> DataFrame:
    """(topic, key, value) rows: times as ISO text, top-level doubles at six decimals.

    Flow messages are keyed by `flow_id`, else `ip_src`, else 'unknown'; the other roles get a
    `<role>_timestamp` field.
    """
    stamp = F.current_timestamp() if stamp is None else stamp
    suffix = {"alerts": "alert_timestamp", "metrics": "metric_timestamp", "mitigation": "mitigation_timestamp"}
    fields = [_encoded(f) for f in rows.schema.fields]
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if role in suffix:
        fields.append(iso.alias(suffix[role]))
    fields.append(iso.alias("_producer_timestamp"))
    if key is None:
        known = [F.col(c) for c in ("flow_id", "ip_src") if c in rows.columns] if role == "flows" else []
        key = F.coalesce(*[F.when(c != "", c) for c in known], F.lit("unknown"))
    return rows.select(F.lit(TOPICS[role]).alias("topic"), key.cast("string").alias("key"),
                       F.to_json(F.struct(*fields)).alias("value"))


def for_each_batch(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                   output_mode: str = "append"):
    """User callback per micro-batch; returns the started query."""
    return (stream.writeStream.outputMode(output_mode).foreachBatch(handler)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
