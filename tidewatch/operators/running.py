"""Distributed running sums and exact order statistics over values of any skew.

Values are first reduced to (value, counts); equal values, however frequent, become one row. The
distinct values are range-partitioned, sums run inside each range, and the sums of earlier ranges
are added. Nothing is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

LEAST_CHUNKS, CHUNK_VALUES = 8, 250_000


def value_chunks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds `_chunk`, growing with the value within a key: the range of (keys, value) that a row lies in.

    Spark samples the ranges, and a row's range is the partition it is in, so no row is compared with the bounds of
    all. The counts are written once before and the ranges once after, so both are the same whenever they are read. A
    range holds about CHUNK_VALUES distinct values, so their number grows with the data.
    """
    counts = written(counts, "values")
    chunks = max(LEAST_CHUNKS, -(-counts.count() // CHUNK_VALUES))
    ranged = counts.repartitionByRange(chunks, *keys, value)
    return written(ranged.withColumn("_chunk", F.spark_partition_id().cast("bigint")), "value-ranges")


def running_sums(rows: DataFrame, keys: list[str], order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """`cum_<c>` (this row included) and `all_<c>` for every column; rows carry `_chunk`."""
    sums = rows.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    by = F.desc if descending else F.asc
    before = Window.partitionBy(*keys).orderBy(by("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns],
                          *[F.sum(f"_s_{c}").over(whole).alias(f"all_{c}") for c in columns])
    local = Window.partitionBy(*keys, "_chunk").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *[F.sum(c).over(local).alias(f"_l_{c}") for c in columns])
    joined = inside.join(offsets, [*keys, "_chunk"])
    out = joined.withColumns({f"cum_{c}": F.col(f"_l_{c}") + F.col(f"_b_{c}") for c in columns})
    return out.drop(*[f"_l_{c}" for c in columns], *[f"_b_{c}" for c in columns])


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """`q0`, `q1`, ... per key: quantiles with linear interpolation between the two neighbouring ranks."""
    counts = value_chunks(value_counts(df, keys, value), keys, value)
    ranked = running_sums(counts, keys, value, ["n"]).withColumn("_from", F.col("cum_n") - F.col("n"))

    def at(index: Column) -> Column:
        hit = (F.col("_from") <= index) & (index < F.col("cum_n"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    aggs = []
    for i, p in enumerate(probs):
        place = (F.col("all_n") - 1) * F.lit(p)
        low = F.floor(place)
        aggs += [at(low).alias(f"_l{i}"), at(F.least(low + 1, F.col("all_n") - 1)).alias(f"_h{i}"),
                 F.max(place - low).alias(f"_f{i}")]
    grouped = ranked.groupBy(*keys).agg(*aggs)
    return grouped.select(*keys, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
                                   for i in range(len(probs))])


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column)."""
    return df.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("_p")).select(
        *ids, f"_p.{name}", f"_p.{value}")
