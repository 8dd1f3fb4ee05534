"""Enrichment by number ranges (address blocks to places, owners, tags), which may overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side, written
from .ordered import _whole_groups

#: Values and range starts in one part, about.
PART_ROWS = 500_000


def _part_of(bounds: list[int]) -> Column | object:
    """Column function: the part that a number lies in, by binary search."""
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(np.int64), side="right"))

    return part


def _narrowest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each of the ascending values the narrowest range that holds it, of equals the first by start; -1 for none."""
    owner = np.full(len(values), -1)
    begin, end = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
    for i in np.lexsort((-low, low - high)):  # wide ones first, narrower ones over them
        owner[begin[i]:end[i]] = i
    return owner


def range_lookup(rows: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, fields: list[str]) -> DataFrame:
    """Left join of each value with the narrowest range [lo, hi] that holds it; null fields where none does.

    Of ranges of one width the first by start counts, of equal ranges the one with the smallest fields; ranges with a
    null end or the ends the wrong way round hold nothing. The distinct values and the ranges are dealt to parts
    between sampled bounds; a range that reaches over bounds is in each of its parts, a value in one. A part is swept
    once. The found values then meet the rows again on equality, so a value that a third of the rows has is one row of
    the sweep and a split side of that join.
    """
    values = written(rows.select(F.col(value).cast("bigint").alias("_v")).where("_v is not null").distinct(), "lookup-values")
    place = F.struct(*fields)
    spans = ranges.select(F.col(lo).cast("bigint").alias("_lo"), F.col(hi).cast("bigint").alias("_hi"), place.alias("_f")).where("_lo <= _hi")
    spans = written(spans.groupBy("_lo", "_hi").agg(F.min("_f").alias("_f")), "lookup-ranges")
    points = values.unionByName(spans.select(F.col("_lo").alias("_v")))
    parts = -(-points.count() // PART_ROWS)
    if parts > 1:
        steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        bounds = sorted(set(points.agg(F.percentile_approx("_v", steps, max(1000, 16 * parts))).first()[0]))
        part = _part_of(bounds)
        dealt = values.withColumn("_part", part("_v"))
        spread = spans.withColumn("_part", F.explode(F.sequence(part("_lo"), part("_hi"))))
    else:
        dealt, spread = (x.withColumn("_part", F.lit(0)) for x in (values, spans))
    kind = spans.schema["_f"].dataType.simpleString()
    asked = dealt.select("_part", F.lit(1).alias("_kind"), F.col("_v").alias("_lo"), F.col("_v").alias("_hi"), F.lit(None).cast(kind).alias("_f"))
    items = spread.select("_part", F.lit(0).alias("_kind"), "_lo", "_hi", "_f").unionByName(asked)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["_part"]):
            names, asks = table.column("_part").to_numpy(), table.column("_kind").to_numpy()
            low, high = table.column("_lo").to_numpy(), table.column("_hi").to_numpy()
            for name in np.unique(names):
                own = np.flatnonzero(names == name)
                some, held = own[asks[own] == 1], own[asks[own] == 0]
                found = _narrowest(low[some], low[held], high[held])
                hit = found >= 0
                yield pa.record_batch({"_v": pa.array(low[some][hit]), "_f": table.column("_f").take(pa.array(held[found[hit]])).combine_chunks()})

    found = items.repartition("_part").sortWithinPartitions("_part", "_kind", "_lo").mapInArrow(sweep, f"_v bigint, _f {kind}")
    joined = rows.join(small_side(found), F.col(value) == F.col("_v"), "left")
    return joined.select(*rows.columns, *[F.col(f"_f.{f}").alias(f) for f in fields])
