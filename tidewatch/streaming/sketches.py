"""Windows from bounded, mergeable summaries: a flood of spoofed addresses does not grow what a stream keeps.

The exact first level keeps a row for every address of a bucket. Here a bucket keeps, for each dimension, a sketch of
its distinct keys (HyperLogLog), the exact total weight, and the heaviest `counters` keys with a bound on what any key
may weigh beyond what is listed for it. Summaries of batches, buckets and windows merge to summaries of the same size.
There is no stream state at all: a batch writes its summaries, and late rows count in their bucket whenever they come.

Errors: totals are exact. A distinct count has a relative standard deviation of 1.04 / sqrt(2**LOG_CELLS), 1.6 percent.
A key weighs at least its listed weight and at most that plus `missed`; a key that is not listed at most `missed`. The
entropy lies between `entropy_low` and `entropy_high`, up to DISTINCT_SLACK on the distinct count for the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import ALL, DIMENSIONS, first_level, totals_from_buckets
from ..sources.messages import for_each_batch
from .batches import BatchTable

COUNTERS, LOG_CELLS = 256, 12
DISTINCT_SLACK = 1.05
COMPACT_EVERY = 32


def _listed(weights: DataFrame, keys: list[str], counters: int) -> DataFrame:
    """(keys, counters, over): the heaviest keys, heaviest first, and the largest weight that is not listed."""
    heaviest = Window.partitionBy(*keys).orderBy(F.desc("weight"), "key")
    ranked = weights.withColumn("rank", F.row_number().over(heaviest)).where(F.col("rank") <= counters + 1)
    entry = F.when(F.col("rank") <= counters, F.struct("rank", "key", "weight"))
    lists = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("l"), F.max(F.when(F.col("rank") > counters, F.col("weight"))).alias("over"))
    return lists.select(*keys, F.transform("l", lambda x: F.struct(x["key"].alias("key"), x["weight"].alias("weight"))).alias("counters"), F.coalesce("over", F.lit(0)).alias("over"))


def summaries(weights: DataFrame, keys: list[str], counters: int = COUNTERS) -> DataFrame:
    """(keys, cells, weight, missed, counters) of exact weights (keys, key, weight), one row per key."""
    sums = weights.groupBy(*keys).agg(F.hll_sketch_agg("key", LOG_CELLS).alias("cells"), F.sum("weight").alias("weight"))
    return sums.join(_listed(weights, keys, counters), keys).select(*keys, "cells", "weight", F.col("over").alias("missed"), "counters")


def merged(parts: DataFrame, keys: list[str], counters: int = COUNTERS) -> DataFrame:
    """The summaries of the same keys as one of the same size. What each part may have missed of a key adds up."""
    listed = parts.select(*keys, F.explode("counters").alias("c")).groupBy(*keys, F.col("c.key").alias("key")).agg(F.sum("c.weight").alias("weight"))
    sums = parts.groupBy(*keys).agg(F.hll_union_agg("cells").alias("cells"), F.sum("weight").alias("weight"), F.sum("missed").alias("missed"))
    return sums.join(_listed(listed, keys, counters), keys).select(*keys, "cells", "weight", (F.col("missed") + F.col("over")).alias("missed"), "counters")


def measured(summary: DataFrame) -> DataFrame:
    """Adds `unique` and the bounds `entropy_low` and `entropy_high` (bits) to summaries.

    What the list leaves of the total weight adds least to the sum of c * log2(c) when spread over all other keys, and
    most when the heaviest keys weigh `missed` more each and others `missed` each, until it is used up.
    """
    def part(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c)).otherwise(0.0)

    weights = F.transform("counters", lambda c: c["weight"].cast("double"))
    out = summary.withColumn("_w", weights).withColumn("unique", F.hll_sketch_estimate("cells"))
    total = F.col("weight").cast("double")
    out = out.withColumn("_rest", F.greatest(total - F.aggregate("_w", F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))
    others = F.greatest(F.col("unique") * DISTINCT_SLACK - F.size("_w"), F.lit(1.0))
    least = F.aggregate("_w", F.lit(0.0), lambda a, x: a + part(x)) + F.col("_rest") * F.log2(F.greatest(F.col("_rest") / others, F.lit(1.0)))
    missed = F.col("missed").cast("double")

    def heavier(state: Column, x: Column) -> Column:
        more = F.least(missed, state["rest"])
        return F.struct((state["rest"] - more).alias("rest"), (state["sum"] + part(x + more)).alias("sum"))

    most = F.aggregate("_w", F.struct(F.col("_rest").alias("rest"), F.lit(0.0).alias("sum")), heavier, lambda s: s["sum"] + s["rest"] * F.log2(F.greatest(missed, F.lit(1.0))))

    def entropy(log_sum: Column) -> Column:
        return F.greatest(F.log2(total) - log_sum / total, F.lit(0.0))

    return out.withColumns({"entropy_low": entropy(most), "entropy_high": entropy(least)}).drop("_w", "_rest")


def windows_of(level: DataFrame, sizes: list[int], counters: int = COUNTERS) -> DataFrame:
    """(window_size, window_start, dim, weight, missed, counters, unique, entropy_low, entropy_high) from bucket summaries."""
    sized = level.withColumn("window_size", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])))
    placed = sized.withColumn("window_start", F.col("bucket") - F.pmod("bucket", "window_size"))
    return measured(merged(placed, ["window_size", "window_start", "dim"], counters)).drop("cells")


class SketchedWindows:
    """A stream of flows into bucket summaries and exact bucket totals, in two tables below `folder`.

    Every COMPACT_EVERY batches the batches so far become one summary a bucket and dimension, so neither the rows of a
    bucket nor the files that are read grow with the number of keys or batches.
    """

    def __init__(self, folder: str, sizes: list[int], dims: list[str] | None = None, counters: int = COUNTERS, every: int = COMPACT_EVERY):
        self.folder, self.sizes, self.dims = folder, sizes, dims or list(DIMENSIONS)
        self.counters, self.every = counters, every

    def _tables(self, rows: DataFrame) -> tuple[BatchTable, BatchTable]:
        return BatchTable(rows.sparkSession, f"{self.folder}/sketches"), BatchTable(rows.sparkSession, f"{self.folder}/totals")

    def _batch(self, flows: DataFrame, batch: int) -> None:
        level = first_level(flows, self.sizes, self.dims)
        sketches, totals = self._tables(flows)
        weights = level.where(F.col("dim") != ALL).select("bucket", "dim", "key", "weight")
        sketches.write(summaries(weights, ["bucket", "dim"], self.counters), batch)
        totals.write(level.where(F.col("dim") == ALL).drop("dim", "key", "weight"), batch)
        if batch % self.every == self.every - 1:
            self.compact(flows)

    def compact(self, flows: DataFrame) -> None:
        sketches, totals = self._tables(flows)
        sketches.compact(lambda rows: merged(rows, ["bucket", "dim"], self.counters))
        totals.compact(_summed)

    def run(self, flows: DataFrame) -> None:
        """Drains the available input."""
        for_each_batch(flows, self._batch, f"{self.folder}/checkpoint").awaitTermination()

    def windows(self, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(exact totals, summaries by dimension) of the windows of every size."""
        sketches, totals = self._tables(flows)
        return totals_from_buckets(_summed(totals.read()), self.sizes), windows_of(sketches.read(), self.sizes, self.counters)


def _summed(rows: DataFrame) -> DataFrame:
    """One row a bucket from those of several batches."""
    merge = {"min_packet_size": F.min, "max_packet_size": F.max}
    return rows.groupBy("bucket").agg(*[merge.get(c, F.sum)(c).alias(c) for c in rows.columns if c not in ("bucket", "batch")])
