"""Row-frame statistics that stay parallel on long histories.

A frame such as "the last 50 windows of this size" would put the whole history of a size into one
task. Here rows get a global rank from per-chunk counts, are cut into blocks of ranks, and each
block carries the few preceding rows that its frames reach back to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DriftSettings, RollingSettings, ThresholdSettings
from ..functions.numeric import r6


def global_rank(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "rn") -> DataFrame:
    """1-based rank per key in `order`; `chunk` must grow with the order.

    Ranks are local to a chunk plus the row count of earlier chunks, so only the per-chunk counts
    of a key ever meet in one task.
    """
    chunked = df.withColumn("_chunk", chunk)
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    ranked = chunked.withColumn("_local", F.row_number().over(local)).join(offsets, [*keys, "_chunk"])
    return ranked.withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", "_chunk")


def with_reach(ranked: DataFrame, back: int, block: int, rank: str = "rn") -> DataFrame:
    """Blocks of ranks; the last `back` rows of a block are repeated at the head of the next one."""
    if back > block:
        raise ValueError("a frame may not reach over more than one block")
    b = F.expr(f"({rank} - 1) div {block}")
    into_next = F.pmod(F.col(rank) - 1, F.lit(block)) >= block - back
    blocks = F.when(into_next, F.array(b, b + 1)).otherwise(F.array(b))
    return ranked.withColumn("_home", b).withColumn("_block", F.explode(blocks))


def own_rows(df: DataFrame) -> DataFrame:
    """Drops the repeated rows again."""
    return df.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def _ranked_windows(windows: DataFrame, back: int, block: int) -> DataFrame:
    chunk = F.expr(f"window_start div (window_size * {block})")
    return with_reach(global_rank(windows, ["window_size"], ["window_start"], chunk), back, block)


def _frame(rows: int):
    return Window.partitionBy("window_size", "_block").orderBy("rn").rowsBetween(-(rows - 1), 0)


def _mean_std(value: Column, frame) -> tuple[Column, Column]:
    return F.avg(value).over(frame), F.stddev_pop(value).over(frame)


def rolling_zscore(windows: DataFrame, settings: RollingSettings = RollingSettings(), block: int = 4096) -> DataFrame:
    """Mean and deviation of the last windows (current one included) and the anomaly flags they imply.

    Z-scores are compared after rounding to nine decimals: with ten windows the largest possible
    score is exactly the limit and must not fire by rounding noise.
    """
    ranked = _ranked_windows(windows, settings.history - 1, block)
    frame = _frame(settings.history)
    n = F.count("*").over(frame)
    pm, ps = _mean_std(F.col("packets_per_second"), frame)
    em, es = _mean_std(F.col("entropy_src_ip"), frame)
    enough = F.col("_n") >= settings.min_history
    stats = own_rows(ranked.withColumns({"_n": n, "_pm": pm, "_ps": ps, "_em": em, "_es": es}))
    zp = F.round(F.abs(F.col("packets_per_second") - F.col("_pm")) / F.col("_ps"), 9)
    ze = F.round((F.col("entropy_src_ip") - F.col("_em")) / F.col("_es"), 9)
    stats = stats.withColumns({
        "rolling_mean_packets": F.when(enough, F.col("_pm")), "rolling_std_packets": F.when(enough, F.col("_ps")),
        "rolling_mean_entropy": F.when(enough, F.col("_em")), "rolling_std_entropy": F.when(enough, F.col("_es")),
        "z_packets": F.when(enough & (F.col("_ps") > 1e-12), zp), "z_entropy": F.when(enough & (F.col("_es") > 1e-12), ze)})
    packets = F.coalesce(F.col("z_packets") > settings.sigmas, F.lit(False))
    entropy = F.coalesce(F.col("z_entropy") < -settings.sigmas, F.lit(False))
    score = F.greatest(F.lit(0.0), F.when(packets, F.col("z_packets")), F.when(entropy, -F.col("z_entropy")))
    return stats.withColumns({"is_anomaly_packets": packets, "is_anomaly_entropy": entropy, "anomaly_score": score}
                             ).drop("_n", "_pm", "_ps", "_em", "_es", "rn")


def packet_rate_events(scored: DataFrame) -> DataFrame:
    """Windows whose packet rate is anomalous, as detection events."""
    return scored.filter("is_anomaly_packets").withColumn("detection_type", F.lit("packet_rate_anomaly"))


def dynamic_thresholds(windows: DataFrame, settings: ThresholdSettings = ThresholdSettings(),
                       block: int = 4096) -> DataFrame:
    """Adaptive upper packet limit, lower entropy limit and entropy baseline per window."""
    ranked = _ranked_windows(windows, settings.history - 1, block)
    frame = _frame(settings.history)
    pm, ps = _mean_std(F.col("packets_per_second"), frame)
    em, es = _mean_std(F.col("entropy_src_ip"), frame)
    rows = own_rows(ranked.withColumns({"_n": F.count("*").over(frame), "_pm": pm, "_ps": ps, "_em": em, "_es": es}))
    enough = (F.col("_n") >= settings.min_history) & F.lit(settings.dynamic)
    upper = F.greatest(F.col("_pm") + settings.sigmas * F.col("_ps"), F.lit(float(settings.pps)))
    lower = F.greatest(F.lit(0.0), F.least(F.col("_em") - settings.sigmas * F.col("_es"),
                                           F.lit(settings.entropy_floor)))
    warm = F.col("_n") >= settings.min_history
    return rows.withColumns({
        "pps_limit": F.when(enough, upper).otherwise(F.lit(float(settings.pps))),
        "entropy_lower": F.when(enough, lower).otherwise(F.lit(settings.entropy_floor)),
        "entropy_baseline": F.when(warm, F.col("_em")),
        "entropy_limit": F.when(warm, F.greatest(F.lit(settings.entropy_floor),
                                                 F.col("_em") - settings.entropy_margin))}
    ).drop("_n", "_pm", "_ps", "_em", "_es", "rn")


def sequences(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, length: int = 10,
              block: int = 4096) -> DataFrame:
    """Sliding sequences of `length` consecutive values; incomplete ones are left out."""
    ranked = with_reach(global_rank(rows, keys, order, chunk), length - 1, block)
    frame = Window.partitionBy(*keys, "_block").orderBy("rn").rowsBetween(-(length - 1), 0)
    built = own_rows(ranked.withColumn("sequence", F.collect_list(value).over(frame)))
    return built.filter(F.size("sequence") == length)


def seasonal_baseline(windows: DataFrame, value: str, period_hours: int = 24, sigmas: tuple[float, ...] = (1.0, 2.0, 3.0),
                      learning: int = 24) -> DataFrame:
    """Mean and deviation of the same hour in earlier seasons (at most `learning` of them) and the band hit.

    A season slot (hour of day, or hour of week with 168) of a window size holds at most one row per
    season and sub-hour offset, so a partition grows by one row per day or week.
    """
    slot = F.expr(f"(window_start div 3600) % {period_hours}")
    offset = F.expr("window_start % 3600")
    frame = (Window.partitionBy("window_size", "slot", "offset").orderBy("window_start").rowsBetween(-learning, -1))
    base = windows.withColumn("slot", slot).withColumn("offset", offset)
    stats = base.withColumns({"season_mean": F.avg(value).over(frame), "season_std": F.stddev_pop(value).over(frame),
                              "season_n": F.count(value).over(frame)})
    z = F.when((F.col("season_n") >= 2) & (F.col("season_std") > 1e-12),
               F.abs(F.col(value) - F.col("season_mean")) / F.col("season_std"))
    band = F.when(z.isNull(), None)
    for level, limit in enumerate(sorted(sigmas, reverse=True)):
        band = band.when(z > limit, len(sigmas) - level)
    return stats.withColumn("band", band.when(z.isNotNull(), 0)).drop("offset")


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n latest rows by the ordering columns."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def trend(values: DataFrame, keys: list[str], order: str, value: str, chunk: Column | None = None,
          settings: DriftSettings = DriftSettings()) -> DataFrame:
    """Least-squares slope over the row index and its direction (fewer than two rows: stable).

    `chunk` splits long histories for the ranking, as in `global_rank`.
    """
    ranked = global_rank(values, keys, [order], F.lit(0) if chunk is None else chunk, "_i")
    slope = F.when(F.count("*") >= 2, F.regr_slope(F.col(value), F.col("_i").cast("double"))).otherwise(F.lit(0.0))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), r6(slope).alias("slope"))
    return out.withColumn("trend", F.when(F.col("slope") > settings.trend_slope, "increasing")
                          .when(F.col("slope") < -settings.trend_slope, "decreasing").otherwise("stable"))
