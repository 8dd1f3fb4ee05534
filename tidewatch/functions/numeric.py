"""Numeric column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def r6(x: Column | str) -> Column:
    """Round half up at six decimals with plain double arithmetic."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def ratio(num: Column, den: Column) -> Column:
    """`num / den`, 0 where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def counter(x: Column) -> Column:
    """A counter as a non-negative long; unreadable or missing values count as 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(x.try_cast("bigint"), F.lit(0).cast("long")))


def micros(ts: Column | str) -> Column:
    """Event time as microseconds since the epoch (timestamp with or without zone)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def bucket_start(us: Column, seconds: int | Column) -> Column:
    """Epoch second at which the tumbling bucket of `seconds` holding `us` starts."""
    width = (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("long") * F.lit(MICROS)
    return F.call_function("div", us - F.pmod(us, width), F.lit(MICROS).cast("long"))


def finite(x: Column, bound: float = 1e6) -> Column:
    """NaN and null become 0, everything else is clipped to [-bound, bound]."""
    clean = F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), clean))


def entropy_from_sums(total: Column, sum_clog: Column) -> Column:
    """Shannon entropy in bits from `sum(c)` and `sum(c * log2(c))`."""
    return F.when(total > 0, F.log2(total.cast("double")) - sum_clog / total).otherwise(F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
