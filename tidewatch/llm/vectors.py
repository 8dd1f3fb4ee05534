"""Shared by the vector searches: usable rows, exact products, and shards of rows met by tiles of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column, zero: bool) -> Column:
    """Not null or empty and all components finite; `zero`: a vector of zeros is usable."""
    v = vec.cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vec.isNotNull() & (F.size(v) > 0) & finite, F.lit(False)) & (F.lit(True) if zero else F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(vec_id, vec) of the usable rows with an id; of rows with the same id the smallest vector stands."""
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col), zero))
    return rows.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(F.col(vec_col).cast("array<double>")).alias("vec"))


def stack(vectors: list, dims: int | None = None) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones end in zeros, longer ones are cut at `dims`."""
    dims = max((len(v) for v in vectors), default=0) if dims is None else dims
    if vectors and all(len(v) == dims for v in vectors):
        return np.array([np.asarray(v) for v in vectors])
    out = np.zeros((len(vectors), dims), dtype=np.asarray(vectors[0]).dtype if vectors else float)
    for row, v in zip(out, vectors, strict=True):
        row[:min(dims, len(v))] = v[:dims]
    return out


def met(shards: DataFrame, n_shards: int, queries: DataFrame, n_tiles: int) -> tuple:
    """Both sides keyed by (shard, tile) for a cogroup: every shard meets every tile of queries once."""
    left = shards.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    tiled = queries.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(n_tiles)).cast("int"))
    right = tiled.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    return left.groupBy("shard", "tile"), right.groupBy("shard", "tile")


def parts(rows: int, size: int) -> int:
    return max(1, -(-rows // size))
