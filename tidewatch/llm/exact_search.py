"""Exact top-k inner-product search with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written
from .vectors import distinct_vectors, met, parts, stack

SCALE = 256
TOP = 5
BLOCK_ROWS = 128
SHARD_BLOCKS = 64
TILE_QUERIES = 1024
BLOCKS = "block bigint, ids binary, weights binary, dims int, rows int"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices, exactly: in doubles where every sum is below 2**53, else in Python integers."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of BLOCK_ROWS consecutive rows as forward indexes: ids and a matrix of weights."""
    held = pd.DataFrame()

    def pack(rows: pd.DataFrame) -> dict:
        weights = stack(list(rows["weights"])).astype(np.int64)
        ids = rows["vec_id"].to_numpy(np.int64)
        return {"block": int(ids[0]), "ids": ids.tobytes(), "weights": weights.tobytes(), "dims": weights.shape[1], "rows": len(ids)}

    for batch in batches:
        held = pd.concat([held, batch]) if len(held) else batch
        cut = len(held) // BLOCK_ROWS * BLOCK_ROWS
        if cut:
            yield pd.DataFrame([pack(held.iloc[i:i + BLOCK_ROWS]) for i in range(0, cut, BLOCK_ROWS)])
            held = held.iloc[cut:]
    if len(held):
        yield pd.DataFrame([pack(held)])


def _search(blocks: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best (scores, ids) of each query over the blocks, and how many of the (query, block) pairs were scored.

    Each query goes through the blocks in falling order of its bound, the sum over terms of weight times the block's
    extreme weight, and stops when the next bound is below its k-th score. An equal bound may hide a smaller id.
    """
    high, low = (np.array([f(w, axis=0) for _, w in blocks]) for f in (np.max, np.min))
    bound = products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    scores = np.full((len(queries), k), none, dtype=np.int64)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max, dtype=np.int64)
    active, done = np.arange(len(queries)), 0
    for turn in range(len(blocks)):
        following = order[active, turn]
        open_ = (bound[active, following] >= scores[active, -1])
        active, following = active[open_], following[open_]
        if not len(active):
            break
        for b in np.unique(following):
            rows = active[following == b]
            done += len(rows)
            block_ids, weights = blocks[b]
            got = products(queries[rows], weights)
            got[own[rows][:, None] == block_ids[None, :]] = none
            all_scores = np.concatenate([scores[rows], got], axis=1)
            all_ids = np.concatenate([ids[rows], np.broadcast_to(block_ids, got.shape)], axis=1)
            best = np.lexsort((all_ids, -all_scores.astype(float) if np.abs(all_scores[all_scores > none]).max(initial=0) < 2**53 else -(all_scores + 1)), axis=1)[:, :k]
            scores[rows], ids[rows] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
    return scores, ids, done


def _meet(blocks: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(blocks) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    dims = int(max(blocks["dims"].max(), queries["weights"].map(len).max()))
    packed = []
    for row in blocks.sort_values("block").itertuples():
        w = np.frombuffer(row.weights, np.int64).reshape(row.rows, row.dims)
        packed.append((np.frombuffer(row.ids, np.int64), np.pad(w, ((0, 0), (0, dims - row.dims)))))
    own = queries["vec_id"].to_numpy(np.int64)
    scores, ids, _ = _search(packed, stack([np.asarray(v, np.int64) for v in queries["weights"]], dims), own, k)
    found = scores > np.iinfo(np.int64).min
    return pd.DataFrame({"query_id": np.repeat(own, k)[found.ravel()], "vec_id": ids[found], "score": scores[found]})


def exact_top_k(candidates: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", weights_col: str = "weights", k: int = TOP) -> DataFrame:
    """The `k` candidates with the largest integer inner product for each query: query_id, rank, vec_id, score.

    Both frames hold (id, array of integer weights). A query's own id is no candidate of it; ties go to the smaller id;
    with fewer candidates all are returned. A missing term of a shorter vector weighs 0. Ids must be there and unique.
    Candidates are cut into blocks of consecutive ids; shards of blocks meet tiles of queries, each pair is searched
    alone with pruning, and the best of all shards are merged. Scores beyond a long are clipped.
    """
    rows = candidates.select(F.col(id_col).alias("vec_id"), F.col(weights_col).alias("weights"))
    ranged = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    blocks = written(ranged.mapInPandas(_blocks, BLOCKS), "search-blocks")
    asked = queries.select(F.col(id_col).alias("vec_id"), F.col(weights_col).alias("weights"))
    n_shards, n_tiles = parts(blocks.count(), SHARD_BLOCKS), parts(asked.count(), TILE_QUERIES)
    shards = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(n_shards)).cast("int"))
    left, right = met(shards, n_shards, asked, n_tiles)
    found = left.cogroup(right).applyInPandas(lambda a, b: _meet(a, b, k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, weights) with weights floor(scale * x). Rows without id, and vectors that are null or empty or hold null
    or non-finite components, take no part; of rows with the same id the smallest vector stands."""
    vectors = distinct_vectors(df, id_col, vec_col, zero=True)
    return vectors.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("weights"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quantised(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "search-weights")
    return exact_top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


OP7_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
