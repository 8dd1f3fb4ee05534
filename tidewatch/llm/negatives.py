"""Hard-negative mining by slot-decomposed selection over exact integer inner products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written
from .exact_search import SCALE, products
from .vectors import met, parts, stack, usable

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these percentages of its positive's score.
LOW, HIGH = 50, 95
SHARD_ROWS, TILE_ANCHORS = 8192, 512
NONE = np.iinfo(np.int64).min


def labelled(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, weights) with weights floor(scale * x), of the rows with an id, a label and a usable vector; of rows
    with the same id the one with the smallest vector, then label, stands."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vec_col), zero=True))
    kept = rows.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(
        F.min(F.struct(F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("long").alias("label"))).alias("r"))
    return kept.select("vec_id", "r.label", F.transform("r.vec", lambda x: F.floor(x * scale).cast("long")).alias("weights"))


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries of each row that are not NONE, the leftmost of equals first. `scores` is used up."""
    rows, columns = [], []
    every = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        there = scores[every, at] > NONE
        if not there.any():
            break
        rows.append(every[there])
        columns.append(at[there])
        scores[every, at] = NONE
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _scores(rows: pd.DataFrame, anchors: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The shard's rows by id, the score of each (anchor, row), and whether they have the same label."""
    rows = rows.sort_values("vec_id", ignore_index=True)
    dims = int(max(rows["weights"].map(len).max(), anchors["weights"].map(len).max()))
    scores = products(*(stack([np.asarray(v, np.int64) for v in side["weights"]], dims) for side in (anchors, rows)))
    return rows, scores, anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]


def _positives(rows: pd.DataFrame, anchors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The shard's best rows of each anchor's label."""
    if not len(rows) or not len(anchors):
        return pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []})
    rows, scores, same = _scores(rows, anchors)
    ids, own = rows["vec_id"].to_numpy(), anchors["vec_id"].to_numpy()
    scores[~same | (own[:, None] == ids[None, :])] = NONE
    found = scores.copy()
    a, b = best_columns(scores, k)
    return pd.DataFrame({"anchor_id": own[a], "positive_id": ids[b], "positive_score": found[a, b]})


def _slots(rows: pd.DataFrame, anchors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The shard's best rows of other labels in each slot of each anchor: slot i holds the scores above limit i + 1 and up to
    limit i of the falling `limits`; the last slot has no lower end."""
    if not len(rows) or not len(anchors):
        return pd.DataFrame({"anchor_id": [], "slot": [], "negative_id": [], "negative_score": []})
    rows, scores, same = _scores(rows, anchors)
    ids, own = rows["vec_id"].to_numpy(), anchors["vec_id"].to_numpy()
    scores[same] = NONE
    limits = np.full((len(anchors), max(anchors["limits"].map(len))), NONE, np.int64)
    for row, values in zip(limits, anchors["limits"], strict=True):
        row[:len(values)] = values
    out = []
    for slot in range(limits.shape[1]):
        low = limits[:, slot + 1] if slot + 1 < limits.shape[1] else np.full(len(limits), NONE, np.int64)
        inside = np.where((scores <= limits[:, slot, None]) & (scores > low[:, None]), scores, NONE)
        a, b = best_columns(inside, k)
        out.append(pd.DataFrame({"anchor_id": own[a], "slot": slot, "negative_id": ids[b], "negative_score": scores[a, b]}))
    return pd.concat(out)


def _best(found: DataFrame, by: list[str], score: str, row_id: str, k: int) -> DataFrame:
    first = Window.partitionBy(*by).orderBy(F.desc(score), row_id)
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, *, positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    `positives` other rows of the same label, the first `k` rows of other labels whose score is at least `low` and at
    most `high` percent of the positive's.

    Both frames hold (vec_id, label, weights): unique ids, labels that are there and arrays of integer weights. A score is
    the integer inner product with the anchor (a missing term of a shorter vector weighs 0; scores beyond a long are
    clipped); higher scores come first, ties by smaller id. The upper limits of an anchor's positives cut its scores into
    disjoint slots. Shards of rows meet tiles of anchors and each keeps the k best rows of every slot, which are merged
    over the shards; a window is the slots from its own limit down, so one merge from the lowest slot upwards answers all
    windows of an anchor, and what lies below a window's lower end is left out. Positives without negatives give no rows;
    neither do negative positive scores, whose windows are empty. Empty frames give no rows.
    """
    n_shards, n_tiles = parts(rows.count(), SHARD_ROWS), parts(anchors.count(), TILE_ANCHORS)
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    left, right = met(shards, n_shards, anchors, n_tiles)
    near = left.cogroup(right).applyInPandas(lambda a, b: _positives(a, b, positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = written(_best(near, ["anchor_id"], "positive_score", "positive_id", positives), "mining-positives")
    # floor and ceiling of a percentage, from the hundreds and the rest so that nothing overflows
    rest = F.expr("pmod(positive_score, 100)")
    whole = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    limit = whole * high + F.floor(rest * high / 100)
    least = whole * low + F.ceil(rest * low / 100)
    near = near.select("anchor_id", F.col("rank").alias("turn"), "positive_id", "positive_score", limit.cast("long").alias("limit"), least.cast("long").alias("least"))
    bounds = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list("limit"), asc=False).alias("limits"))
    asked = written(anchors.join(bounds, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "weights", "limits"), "mining-anchors")
    left, right = met(shards, n_shards, asked, n_tiles)
    slots = left.cogroup(right).applyInPandas(lambda a, b: _slots(a, b, k), "anchor_id bigint, slot int, negative_id bigint, negative_score bigint")
    slots = _best(slots, ["anchor_id", "slot"], "negative_score", "negative_id", k)
    entry = F.struct((-F.col("negative_score")).alias("less"), F.col("negative_id"))
    held = slots.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", entry.alias("entry"))).alias("held"))
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("turn", "positive_id", "positive_score", "least"))).alias("windows"))

    # from the lowest slot upwards: the k best of the slot and of those below it
    def merge(done: Column, slot: Column) -> Column:
        own = F.transform(F.filter("held", lambda h: h["slot"] == slot), lambda h: h["entry"])
        below = F.when(F.size(done) == 0, F.expr("CAST(array() AS array<struct<less: bigint, negative_id: bigint>>)")).otherwise(F.try_element_at(done, F.lit(-1)))
        return F.concat(done, F.array(F.slice(F.array_sort(F.concat(own, below)), 1, k)))

    lowest_first = F.expr("sequence(size(windows) - 1, 0, -1)")
    empty = F.expr("CAST(array() AS array<array<struct<less: bigint, negative_id: bigint>>>)")
    merged = windows.join(held, "anchor_id").withColumn("merged", F.reverse(F.aggregate(lowest_first, empty, merge)))
    each = merged.select("anchor_id", F.explode(F.arrays_zip("windows", "merged")).alias("w"))
    each = each.select("anchor_id", "w.windows.*", F.posexplode("w.merged").alias("pos", "found"))
    each = each.where(-F.col("found.less") >= F.col("least"))
    return each.select("anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("found.negative_id").alias("negative_id"),
                       "positive_score", (-F.col("found.less")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    changed = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = written(rows.withColumn("label", changed), "mining-rows")
    return hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
         vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  WHERE {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT * FROM ranked WHERE rank <= {NEGATIVES}
"""
