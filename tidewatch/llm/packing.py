"""Conflict-constrained best-fit packing of documents into sequences of bounded length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, word_count

CAPACITY = 2048
PER_SOURCE = 4
SHARD_ROWS = 20_000
SCHEMA = "doc_id {id}, piece bigint, start_word bigint, n_words bigint, bin_id bigint, bin_words bigint"


def _numbers(values: Sequence[Hashable | None], least: int) -> list[int]:
    """A small number for each value that more than `least` items have, -1 for others and None: those can't conflict."""
    counts = Counter(v for v in values if v is not None)
    known = {v: i for i, v in enumerate(k for k, n in counts.items() if n > least)}
    return [known.get(v, -1) for v in values]


def best_fit(sizes: Sequence[int], sources: Sequence[Hashable | None], clusters: Sequence[Hashable | None], capacity: int,
             per_source: int = PER_SOURCE) -> list[int]:
    """The bin of each item, taken in the given order.

    Bins are kept in order of their residual. The search starts at the successor of the item's size, the tightest bin
    that it fits, and goes on until a bin's bitmaps allow it: no item of the same cluster (one bit a cluster), fewer than
    `per_source` items of its source (`per_source` bits a source). If none does, a bin is opened.
    """
    source_no, cluster_no = _numbers(sources, per_source), _numbers(clusters, 1)
    full = (1 << per_source) - 1
    residuals: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins = []
    for size, s, c in zip(sizes, source_no, cluster_no, strict=True):
        i = bisect_left(residuals, (size, -1))
        while i < len(residuals):
            b = residuals[i][1]
            if (c < 0 or not cluster_bits[b] >> c & 1) and (s < 0 or source_bits[b] >> s * per_source & full != full):
                room = residuals.pop(i)[0]
                break
            i += 1
        else:
            b, room = len(source_bits), capacity
            source_bits.append(0)
            cluster_bits.append(0)
        if s >= 0:
            held = source_bits[b] >> s * per_source & full
            source_bits[b] |= (held + 1) << s * per_source
        if c >= 0:
            cluster_bits[b] |= 1 << c
        insort(residuals, (room - size, b))
        bins.append(b)
    return bins


def _pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
    size = rows["size"].to_numpy(np.int64)
    wholes, rest = size // capacity, size % capacity
    shard = int(rows["shard"].iloc[0]) << 32
    at = np.repeat(np.arange(len(rows)), wholes)  # a piece of full length has a bin to itself
    piece = np.arange(len(at)) - np.repeat(np.cumsum(wholes) - wholes, wholes)
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    source, cluster = (rows[c].astype(object).where(rows[c].notna(), None).to_numpy() for c in ("source", "cluster"))
    bins = np.array(best_fit(rest[order].tolist(), source[order].tolist(), cluster[order].tolist(), capacity, per_source), dtype=np.int64)
    fill = np.bincount(bins, rest[order], minlength=1).astype(np.int64) if len(order) else np.zeros(1, np.int64)
    none = np.flatnonzero(size == 0)
    doc = np.concatenate([at, order, none])
    packed = len(at) + len(order)
    out = pd.DataFrame({
        "doc_id": rows["doc_id"].to_numpy()[doc], "piece": np.concatenate([piece, wholes[order], np.zeros(len(none), np.int64)]),
        "start_word": np.concatenate([piece * capacity, wholes[order] * capacity, np.zeros(len(none), np.int64)]),
        "n_words": np.concatenate([np.full(len(at), capacity), rest[order], np.zeros(len(none), np.int64)])})
    out["bin_id"] = pd.array(np.concatenate([shard + np.arange(len(at)), shard + len(at) + bins, np.zeros(len(none), np.int64)]), dtype="Int64")
    out["bin_words"] = pd.array(np.concatenate([np.full(len(at), capacity), fill[bins] if len(order) else [], np.zeros(len(none))]).astype(np.int64), dtype="Int64")
    out.loc[np.arange(packed, len(out)), ["bin_id", "bin_words"]] = pd.NA
    return out


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None,
                   capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs whole documents into bins of `capacity` words: doc_id, piece, start_word, n_words, bin_id, bin_words.

    Documents are dealt into shards of about `shard_rows` by a hash; a bin lies within a shard. In a shard they go by
    falling size into the tightest bin that holds neither a document of their duplicate cluster (`cluster_col`, else the
    MD5 of the text) nor already `per_source` of their source. Each `capacity` words of a longer document fill a bin of
    their own, and the rest is packed as a document. Every word of every row is in exactly one bin. A document without
    words (null, empty or blank text) has one row with null bin. Null sources or clusters never conflict; null ids and
    repeated rows are ordinary rows. An empty table gives no rows. Other columns are ignored.
    """
    text = F.col(text_col)
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.md5(text)
    narrow = docs.select(F.col(id_col).alias("doc_id"), word_count(text).alias("size"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"),
                         F.xxhash64(F.col(id_col), text).alias("key"))
    shards = max(1, -(-docs.select(F.lit(1)).count() // shard_rows))
    kind = docs.schema[id_col].dataType.simpleString()
    sharded = narrow.withColumn("shard", F.pmod("key", F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(lambda rows: _pack_shard(rows, capacity, per_source), SCHEMA.format(id=kind))


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
