"""Exact tests of all pairs within candidate groups, in tiles of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_groups, written
from .shingles import FEW, TOGETHER, local_components, shingle_sets, similar, similar_pairs

TILE_MEMBERS = 1024
TILE_SHINGLES = 1_500_000


def tiled_members(members: DataFrame) -> DataFrame:
    """`members` (node, group, size) once per tile of its group that it belongs to: columns tile, block are added.

    A group's members are dealt by a hash into as many blocks as keep a block within TILE_MEMBERS members and about
    TILE_SHINGLES shingles; a tile is a pair of blocks. Most groups have one block and one tile.
    """
    sizes = members.groupBy(F.col("group").alias("big")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / TILE_MEMBERS), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    big = written(sizes.withColumn("blocks", blocks).where("blocks > 1").select("big", "blocks"), "tile-groups")
    dealt = members.join(big, F.col("group") == F.col("big"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.expr("int(pmod(xxhash64(node, 5), blocks))"))
    others = F.expr("transform(sequence(0, blocks - 1), j -> least(block, j) * blocks + greatest(block, j))")
    spread = dealt.withColumn("part", F.explode(others))
    return spread.withColumn("tile", F.xxhash64("group", "part")).drop("big", "blocks", "part")


def verified_links(texts: DataFrame, length: int, percent: int) -> DataFrame:
    """Links (a, b) that hold between the nodes of each tile, from rows (tile, block, node, text): all links of a tile of up
    to FEW nodes, and for each component of a larger tile's links a star to its first node. Sets are built from the whole
    texts, as many tiles at a time as come to TOGETHER bytes."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile", TOGETHER):
            tile, node, block = (table.column(c).to_numpy() for c in ("tile", "node", "block"))
            order = np.lexsort((node, tile))
            order = order[np.r_[True, (tile[order[1:]] != tile[order[:-1]]) | (node[order[1:]] != node[order[:-1]])]]  # equal rows of a document
            begin = np.flatnonzero(np.r_[True, tile[order[1:]] != tile[order[:-1]]])
            size = np.diff(np.r_[begin, len(order)])
            order, size = order[np.repeat(size > 1, size)], size[size > 1]
            if not len(order):
                continue
            node, block, begin = node[order], block[order], np.cumsum(size) - size
            counts, values = shingle_sets(table.column("text").take(pa.array(order)).to_pylist(), length)
            ends = np.cumsum(counts)
            apart = np.minimum.reduceat(block, begin) != np.maximum.reduceat(block, begin)  # pairs within a block are another tile's
            for i in np.flatnonzero(size > FEW):
                own = slice(begin[i], begin[i] + size[i])
                linked = similar([np.unique(values[a:b]) for a, b in zip((ends - counts)[own], ends[own], strict=True)], percent)
                if apart[i]:
                    linked &= block[own][:, None] != block[own][None, :]
                first = local_components(linked)
                far = np.flatnonzero(first != np.arange(size[i]))
                yield pa.record_batch({"a": node[own][first[far]], "b": node[own][far]})
            small = np.repeat(size <= FEW, size)
            group = np.repeat(np.arange(len(size)), size)[small]
            a, b = similar_pairs(values[np.repeat(small, counts)], counts[small], group, percent)
            node, block = node[small], block[small]
            held = ~apart[group[a]] | (block[a] != block[b])
            yield pa.record_batch({"a": node[a[held]], "b": node[b[held]]})

    dealt = texts.select("tile", "block", "node", "text").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(test, "a bigint, b bigint")
