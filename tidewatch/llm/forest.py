"""Near-duplicate documents by an LSH forest over MinHash signatures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, grouped_batches, growing, read_table, written
from .components import components
from .shingles import local_components, min_hashes, shingle_set
from .tiles import tiled_members, verified_links

TREES, STEP = 20, 6
HASHES = TREES * STEP
MISS = 5e-5
REGION_ROWS = 2048
SHINGLE_WORDS, PERCENT = 5, 80


def least_depth(percent: int, trees: int = TREES, miss: float = MISS) -> int:
    """The greatest depth at which a pair of that similarity shares no prefix in any tree with a chance of at most `miss`."""
    return max((d for d in range(1, STEP + 1) if (1 - (percent / 100) ** d) ** trees <= miss), default=1)


def least_matches(percent: int) -> int:
    """MinHash values that a pair of that similarity shares, less 4.5 standard deviations."""
    p = percent / 100
    return max(1, math.floor(HASHES * p - 4.5 * math.sqrt(HASHES * p * (1 - p))))


def sketch(docs: DataFrame, length: int, depth: int) -> DataFrame:
    """(doc_id, text_key, n, key, prefixes, signature) of rows (doc_id, text): set size, 64-bit name of the set, the
    name of each tree's prefix of `depth` values, and a byte of each MinHash value. Key and the rest are null for
    an empty set."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sizes, keys, prefixes, signatures = [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                found = shingle_set(text, length)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None), prefixes.append(None), signatures.append(None)
                    continue
                keys.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True))
                values = min_hashes(found, HASHES)
                name = salt.copy()
                for i in range(depth):
                    name = (name ^ values[i::STEP].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                    name ^= name >> np.uint64(32)
                prefixes.append(name.view(np.int64))
                signatures.append(values.astype(np.uint8).tobytes())
            yield pa.record_batch({
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")), "text_key": batch.column(batch.schema.get_field_index("text_key")),
                "n": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.int64()), "prefixes": pa.array(prefixes, pa.list_(pa.int64())),
                "signature": pa.array(signatures, pa.binary())})

    rows = docs.withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, text_key bigint, n bigint, key bigint, prefixes array<bigint>, signature binary")


def candidate_edges(nodes: DataFrame, depth: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect all nodes which may be similar, from `nodes` (key, n, prefixes, signature).

    In each tree's sorted order, neighbours whose common prefix has at least the region's depth are candidates. The
    depth of a region starts at `depth`, and grows with the number of nodes that share that prefix until a region has
    about REGION_ROWS; then the regions under one prefix are tied together, so that no candidate is lost. In a region,
    nodes whose signatures agree enough are joined, by one edge for each node.
    """
    places = nodes.select("key", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = places.groupBy("prefix").agg(F.count(F.lit(1)).alias("sharing"), F.min("key").alias("hub")).where("sharing > 1")
    hits = places.join(growing(written(shared, "forest-prefixes")), "prefix").join(growing(nodes.select("key", "n", "signature")), "key")
    deeper = F.when(F.col("sharing") > REGION_ROWS, F.ceil(F.log(F.col("sharing") / REGION_ROWS) / math.log(1 / 0.7))).otherwise(0).cast("int")
    at = F.col("tree") * STEP
    label = F.concat(F.expr(f"substring(signature, tree * {STEP} + 1)"), F.substring("signature", F.lit(1), at))
    rows = hits.withColumn("label", label).withColumn("hot", F.col("sharing") > REGION_ROWS)
    region = F.xxhash64("prefix", F.when(F.col("hot"), F.substring("label", F.lit(1), F.lit(depth) + deeper)).otherwise(F.lit(b"")))
    rows = rows.select(region.alias("region"), "label", "key", "n", "signature", "hub", "hot")
    need = least_matches(percent)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, "region"):
            key, n, hub, hot = (table.column(c).to_numpy() for c in ("key", "n", "hub", "hot"))
            values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(key), HASHES)
            a, b = [], []
            for i in range(0, len(key), REGION_ROWS):
                some = slice(i, i + REGION_ROWS)
                v, size = values[some], n[some]
                close = np.zeros((len(v), len(v)), bool)
                for j in range(0, len(v), 64):
                    close[j:j + 64] = (v[j:j + 64, None, :] == v[None, :, :]).sum(axis=2, dtype=np.uint8) >= need
                close &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
                first = local_components(close)
                own = np.arange(len(first))
                joined = first != own
                a.append(key[some][first[joined]])
                b.append(key[some][own[joined]])
                heads = own[~joined & hot[some]]
                a.append(hub[some][heads])
                b.append(key[some][heads])
            yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})

    dealt = rows.repartition("region").sortWithinPartitions("region", "label")
    return dealt.mapInArrow(join_up, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate classes of whole texts: doc_id, text_key, n_shingles, component_id for every row.

    A text's set holds its distinct shingles of `length` words (A-Z lower-cased); with fewer words the whole sequence is
    the one shingle, a null text or one without words has the empty set and is linked with nothing. Texts are linked where
    100 * intersection >= `percent` * union; component_id is the smallest id reachable. Rows of equal sets are one node,
    so copies are never paired. All pairs of a candidate group are tested on full sets. Null ids are ignored as names: a
    class in which all ids are null has a null component_id. Sets are named and compared by 64-bit hashes. Repeated rows
    are rows of their own, empty tables give no rows, and other columns are ignored.
    """
    return near_classes(docs, id_col=id_col, text_col=text_col, length=length, percent=percent).drop("class_key")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """`near_groups` with one more column, class_key: the name of the class whatever its ids; null for an empty set."""
    depth = least_depth(percent)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(sketch(rows, length, depth), "forest-sketches")
    nodes = sketches.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key")).alias("named"),
        F.first(F.struct("n", "prefixes", "signature")).alias("s"))
    nodes = written(nodes.select("key", "id", "copies", "named", "s.*"), "forest-nodes")
    groups = components(candidate_edges(nodes, depth, percent))
    members = groups.join(nodes.select(F.col("key").alias("node"), F.col("n").alias("size"), "named"), "node").select(
        "node", F.col("component").alias("group"), "size", "named")
    tiles = tiled_members(members)
    wanted = written(tiles.select("tile", "block", "node", F.col("named.doc_id").alias("want_id"), F.col("named.text_key").alias("want_text")), "forest-tiles")
    texts = rows.join(growing(wanted), F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.xxhash64("text") == F.col("want_text")))
    classes = components(verified_links(texts, length, percent))
    named = classes.join(nodes.select(F.col("key").alias("node"), "id"), "node")
    smallest = named.groupBy(F.col("component").alias("c")).agg(F.min("id").alias("least_id"))
    ids = named.join(smallest, F.col("component") == F.col("c")).select(F.col("node").alias("key"), "least_id", F.col("component").alias("root"))
    known = nodes.join(ids, "key", "left").where("copies > 1 or root is not null").select(
        F.col("key").alias("known_key"), F.coalesce("least_id", "id").alias("least_id"), "root")
    known = written(known, "forest-classes")
    at = F.coalesce("key", F.xxhash64("doc_id", "text_key"))  # rows without a set must not meet in one place
    found = sketches.withColumn("at", at).join(growing(known), (F.col("at") == F.col("known_key")) & (F.col("n") > 0), "left")
    return found.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("least_id", "doc_id").alias("component_id"),
                        F.coalesce("root", "key").alias("class_key"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each near-duplicate class, the one with the smallest id (nulls last, then by a hash of
    the text); of repeated rows of that document one stays. Classes are told by their texts, so unlike texts with one id
    both stay and near copies without ids leave one. Rows with an empty set all stay. Columns are unchanged."""
    found = written(near_classes(docs, id_col=id_col, text_col=text_col, length=length, percent=percent).where("n_shingles > 0"), "forest-found")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("text_key"))
    first = found.groupBy("class_key").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = written(first.select(F.col("class_key").alias("class"), "first"), "forest-first")
    lost = found.join(first, F.col("class_key") == F.col("class")).where(~rank.eqNullSafe(F.col("first"))).select(
        F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_text")).distinct()
    lost = written(lost, "forest-lost")
    repeated = found.groupBy("doc_id", "text_key").count().where("count > 1").select(F.col("doc_id").alias("twice_id"), F.col("text_key").alias("twice_text"))
    repeated = written(repeated, "forest-repeated")
    key = fresh(docs, "near_key")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    left = keyed.join(growing(lost), keyed[id_col].eqNullSafe(lost["lost_id"]) & (keyed[key] == lost["lost_text"]), "left_anti")
    same = left[id_col].eqNullSafe(repeated["twice_id"]) & (left[key] == repeated["twice_text"])
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(repeated, same, "left_anti").select(*docs.columns)
    return once.unionByName(left.join(repeated, same, "left_semi").dropDuplicates([id_col, key]).select(*docs.columns))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(read_table(spark, sf_dir, "documents"), length=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
