"""Substring dedup: paragraphs by banded MinHash and exact Jaccard, and long passages inside paragraphs by winnowing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import growing, read_table, settled, whole_groups
from .components import components
from .shingles import TOGETHER, joined_words, mixed, segment_min_hashes, together, window_hashes
from .tiles import tiled_members, verified_links

SHINGLE_WORDS, PERCENT = 5, 80
BAND_ROWS, RECALL = 3, 0.999
#: A passage is a run of so many words.
LEAST_WORDS = 32
#: Every run of at least so many words that two documents share holds a passage that both select.
SURE_WORDS = 50
#: By so many words a passage is made longer on a side.
REACH = SURE_WORDS - LEAST_WORDS
#: The surroundings of a passage with more places are compared by joins, those of others within a task.
CROWD = 1 << 14
UNIT = "array<struct<start: int, words: int, key: bigint, size: int, bands: array<bigint>>>"


def tuned_bands(percent: int = PERCENT, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """The fewest bands of `rows` values that let a pair of that similarity collide with at least that chance."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows)))


def _least(found: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash (the last of equals) of every run of `width`, by runs of double length."""
    least, at, size = found, np.arange(len(found)), 1
    while size < width:
        step = min(size, width - size)
        later = least[step:] <= least[:-step]
        least, at = np.minimum(least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        size += step
    return at


def _selected(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the least hashes (the last of equals) of all runs of REACH + 1 in the texts whose passages are `found` one
    text after the other, `sizes` of them each; equal runs select equal passages. A shorter text is one run."""
    width, ends = REACH + 1, np.cumsum(sizes)
    begin = ends - sizes
    few = np.flatnonzero((sizes > 0) & (sizes <= width))
    picked = [ends[i:i + 1] - 1 - int(np.argmin(found[begin[i]:ends[i]][::-1])) for i in few]
    if len(found) > width:
        text = np.repeat(np.arange(len(sizes)), sizes)
        at = _least(found, width)[text[width - 1:] == text[:len(text) - width + 1]]
        picked.append(at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at)
    return np.unique(np.concatenate([np.zeros(0, np.int64), *picked]))


def _paragraphs(data: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Word ranges [a, b): each line of SHINGLE_WORDS words or more, and each run of two or more lines between blank lines."""
    bounds = np.r_[0, np.searchsorted(begin, np.flatnonzero(data == 10)), len(begin)]
    lines = np.stack([bounds[:-1], bounds[1:]], axis=1)
    filled = lines[:, 1] > lines[:, 0]
    edges = np.flatnonzero(np.diff(np.r_[False, filled, False].astype(np.int8)))
    first, last = edges[::2], edges[1::2] - 1
    blocks = np.stack([lines[first, 0], lines[last, 1]], axis=1)[last > first]
    return [x[x[:, 1] - x[:, 0] >= SHINGLE_WORDS] for x in (lines, blocks)]


def _min_hashes(found: np.ndarray, lines: np.ndarray, blocks: np.ndarray, n: int) -> list[np.ndarray]:
    """Rows of `n` MinHash values of the lines and of the blocks. Shingles are hashed once: a block is made of its lines
    and of what lies between them."""
    ends = [np.stack([r[:, 0], r[:, 1] - SHINGLE_WORDS + 1]) for r in (lines, blocks)]
    cuts = np.unique(np.concatenate(ends, axis=1))
    if not len(cuts):
        return [np.zeros((0, n), np.uint32)] * 2
    opened = np.zeros(len(cuts), np.int64)
    for x in ends:
        np.add.at(opened, np.searchsorted(cuts, x[0]), 1)
        np.add.at(opened, np.searchsorted(cuts, x[1]), -1)
    held = np.flatnonzero(np.cumsum(opened) > 0)
    least = np.full((len(cuts), n), 0xFFFFFFFF, np.uint32)
    least[held] = segment_min_hashes(found, cuts[held], cuts[held + 1], n)
    return [np.minimum.reduceat(least, np.searchsorted(cuts, x).T.ravel(), axis=0)[::2] if x.size else least[:0] for x in ends]


def _seen_before(values: np.ndarray) -> np.ndarray:
    """For each value the last place before it with the same value, or -1."""
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    some = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    some = some[np.lexsort((some, values[some]))]
    before = np.full(len(values), -1)
    again = values[some[1:]] == values[some[:-1]]
    before[some[1:][again]] = some[:-1][again]
    return before


def _set_keys(mix: np.ndarray, before: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash, the size) of the set of shingles of each of the disjoint ranges of words, from the mixed shingles and
    `_seen_before` of them."""
    size = ranges[:, 1] - ranges[:, 0] - SHINGLE_WORDS + 1
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(ranges[:, 0] - begin, size)
    once = before[at] < np.repeat(ranges[:, 0], size)
    total = np.add.reduceat(np.where(once, mix[at], np.uint64(0)), begin)
    count = np.add.reduceat(once.astype(np.int64), begin)
    return mixed(total + count.astype(np.uint64)).view(np.int64), count


def _units(texts: list[str | None], bands: int) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of lines and blocks; these as arrays (start, words, key, size, bands), text by text; of each
    text the number of selected passages; their starts and keys. Blank lines between the texts keep them apart."""
    data, begin, _, hashes, bounds = joined_words(texts)
    first = bounds[:-1]
    found = window_hashes(hashes, SHINGLE_WORDS)
    both = _paragraphs(np.frombuffer(data, np.uint8), begin)
    before, mix = _seen_before(found), mixed(found ^ np.uint64(0x9E3779B97F4A7C15))
    name = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    kinds = [(np.zeros(0, np.int64),) * 5 + (np.zeros((0, bands), np.int64),)]
    for ranges, least in zip(both, _min_hashes(found, *both, bands * BAND_ROWS), strict=True):
        if len(ranges):
            values = least.astype(np.uint64).reshape(len(ranges), bands, BAND_ROWS)
            named = np.tile(name, (len(ranges), 1))
            for i in range(BAND_ROWS):
                named = (named ^ values[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
                named ^= named >> np.uint64(32)
            text = np.searchsorted(first, ranges[:, 0], side="right") - 1
            kinds.append((text, ranges[:, 0] - first[text], ranges[:, 1] - ranges[:, 0], *_set_keys(mix, before, ranges), named.view(np.int64)))
    text, *rows = (np.concatenate(x) for x in zip(*kinds, strict=True))
    order = np.argsort(text, kind="stable")
    many = np.maximum(np.diff(np.r_[first, len(begin)]) - LEAST_WORDS + 1, 0)  # passages of each text
    owner = np.repeat(np.arange(len(texts)), many)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    passages = window_hashes(hashes, LEAST_WORDS)[first[owner] + start] if len(owner) else hashes[:0]
    picked = _selected(passages, many)
    return (np.bincount(text, minlength=len(texts)), tuple(x[order] for x in rows), np.bincount(owner[picked], minlength=len(texts)), start[picked],
            passages[picked].view(np.int64))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values)


def units(docs: DataFrame, bands: int) -> DataFrame:
    """(doc_id, text_key, paragraphs, starts, keys) of rows (doc_id, text). Of equal paragraphs of a batch one has its bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["start", "words", "key", "size", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = at["text"].to_pylist()
            found = [_units(texts[i:j], bands) for i, j in together(texts)]
            if not found:
                continue
            counts, n_passages, starts, keys = (np.concatenate([f[i] for f in found]) for i in (0, 2, 3, 4))
            columns = [np.concatenate([f[1][i] for f in found]).astype(k) for i, k in enumerate((np.int32, np.int32, np.int64, np.int32, np.int64))]
            new = np.zeros(len(columns[2]), bool)
            new[np.unique(columns[2], return_index=True)[1]] = True
            banded = _lists(np.where(new, bands, 0), pa.array(columns[4][new].ravel()))
            flat = pa.StructArray.from_arrays([*map(pa.array, columns[:4]), banded], names=names)
            yield pa.record_batch({"doc_id": at["doc_id"], "text_key": at["text_key"], "paragraphs": _lists(counts, flat),
                                   "starts": _lists(n_passages, pa.array(starts.astype(np.int32))), "keys": _lists(n_passages, pa.array(keys))})

    rows = docs.withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, paragraphs {UNIT}, starts array<int>, keys array<bigint>")


def _pieces(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where the lists of structs end, from 0, and their fields one list after the other."""
    ends, values = lists.offsets.to_numpy(), lists.flatten()
    return ends - ends[0], {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}


def paragraph_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tile, block, node, text) of the wanted paragraphs (want_id, want_text, start, words, tile, block, node). A
    document is shipped once for all its paragraphs."""
    pieces = F.struct("start", "words", "node", "tile", "block")
    asked = settled(wanted.groupBy("want_id", "want_text").agg(F.collect_set(pieces).alias("pieces")), "passage-wanted")
    rows = docs.join(growing(asked), F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.xxhash64("text") == F.col("want_text"))).select("text", "pieces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ends, fields = batch.column(0).to_pylist(), *_pieces(batch.column(1))
            for i, j in together(texts):
                data, begin, end, _, bounds = joined_words(texts[i:j])
                own = {n: f[ends[i]:ends[j]] for n, f in fields.items()}
                at = own["start"] + np.repeat(bounds[:-1], np.diff(ends[i:j + 1]))
                pieces = [data[a:b] for a, b in zip(begin[at].tolist(), end[at + own["words"] - 1].tolist(), strict=True)]
                yield pa.record_batch({**{n: pa.array(own[n]) for n in ("tile", "block", "node")}, "text": pa.array(pieces, pa.string())})

    return rows.mapInArrow(cut, "tile bigint, block int, node bigint, text string")


def paragraph_classes(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(key, class) of distinct paragraphs linked to others: those that share a band are joined up, all pairs of such a
    group are tested by exact Jaccard on whole paragraphs, and classes are the components of the links."""
    places = paragraphs.select("key", F.explode("bands").alias("band"))
    shared = places.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("last")).where("hub <> last").drop("last")
    edges = places.join(growing(settled(shared, "passage-bands")), "band").select(F.col("hub").alias("a"), F.col("key").alias("b"))
    groups = components(edges)
    # a paragraph with bands stands for its copies
    held = paragraphs.where(F.size("bands") > 0).select("doc_id", "text_key", "start", "words", "key", "size").join(growing(groups), F.col("node") == F.col("key"))
    members = held.groupBy("node").agg(F.first("component").alias("group"), F.first("size").cast("long").alias("size"),
                                       F.min(F.struct("doc_id", "text_key", "start", "words")).alias("named"))
    wanted = tiled_members(settled(members, "passage-members")).select("tile", "block", "node", F.col("named.doc_id").alias("want_id"), F.col("named.text_key").alias("want_text"),
                                           F.col("named.start").alias("start"), F.col("named.words").alias("words"))
    links = settled(verified_links(paragraph_texts(docs, wanted), SHINGLE_WORDS, PERCENT), "passage-links")
    return components(links).select(F.col("node").alias("linked"), F.col("component").alias("class"))


def _beside(hashes: np.ndarray, start: np.ndarray, first: np.ndarray, end: np.ndarray, asked: np.ndarray, right: bool) -> pa.Array:
    """The words beside each passage, from it outward, REACH of them or to the end of its text, as 8 bytes each; none if
    not asked. `first` and `end` are the bounds of the texts."""
    step = np.arange(1, REACH + 1)
    at = start[:, None] + (LEAST_WORDS - 1 + step if right else -step)
    inside = (at < end[:, None] if right else at >= first[:, None]) & asked[:, None]
    bounds = np.r_[0, np.cumsum(inside.sum(axis=1)) * 8].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(hashes[at[inside]].tobytes())])


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, crowded, doc_id, text_key, start, left, right) of the asked passages (want_id, want_text, pieces): the words
    beside a passage on each side that is asked for, from it outward, as 8 bytes each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    same = F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.xxhash64("text") == F.col("want_text"))
    rows = docs.join(growing(asked), same).select("doc_id", F.col("want_text").alias("text_key"), "text", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ends, fields = batch.column(2).to_pylist(), *_pieces(batch.column(3))
            for i, j in together(texts):
                *_, hashes, bounds = joined_words(texts[i:j])
                row = np.repeat(np.arange(i, j), np.diff(ends[i:j + 1]))
                for k in range(0, len(row), 1 << 15):
                    some = row[k:k + (1 << 15)]
                    own = {n: f[ends[i] + k:ends[i] + k + len(some)] for n, f in fields.items()}
                    first, end = bounds[some - i], bounds[some - i + 1]
                    sides = {side: _beside(hashes, first + own["start"], first, end, own[side], side == "right") for side in ("left", "right")}
                    one = pa.array(some)
                    yield pa.record_batch({"key": pa.array(own["key"]), "crowded": pa.array(own["crowded"]), "doc_id": batch.column(0).take(one),
                                           "text_key": batch.column(1).take(one), "start": pa.array(own["start"]), **sides})
    return rows.mapInArrow(run, f"key bigint, crowded boolean, doc_id {kind}, text_key bigint, start int, left binary, right binary")


def _shared_lengths(key: np.ndarray, doc: np.ndarray, beside: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of places in their order within each key: with how many words beside them a place of another document goes on, and
    with how many one does and an earlier place too."""
    bounds = np.frombuffer(beside.buffers()[1], np.int32)[beside.offset:beside.offset + len(beside) + 1] // 8
    data = beside.buffers()[2]
    value, size = np.frombuffer(data, np.uint64) if data is not None else np.zeros(0, np.uint64), np.diff(bounds)
    most, later = np.zeros(len(key), np.int32), np.zeros(len(key), np.int32)
    name, rows = mixed(key.view(np.uint64)), np.arange(len(key))
    for off in range(1, REACH + 1):
        on = size[rows] >= off
        rows, name = rows[on], name[on]
        name = mixed(name * np.uint64(0xD6E8FEB86659FD93) + value[bounds[rows] + off - 1])
        order = np.argsort(name, kind="stable")
        begin = np.flatnonzero(np.r_[True, name[order[1:]] != name[order[:-1]]]) if len(order) else order
        n = np.diff(np.r_[begin, len(order)])
        lead, last = rows[order[begin]], rows[order[begin + n - 1]]
        several = doc[lead] != doc[last]
        kept = np.sort(order[np.repeat(several, n)])
        rows, name = rows[kept], name[kept]
        if not len(rows):
            break
        most[rows] = off
        before = later[lead[several]]
        later[rows] = off
        later[lead[several]] = before
    return most, later


def _ends_in_tasks(found: DataFrame) -> DataFrame:
    """`_ends_by_joins` for passages with few places: all places of a passage are compared within a task."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 1 << 22):
            key, doc, start = (table.column(c).to_numpy() for c in ("key", "doc", "start"))
            new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]  # equal rows of a document
            if not new.all():
                table, key, doc = table.filter(pa.array(new)), key[new], doc[new]
            lengths = {}
            for side in ("left", "right"):
                lengths[f"{side}_any"], lengths[f"{side}_later"] = (pa.array(x) for x in _shared_lengths(key, doc, table.column(side).combine_chunks()))
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("doc_id", "text_key", "start")), *lengths.values()],
                                             names=["at_id", "at_text", "at_start", *lengths])

    dealt = found.select("key", F.xxhash64("doc_id", "text_key").alias("doc"), "doc_id", "text_key", "start", "left", "right")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "doc_id", "text_key", "start")
    return dealt.mapInArrow(run, f"at_id {kind}, at_text bigint, at_start int, left_any int, left_later int, right_any int, right_later int").where(
        "left_any > 0 or right_any > 0")


def _ends_by_joins(found: DataFrame) -> DataFrame:
    """(at_id, at_text, at_start, left_any, left_later, right_any, right_later) of the places of `contexts`: how many words
    beside them another document has too, and as many of which an earlier place is not the place itself.

    Places with the same words beside them are one row before the beginnings of these words are compared, and words that
    no other document begins with are not compared further.
    """
    sided = found.select("key", "doc_id", "text_key", "start", F.explode(F.create_map(*[x for side in ("left", "right") for x in (F.lit(side), F.col(side))])).alias("side", "context"))
    found = sided.where(F.octet_length("context") > 0).select(
        "key", "side", F.xxhash64("key", "side", "context").alias("whole"), F.xxhash64("key", "side", F.substring("context", 1, 8)).alias("near"),
        "context", "doc_id", "text_key", "start")
    place, doc = F.struct("doc_id", "text_key", "start"), F.struct("doc_id", "text_key")
    several = "not (earliest.doc_id <=> last.doc_id and earliest.text_key = last.text_key)"
    distinct = found.groupBy("whole").agg(F.min(place).alias("earliest"), F.max(doc).alias("last"), *[F.first(c).alias(c) for c in ("key", "side", "near", "context")])
    distinct = settled(distinct, "passage-sides")
    begun = distinct.groupBy("near").agg(F.min("earliest").alias("earliest"), F.max("last").alias("last")).where(several).select("near")
    held = settled(distinct.join(growing(settled(begun, "passage-begun")), "near").drop("near"), "passage-held")
    grown = held.select("whole", "earliest", "last", "key", "side", "context", F.explode(F.expr("sequence(1, int(octet_length(context) div 8))")).alias("off"))
    grown = grown.select("whole", "earliest", "last", "off", F.xxhash64("key", "side", F.expr("substring(context, 1, 8 * off)")).alias("longer"))
    shared = grown.groupBy("longer").agg(F.min("earliest").alias("earliest"), F.max("last").alias("last")).where(several)
    shared = settled(shared.select(F.col("longer").alias("of"), F.col("earliest").alias("first")), "passage-longer")
    # of the places of one whole context all but the earliest are later in any case
    reach = grown.join(growing(shared), F.col("longer") == F.col("of")).groupBy("whole").agg(
        F.max("off").alias("any"), F.coalesce(F.max(F.when(~F.col("earliest").eqNullSafe(F.col("first")), F.col("off"))), F.lit(0)).alias("later"),
        F.first("earliest").alias("earliest"))
    reach = settled(reach.withColumnRenamed("whole", "of"), "passage-reach")
    ends = found.select("whole", "side", "doc_id", "text_key", "start").join(growing(reach), F.col("whole") == F.col("of"))
    later = F.when(place.eqNullSafe(F.col("earliest")), F.col("later")).otherwise(F.col("any"))
    return ends.groupBy(F.col("doc_id").alias("at_id"), F.col("text_key").alias("at_text"), F.col("start").alias("at_start")).agg(
        *[F.max(F.when(F.col("side") == side, c)).alias(f"{side}_{name}") for side in ("left", "right") for name, c in (("any", F.col("any")), ("later", later))])


def extended(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """`anchors` (doc_id, text_key, start, key, original, n: places of the key) with two more columns, left and right: by how
    many words, up to REACH, the passage can be made longer so that another document has it too and, if it is not an
    original, an earlier place has it. A side that other passages of the document cover is left as it is."""
    placed = Window.partitionBy("doc_id", "text_key", "original").orderBy("start")
    covered = {"left": placed.rangeBetween(-LEAST_WORDS, -REACH), "right": placed.rangeBetween(REACH, LEAST_WORDS)}
    bare = anchors.select("key", *[(F.count(F.lit(1)).over(w) == 0).alias(side) for side, w in covered.items()])
    # all places of a passage are needed if one of them is to be made longer
    needed = settled(bare.groupBy("key").agg(F.max("left").alias("left"), F.max("right").alias("right")).where("left or right"), "passage-ends")
    crowded = (F.col("n") > CROWD).alias("crowded")
    pieces = anchors.join(growing(needed), "key").groupBy(F.col("doc_id").alias("want_id"), F.col("text_key").alias("want_text")).agg(
        F.collect_set(F.struct("start", "key", "left", "right", crowded)).alias("pieces"))
    found = contexts(docs, settled(pieces, "passage-pieces"))
    if anchors.where(crowded).isEmpty():
        most = _ends_in_tasks(found)
    else:
        found = settled(found, "passage-contexts")
        most = _ends_in_tasks(found.where("not crowded")).unionByName(_ends_by_joins(found.where("crowded")))
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_text")) & (F.col("start") == F.col("at_start"))
    joined = anchors.join(growing(settled(most, "passage-most")), same, "left")
    return joined.select(*anchors.columns, *[F.coalesce(F.when(F.col("original"), F.col(f"{side}_any")).otherwise(F.col(f"{side}_later")), F.lit(0)).alias(side)
                                             for side in ("left", "right")])


def shared_spans(spans: DataFrame) -> DataFrame:
    """`spans` (doc_id, text_key, start, words, class_id) of the classes that lie in two documents or more, with the
    place of the first of each class: first_id, first_text, first_start, first_end; and n, the number of its spans."""
    spread = spans.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_key", "start", (-F.col("words")).alias("less"))).alias("first"),
                                           F.max(F.struct("doc_id", "text_key")).alias("last"), F.count(F.lit(1)).alias("n"))
    several = spread.where("n > 1").where("not (first.doc_id <=> last.doc_id and first.text_key = last.text_key)")
    several = several.select(F.col("class_id").alias("of"), F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_text"),
                             F.col("first.start").alias("first_start"), F.expr("first.start - first.less").alias("first_end"), "n")
    return spans.join(growing(settled(several, "passage-classes")), F.col("class_id") == F.col("of")).drop("of")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of whole documents that repeat across documents: doc_id, kind, start_word, n_words, class_id, first_id, removed.

    `paragraph`: a line, or all lines between two blank ones, of at least SHINGLE_WORDS words whose set of five-word
    shingles (A-Z lower-cased) has a Jaccard similarity of 0.8 or more with a paragraph of another document, directly or
    through others; one that overlaps the first of its class is not removed. `passage`: LEAST_WORDS words
    in a row, anywhere in the text, that another document has too; every shared run of at least SURE_WORDS words holds
    one. Every place of a passage has a row, made longer on both sides as far as its words go on being shared, so the
    removed spans of a document together cover all but the first copy of every shared run of SURE_WORDS words. Spans of
    different classes may overlap.

    class_id names the class, first_id is the id of its first document, and `removed` is true for all spans but
    the first one by id (nulls first), text and place. A class lies in at least two documents; repeats within one
    don't make one, and rows of equal id and text are one document. Null, empty and short texts give no rows, null ids
    are ordinary, an empty table gives no rows, and other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = settled(units(rows, tuned_bands()), "passage-units")
    paragraphs = found.select("doc_id", "text_key", F.explode("paragraphs").alias("p")).select("doc_id", "text_key", "p.*")
    classes = paragraph_classes(rows, paragraphs)
    lines = paragraphs.select("doc_id", "text_key", "start", "words", "key").join(classes, F.col("key") == F.col("linked"), "left")
    lines = shared_spans(lines.select("doc_id", "text_key", "start", "words", F.coalesce("class", "key").alias("class_id")))
    in_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_text"))
    lines = lines.select("doc_id", F.lit("paragraph").alias("kind"), F.col("start").alias("start_word"), F.col("words").alias("n_words"), "class_id", "first_id",
                         (~(in_first & (F.col("start") < F.col("first_end")))).alias("removed"))
    runs = found.select("doc_id", "text_key", F.explode(F.arrays_zip("starts", "keys")).alias("p")).select(
        "doc_id", "text_key", F.col("p.starts").alias("start"), F.lit(LEAST_WORDS).alias("words"), F.col("p.keys").alias("class_id"))
    original = in_first & (F.col("start") == F.col("first_start"))
    anchors = settled(shared_spans(runs).withColumn("key", F.col("class_id")).withColumn("original", original), "passage-anchors")
    # a later place in the first document begins where the first one ends
    begin = F.when(in_first & ~F.col("original"), F.greatest(F.col("start") - F.col("left"), F.col("first_end"))).otherwise(F.col("start") - F.col("left"))
    ended = extended(rows, anchors).withColumn("begin", begin).withColumn("end", F.col("start") + LEAST_WORDS + F.col("right")).where("begin < end")
    return lines.unionByName(ended.select("doc_id", F.lit("passage").alias("kind"), F.col("begin").alias("start_word"), (F.col("end") - F.col("begin")).alias("n_words"),
                                          "class_id", "first_id", (~F.col("original")).alias("removed")))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))
