"""Exact substring dedup: content-chosen anchors deal the suffixes of all documents to groups, which are suffix-sorted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, growing, read_table, written
from .suffix_sort import Hashed

LENGTH = 100
#: Bytes that name an anchor. Every string of LENGTH bytes has one, chosen by its own bytes only.
GRAM = 40
#: Bytes that are suffix-sorted at a time, about, where groups allow it.
GROUP_BYTES = 1 << 19
PIECE_BYTES, BATCH_BYTES = 1 << 19, 1 << 25
#: Anchors with so many different surroundings among at most SAMPLE_DOCS documents are dealt string by string. The
#: sample decides how the work is dealt, never what is found.
SAMPLE_DOCS, HOT_CONTEXTS = 50_000, 150
GROUP_ROWS, STRINGS = 16_384, 1 << 20


def texts_of(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each text; null: none."""
    out = []
    chunk = column.cast(pa.large_binary())
    offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
    data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] else np.zeros(0, np.uint8)
    for i in range(len(chunk)):
        out.append(data[offsets[i]:offsets[i + 1]] if chunk[i].is_valid else data[:0])
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    return np.minimum(values[:len(values) - (width - span)], values[width - span:]) if span < width else values


def anchored(pieces: list[tuple[int, int, np.ndarray]], length: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, count, gram, context) for each run of strings with one anchor, of pieces (document, offset, bytes).

    The anchor of a string is its run of GRAM bytes with the least hash, the leftmost of equals, so equal strings have
    equal anchors at the same place. `count` strings in a row from `start` on have the same anchor; `gram` names its
    bytes and `context` all bytes of these strings. A run whose gram is `hot` comes as `count` runs of one string.
    """
    data = np.concatenate([p[2] for p in pieces])
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    one, two = Hashed(data, 0), Hashed(data, 1)
    at = np.arange(len(data) - GRAM + 1)
    grams = one.names(at, at + GRAM)
    least = sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - GRAM + 1)
    piece = np.repeat(np.arange(len(pieces)), sizes)[:len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= ends[piece])
    anchor, piece = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64), piece[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]) if len(start) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(start)]).astype(np.int64)
    start, anchor, piece = start[new], anchor[new], piece[new]
    gram = grams[anchor]
    if len(hot):
        found = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
        times = np.where(found, count, 1)
        row = np.repeat(np.arange(len(start)), times)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        split = found[row]
        start, count, piece = start[row] + shift, np.where(split, 1, count[row]), piece[row]
        gram = np.where(split, one.names(start, start + length), gram[row])
    end = start + count - 1 + length
    document, offset = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
    return document[piece], start - (ends - sizes)[piece] + offset[piece], count, gram.view(np.int64), two.names(start, end).view(np.int64)


def pieces_of(texts: list[np.ndarray], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of pieces of about PIECE_BYTES; long texts are cut into pieces that share length - 1 bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
            piece = text[offset:offset + PIECE_BYTES + length - 1]
            if len(piece) >= length:
                held.append((i, offset, piece))
                size += len(piece)
            if size >= PIECE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def joined_up(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of each owner with those that touch or overlap made one."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    number = np.cumsum(np.r_[False, owner[1:] != owner[:-1]])
    reach = np.maximum.accumulate(end + (number << 32)) - (number << 32)
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (begin[1:] > reach[:-1])])
    return owner[new], begin[new], np.maximum.reduceat(end, new)


def runs(docs: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """(gram, context, place, start, count) of rows (place, text): of the runs with equal context that one task meets
    together, the earliest. The others are removed: as rows with the negated number of bytes, merged, for a count."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most the sample's anchors over HOT_CONTEXTS

    def some(places: np.ndarray, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = [anchored(p, length, shared.value) for p in pieces_of(texts, length)]
        if not found:
            return
        document, start, count, gram, context = (np.concatenate(x) for x in zip(*found, strict=True))
        place = places[document]
        order = np.lexsort((start, place, context, gram))
        gram, context, place, start, count = (x[order] for x in (gram, context, place, start, count))
        first = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])]
        again = ~first
        p, a, b = joined_up(place[again], start[again], (start + count - 1 + length)[again])
        columns = [np.concatenate(x) for x in ((gram[first], p * 0x5851F42D4C957F2D), (context[first], a), (place[first], p), (start[first], a), (count[first], a - b))]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["gram", "context", "place", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, at = np.unique(batch.column(0).to_numpy(), return_index=True)  # repeated rows of a document
            texts = [t for t in texts_of(batch.column(1).take(pa.array(at)))]
            ends = np.cumsum([len(t) for t in texts])
            cut = np.flatnonzero(np.diff(ends // BATCH_BYTES, prepend=0)) if len(texts) else []
            for i, j in zip([0, *cut], [*cut, len(texts)], strict=True):
                yield from some(places[i:j], texts[i:j])

    return docs.mapInArrow(run, "gram bigint, context bigint, place bigint, start bigint, count bigint")


def hot_grams(docs: DataFrame, n_docs: int, length: int) -> np.ndarray:
    """Sorted names of anchors with HOT_CONTEXTS different contexts or more among a sample of documents, dealt by hash."""
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    sample = docs.where(F.pmod(F.xxhash64("place"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = runs(sample, length, np.zeros(0, np.uint64)).where("count > 0").select("gram", "context").distinct()
    hot = found.groupBy("gram").count().where(F.col("count") >= HOT_CONTEXTS).select("gram")
    return np.sort(hot.toArrow().column("gram").to_numpy().view(np.uint64))


def compared(sorted_runs: DataFrame, length: int) -> DataFrame:
    """(gram, place, start, count) out of runs in the order of gram, context, place and start. Of equal contexts all but the
    first are removed: rows without gram whose count is in bytes. The first of each stays if its gram has others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, many, sent = None, False, False
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(5)])
            gone = rows[4] < 0
            direct, rows = rows[:, gone], rows[:, ~gone]
            if last is not None:
                rows = np.hstack([last, rows])
            gram, context, place, start, count = rows
            if rows.shape[1]:
                new_gram = np.r_[True, gram[1:] != gram[:-1]]
                first = new_gram | np.r_[True, context[1:] != context[:-1]]
                group = np.cumsum(new_gram) - 1
                several = np.bincount(group, weights=first) > 1
                several[0] |= last is not None and many
                stays = first & several[group]
                stays[0] &= last is None or not sent
                head = np.flatnonzero(first)[np.cumsum(first) - 1]
                lost = ~first & ((place != place[head]) | (start != start[head]))
                last, many = rows[:, head[-1:]], bool(several[-1])
                sent = many
            else:
                stays = lost = np.zeros(0, bool)
            p, a, b = joined_up(place[lost], start[lost], (start + count - 1 + length)[lost])
            p, a, size = np.r_[p, direct[2]], np.r_[a, direct[3]], np.r_[b - a, -direct[4]]
            names = pa.array(np.r_[gram[stays], np.zeros(len(p), np.int64)], mask=np.r_[np.zeros(int(stays.sum()), bool), np.ones(len(p), bool)])
            yield pa.record_batch([names, pa.array(np.r_[place[stays], p]), pa.array(np.r_[start[stays], a]), pa.array(np.r_[count[stays], size])],
                                  names=["gram", "place", "start", "count"])

    return sorted_runs.mapInArrow(run, "gram bigint, place bigint, start bigint, count bigint")


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, place, start, count, bytes) of the wanted runs (of, runs), with all bytes of their strings."""
    rows = docs.join(growing(wanted), F.col("place") == F.col("of"), "left")
    text, place, asked = docs.columns.index("text"), docs.columns.index("place"), len(docs.columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(asked).is_valid())
            texts, lists = texts_of(batch.column(text)), batch.column(asked)
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            start, count = (flat.field(i).to_numpy() for i in (1, 2))
            cut = [texts[i][a:b].tobytes() for i, a, b in zip(owner, start, start + count - 1 + length, strict=True)]
            yield pa.record_batch({"gram": flat.field(0), "place": batch.column(place).take(pa.array(owner)), "start": pa.array(start), "count": pa.array(count),
                                   "bytes": pa.array(cut, pa.binary())})

    return rows.select(*docs.columns, "of", "runs").mapInArrow(run, "gram bigint, place bigint, start bigint, count bigint, bytes binary")


def settled(table: pa.Table, length: int) -> pa.RecordBatch:
    """(place, start, size) of the strings that equal an earlier one, for whole groups in the order of gram, place and start.

    Suffixes are sorted from the anchor on, and backwards from it; what an anchor has in common with its neighbours in
    these orders bounds the strings around it that can have an equal. Those are sorted themselves, by their place
    relative to the anchor, which equal strings have in common.
    """
    gram, place, start, count = (table.column(i).to_numpy() for i in range(4))
    once = np.r_[True, (gram[1:] != gram[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1])]
    if not once.all():  # rows of one document that is there more than once
        return settled(table.filter(pa.array(once)), length)
    texts = [t for c in table.column(4).chunks for t in texts_of(c)]
    data, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    offset = np.cumsum(sizes) - sizes
    forward, backward = Hashed(data), Hashed(np.ascontiguousarray(data[::-1]))
    at = np.arange(len(data) - GRAM + 1)
    row = np.repeat(np.arange(len(texts)), sizes)[:len(at)]
    hits = np.flatnonzero(forward.names(at, at + GRAM).view(np.int64) == gram[row])
    known, first = np.unique(row[hits], return_index=True)  # the leftmost in each context is the anchor
    anchor = np.array(offset)
    anchor[known] = hits[first]
    group = np.cumsum(np.r_[False, gram[1:] != gram[:-1]])
    before = anchor - offset
    right = forward.longest(anchor, sizes - before, group)
    left = backward.longest(len(data) - anchor, before, group)
    most, least = np.minimum(before, left), np.maximum(before - count + 1, length - right)
    out = []
    step = max(1, STRINGS // max(1, len(texts)))
    for near in range(0, int(most.max(initial=-1)) + 1, step):
        low, high = np.maximum(least, near), np.minimum(most, near + step - 1)
        n = np.maximum(high - low + 1, 0)
        of = np.repeat(np.arange(len(texts)), n)
        back = np.repeat(low, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        segment = group[of] * (length + 1) + back
        order = np.argsort(segment, kind="stable")
        of, back = of[order], back[order]
        again = forward.repeated(anchor[of] - back, length, segment[order])
        of, back = of[again], back[again]
        out.append((place[of], start[of] + before[of] - back))
    p, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    p, a, b = joined_up(p, s, s + length)
    return pa.record_batch([pa.array(x, pa.int64()) for x in (p, a, b - a)], names=["place", "start", "count"])


def pieces(table: pa.Table) -> Iterator[pa.Table]:
    """The table in slices of whole groups with about GROUP_BYTES bytes each; a larger group is one slice."""
    gram = table.column(0).to_numpy()
    begin = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    size = pc.binary_length(table.column(4)).to_numpy().astype(np.int64)
    piece = (np.cumsum(size) - size)[begin] // GROUP_BYTES
    cuts = np.r_[begin[np.r_[True, piece[1:] != piece[:-1]]], len(gram)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield table.slice(a, b - a)


def suffix_sorted(found: DataFrame, length: int) -> DataFrame:
    """`settled` for all groups; a task holds one large group, or some small ones, at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            names = batch.column(0).to_numpy()
            held.append(batch)
            rows += len(names)
            if rows >= GROUP_ROWS and (names[0] != names[-1] or len(held) > 1 and held[-2].column(0)[-1].as_py() != names[0]):
                table = pa.Table.from_batches(held)
                all_names = table.column(0).to_numpy()
                cut = int(np.searchsorted(all_names, all_names[-1]))  # the last group may go on
                if cut:
                    yield from (settled(t, length) for t in pieces(table.slice(0, cut)))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows = len(all_names) - cut
        if rows:
            yield from (settled(t, length) for t in pieces(pa.Table.from_batches(held)))

    dealt = found.repartition("gram").sortWithinPartitions("gram", "place", "start")
    return dealt.mapInArrow(run, "place bigint, start bigint, count bigint")


def numbered(docs: DataFrame, id_col: str, text_col: str, place: str) -> DataFrame:
    """`docs` with a number per document, in the order of ids: the id itself where ids are whole numbers, there and unique;
    else rows are numbered by id (null first), then by a hash of the text, and rows equal in both are one document."""
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n, ids, distinct = docs.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
        if n == ids == distinct:
            return docs.withColumn(place, F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    names = keyed.select(F.col(id_col).alias("of_id"), F.col(key).alias("of_text")).distinct()
    ranged = names.repartitionByRange("of_id", "of_text").sortWithinPartitions("of_id", "of_text")
    names = written(ranged.withColumn("number", F.monotonically_increasing_id()), "repeat-places")
    same = keyed[id_col].eqNullSafe(names["of_id"]) & (keyed[key] == names["of_text"])
    return keyed.join(growing(names), same).select(*docs.columns, F.coalesce("number", F.lit(0)).alias(place))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(place, start, count) of rows (place, text, others): bytes covered by a string of `length` bytes that also starts
    earlier, in a document of smaller place or before in the same. Spans of a document may overlap."""
    rows = docs.select("place", "text")
    hot = hot_grams(rows, docs.count(), length)
    dealt = runs(rows, length, hot).repartition("gram").sortWithinPartitions("gram", "context", "place", "start")
    found = written(compared(dealt, length), "repeat-runs")
    wanted = found.where("gram is not null").groupBy(F.col("place").alias("of")).agg(F.collect_list(F.struct("gram", "start", "count")).alias("runs"))
    spans = suffix_sorted(contexts(docs, wanted, length), length)
    return found.where("gram is null").select("place", "start", "count").unionByName(spans)


def drop_repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with two more columns: removed, the [begin, end) byte ranges that go, ascending and apart, and kept, the bytes
    that stay (underscores are added to these names where `docs` has them already). `length` is above GRAM.

    A byte of a text, in UTF-8, goes if a string of `length` bytes that covers it also starts earlier: in a document with
    a smaller id, or before it in the same document. Strings may overlap, never cross documents, and are judged on the
    input. Null and empty texts have no bytes, texts shorter than `length` lose none. Null ids come before all others;
    texts with one id are ordered by a hash of the text, and rows equal in both are one document: each loses the same
    bytes. Very long texts are read in pieces. An empty table gives no rows.

    All strings are looked at, at no time all are shipped: a string is dealt by its anchor, equal surroundings of an
    anchor are told by 128 bits of hashes and only their first goes on; the others' strings all started there earlier.
    What is left of an anchor's group is suffix-sorted.
    """
    place, kept, removed = fresh(docs, "place"), fresh(docs, "kept"), fresh(docs, "removed")
    rows = numbered(docs, id_col, text_col, place)
    plain = rows.select(*[F.col(c).alias({place: "place", text_col: "text"}.get(c, f"own_{i}")) for i, c in enumerate(rows.columns)])
    spans = repeated_spans(plain, length).groupBy(F.col("place").alias("of")).agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    joined = plain.join(growing(spans), F.col("place") == F.col("of"), "left")
    names = plain.columns
    text, width = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            left, gone = [], []
            for t, spans in zip(texts_of(batch.column(text)), batch.column(width + 1), strict=True):
                if not spans.is_valid:
                    left.append(t.tobytes()), gone.append([])
                    continue
                flat = spans.values
                start = flat.field(0).to_numpy()
                _, a, b = joined_up(np.zeros(len(start), np.int64), start, start + flat.field(1).to_numpy())
                stays = np.ones(len(t), bool)
                for x, y in zip(a, b, strict=True):
                    stays[x:y] = False
                left.append(t[stays].tobytes())
                gone.append([{"begin": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
            yield pa.record_batch([*batch.columns[:width], pa.array(left, pa.binary()), pa.array(gone, kind)], names=[*names, "own_kept", "own_removed"])

    schema = T.StructType([*plain.schema.fields, T.StructField("own_kept", T.BinaryType()),
                           T.StructField("own_removed", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))])
    out = joined.mapInArrow(run, schema)
    back = dict(zip(rows.columns, plain.columns, strict=True))
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns], F.col("own_removed").alias(removed), F.col("own_kept").alias(kept))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_bytes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
