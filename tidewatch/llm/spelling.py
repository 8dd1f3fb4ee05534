"""Spelling variants: words one edit apart, by range searches in k-d trees over letter-count vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import growing, lower_ascii, read_table, written

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
DELETED_OF = 31
#: Letters are a-z and U+00C0 to U+00FF; every code point of a word has a place of its own in its count vector.
PLACE = np.zeros(256, np.int64)
PLACE[ord("a"):ord("z") + 1] = np.arange(26)
PLACE[0xC0:] = 26 + np.arange(64)
LETTERS = 90
#: Words at home in a region, about; fewer where they are long, for their bytes.
REGION_WORDS, REGION_BYTES = 32768, 1 << 26
#: At most so many words, dealt by hash, decide where regions begin and end; all words are searched.
SAMPLE_WORDS = 200_000
LEAF = 96
LEVELS = 3
BATCH = 16384


@dataclass
class Node:
    """Words `at` with all counts between `low` and `high`; an inner node splits them at `count` of `letter`."""
    low: np.ndarray
    high: np.ndarray
    at: np.ndarray | None = None
    letter: int = -1
    count: int = 0
    below: Node | None = None
    above: Node | None = None
    name: int = -1


def grow(counts: np.ndarray, at: np.ndarray, leaf: int) -> Node:
    """A tree over the rows `at`, split at the median of the letter that varies most; equal vectors stay together."""
    own = counts[at]
    node = Node(own.min(axis=0), own.max(axis=0))
    if len(at) > leaf:
        for letter in np.argsort(-own.var(axis=0, dtype=np.float32), kind="stable")[:4]:
            values = own[:, letter]
            if node.low[letter] == node.high[letter]:
                break
            count = min(int(np.median(values)), int(node.high[letter]) - 1)
            left = values <= count
            if left.any() and not left.all():
                node.letter, node.count = int(letter), count
                node.below, node.above = grow(counts, at[left], leaf), grow(counts, at[~left], leaf)
                return node
    node.at = at
    return node


def leaves(node: Node) -> list[Node]:
    return [node] if node.at is not None else leaves(node.below) + leaves(node.above)


def cells(node: Node, low: np.ndarray, high: np.ndarray) -> None:
    """Widens the boxes of a sample's tree to the cells that its splits cut out of the whole space."""
    node.low, node.high = low, high
    if node.at is None:
        for child, side in ((node.below, high), (node.above, low)):
            own = side.copy()
            own[node.letter] = node.count + (child is node.above)
            cells(child, *((low, own) if child is node.below else (own, high)))


def reached(node: Node, counts: np.ndarray, at: np.ndarray, away: np.ndarray, reach: int) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, words) for every leaf whose box is within an L1 distance of `reach`, from `counts` (letter, word); `away` is
    the distance of the words `at` from the node's box."""
    if not len(at):
        return
    if node.at is not None:
        yield node, at
        return
    for child in (node.below, node.above):
        # only the letters whose bounds differ from the parent's change the distance
        moved = np.flatnonzero((child.low != node.low) | (child.high != node.high))
        some = counts[np.ix_(moved, at)]
        further = away + _gap(child, some, moved) - _gap(node, some, moved)
        near = further <= reach
        yield from reached(child, counts, at[near], further[near], reach)


def _gap(box: Node, some: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """How far the counts of those letters are from the box."""
    low, high = (x[letters, None].astype(some.dtype) for x in (box.low, box.high))
    return np.abs(some - np.clip(some, low, high)).sum(axis=0, dtype=some.dtype)


def from_root(node: Node, counts: np.ndarray, reach: int) -> Iterator[tuple[Node, np.ndarray]]:
    """`reached` for all words of `counts` (word, letter)."""
    turned = np.ascontiguousarray(counts.T)
    away = _gap(node, turned, np.arange(LETTERS))
    at = np.flatnonzero(away <= reach)
    return reached(node, turned, at, away[at], reach)


def letter_matrix(words: Iterable[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points, all below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def letter_counts(matrix: np.ndarray) -> np.ndarray:
    out = np.zeros(len(matrix) * LETTERS, np.int32)
    flat = PLACE[matrix] + np.arange(len(matrix))[:, None] * LETTERS
    out += np.bincount(flat.ravel(), minlength=len(out)).astype(np.int32)
    return out.reshape(-1, LETTERS)


def levels(counts: np.ndarray) -> np.ndarray:
    """0 or 1 for each letter and level: whether the word has the letter so often. Counts above LEVELS count as LEVELS,
    so distances over these are never above those of the counts."""
    return (counts[:, :, None] > np.arange(LEVELS)).reshape(len(counts), -1)


def one_edit(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one replaced code point, or by one that `long` has more."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (long != short).sum(axis=1) == 1
    ahead, behind = long[:, :n] != short, long[:, 1:] != short
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), n)
    last = np.where(behind.any(axis=1), n - behind[:, ::-1].argmax(axis=1), 0)
    return last <= first


class Region:
    """The words at home in one region, of one length, and the search of others among them."""

    def __init__(self, words: pa.Table):
        self.n = words.column("n").to_numpy()
        self.words = np.array(words.column("word").to_pylist())
        self.length = len(self.words[0])
        self.matrix = letter_matrix(self.words, self.length)
        counts = letter_counts(self.matrix)
        self.tree = grow(counts, np.arange(len(counts)), LEAF)
        self.leaf_of = np.empty(len(counts), np.int64)
        for i, leaf in enumerate(leaves(self.tree)):
            leaf.name = i
            self.leaf_of[leaf.at] = i
        self.used = np.flatnonzero(levels(counts).any(axis=0))
        bits, sums = self._sides(counts)
        self.bits = np.hstack([-2 * bits, sums, np.ones_like(sums)]).T

    def _sides(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = levels(counts)
        return bits[:, self.used].astype(np.float32), bits.sum(axis=1, dtype=np.float32, keepdims=True)

    def pairs(self, asked: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row of `asked`, row at home) of the pairs one edit apart. `own`: `asked` are these rows at home, and each pair
        of two of them is found once."""
        reach = 2 if asked.shape[1] == self.length else 1
        counts = letter_counts(asked)
        bits, sums = self._sides(counts)
        bits = np.hstack([bits, np.ones_like(sums), sums])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for leaf, rows in from_root(self.tree, counts, reach):
            if own is not None:
                rows = rows[self.leaf_of[own[rows]] >= leaf.name]
            i, j = np.nonzero(bits[rows] @ self.bits[:, leaf.at] <= reach + 0.5)
            a, b = rows[i], leaf.at[j]
            if own is not None:
                once = (self.leaf_of[own[a]] > leaf.name) | (own[a] > b)
                a, b = a[once], b[once]
            right = one_edit(asked[a], self.matrix[b])
            found.append((a[right], b[right]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _summed(words: np.ndarray, others: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """For each word its number of near words, and the one of them with the largest n (the smallest of equals)."""
    order = np.lexsort((others, -n, words))
    words, others, n = words[order], others[order], n[order]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
    return pa.record_batch({"word": pa.array(words[first], pa.string()), "near": pa.array(np.diff(np.r_[first, len(words)]), pa.int64()),
                            "best": pa.array(others[first], pa.string()), "best_n": pa.array(n[first], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, best, best_n) of the words that have a near word, from distinct `words` (word, n) of letters only.

    For each length a k-d tree of a sample of its words cuts the space of letter counts into cells, the regions. Every
    word is at home in one region of its length, and asks all regions of its length and of the length below whose cell
    an edit can reach: one edit moves the counts by a distance (L1) of at most two, an inserted letter by one. In a
    region, a tree over its words is searched with the same bound on boxes, and the letter order decides. Words of one
    region are held by one task; those that ask pass through in batches.
    """
    spark = words.sparkSession
    sizes = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}  # one row a length
    total = sum(sizes.values())
    share = min(1.0, SAMPLE_WORDS / max(1, total))
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000)).select("word").toArrow().column("word")
    of_length: dict[int, list] = {n: [] for n in sizes}
    for w in sample.to_pylist():
        of_length[len(w)].append(w)
    trees: dict[int, Node] = {}
    names = 0
    for length, n in sorted(sizes.items()):
        some = letter_matrix(of_length[length], length) if of_length[length] else np.full((1, length), ord("a"), np.uint8)
        regions = max(1, -(-n // max(1, min(REGION_WORDS, REGION_BYTES // length))))
        tree = grow(letter_counts(some), np.arange(len(some)), max(1, len(some) // regions))
        cells(tree, np.zeros(LETTERS, np.int64), np.full(LETTERS, length, np.int64))
        for leaf in leaves(tree):
            leaf.at, leaf.name, names = np.zeros(0, np.int64), names, names + 1
        trees[length] = tree
    shared = spark.sparkContext.broadcast(trees)  # at most two nodes for each word of the sample

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            lengths = np.array([len(w) for w in words], np.int64)
            region, asks, row = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            for length in map(int, np.unique(lengths)):
                of = np.flatnonzero(lengths == length)
                counts = letter_counts(letter_matrix([words[i] for i in of], length))
                home = np.zeros(len(of), np.int64)
                for leaf, rows in from_root(trees[length], counts, 0):
                    home[rows] = leaf.name
                region.append(home), asks.append(np.zeros(len(of), bool)), row.append(of)
                for there, reach in ((length, 2), (length - 1, 1)):
                    if there in trees:
                        for leaf, rows in from_root(trees[there], counts, reach):
                            rows = rows[home[rows] < leaf.name] if there == length else rows  # a pair meets in one region
                            region.append(np.full(len(rows), leaf.name)), asks.append(np.ones(len(rows), bool)), row.append(of[rows])
            at = pa.array(np.concatenate(row))
            yield pa.record_batch({"region": pa.array(np.concatenate(region), pa.int64()), "asks": pa.array(np.concatenate(asks)),
                                   "word": batch.column(0).take(at), "n": batch.column(1).take(at)})

    def among_own(region: Region) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(region.n), BATCH):
            own = np.arange(i, min(i + BATCH, len(region.n)))
            a, b = region.pairs(region.matrix[own], own)
            a = own[a]
            yield _summed(region.words[np.r_[a, b]], region.words[np.r_[b, a]], region.n[np.r_[b, a]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: list[pa.RecordBatch] = []
        now, region = None, None
        for batch in batches:
            names, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (asks[1:] != asks[:-1])]) if len(names) else np.zeros(0, np.int64)
            for start, end in zip(edges, np.r_[edges[1:], len(names)].astype(np.int64), strict=True):
                if home and (asks[start] or names[start] != now):
                    region, home = Region(pa.Table.from_batches(home)), []
                    yield from among_own(region)
                if names[start] != now:
                    now, region = names[start], None
                part = batch.slice(start, end - start)
                if not asks[start]:
                    home.append(part)
                    continue
                if region is None:
                    continue
                column, n = part.column("word").to_pylist(), part.column("n").to_numpy()
                lengths = np.array([len(w) for w in column])
                for length in map(int, np.unique(lengths)):
                    of = np.flatnonzero(lengths == length)
                    asked = np.array([column[i] for i in of])
                    a, b = region.pairs(letter_matrix(asked, length))
                    yield _summed(np.r_[asked[a], region.words[b]], np.r_[region.words[b], asked[a]], np.r_[region.n[b], n[of][a]])
        if home:
            yield from among_own(Region(pa.Table.from_batches(home)))

    dealt = words.select("word", "n").mapInArrow(deal, "region bigint, asks boolean, word string, n bigint")
    dealt = dealt.repartition("region").sortWithinPartitions("region", "asks")
    found = dealt.mapInArrow(search, "word string, near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")
    summed = found.groupBy("word").agg(F.sum("near").alias("near"), best)
    return summed.select("word", "near", "b.best", (-F.col("b.less")).alias("best_n"))


def variants(words: DataFrame, *, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct `words` (word, n) of letters a-z and U+00C0 to U+00FF.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near
    word of largest n (of equals the smallest in code-point order) if that n is at least `times` its own; the root
    follows forms to the last one. Forms grow in n, so the steps to a root are at most the logarithm of n.
    """
    near = near_words(words)
    joined = words.join(growing(near.withColumnRenamed("word", "of")), F.col("word") == F.col("of"), "left")
    formed = F.col("best_n") >= F.lit(times) * F.col("n")
    table = joined.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
                          F.when(formed, F.col("best_n")).alias("form_n"))
    table = written(table, "spelling-forms")
    now = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps
        after = now.select(F.col("word").alias("of"), F.col("root").alias("next"))
        now = written(now.join(growing(after), F.col("root") == F.col("of"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            break
        now = now.select("word", "root")
    roots = now.select(F.col("word").alias("of"), "root")
    return table.join(growing(roots), F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def words_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the longest runs of letters of whole texts, A-Z lower-cased, with at least `letters` code points and
    `count` occurrences. Where DELETED_OF divides the CRC-32 of "id:run", the run loses the code point at that number
    modulo its length. Null texts have no words, a null id is the empty text, repeated rows count each, other columns
    are ignored."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{letters},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))

    def without(run: Column, at: Column) -> Column:
        return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))

    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    results = hashed.select(F.when(F.col("h") % DELETED_OF == 0, without(F.col("run"), at)).otherwise(F.col("run")).alias("word"))
    return results.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def spelling_variants(docs: DataFrame, **how) -> DataFrame:
    """`variants` of `words_of` the documents. An empty table gives no rows."""
    return variants(written(words_of(docs, **how), "spelling-words"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))
