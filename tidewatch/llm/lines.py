"""Line dedup over range-partitioned line hashes; decisions travel as per-document bitmaps, never as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, fresh, growing, lower_ascii, read_table, written
from .components import components

MIN_DOCS = 10
BITS = 64
PERCENT, BANDS, BAND_ROWS = 80, 8, 4


def lines_of(text: Column) -> Column:
    """The lines of a whole text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def document_key(doc_id: Column, text: Column) -> Column:
    """Names rows by id and whole text."""
    name = F.when(doc_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), doc_id.cast("string")))
    return F.unhex(F.md5(F.concat(name, F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))))


def split_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, lines) of each row: key and lines are computed once a text, below any explode."""
    return docs.select(F.col(id_col).alias("doc_id"), document_key(F.col(id_col), F.col(text_col)).alias("doc"), lines_of(F.col(text_col)).alias("lines"))


def line_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, doc_id, doc, positions, times) for each key of each document, in ranges of (hash, document); `times` is the
    number of rows that are equal in id and text.

    The range keys hold the document as well, so a line that a third of all documents have is spread over many ranges.
    Each range is sorted by hash, document and position; the group-by needs no other exchange. The bounds of the ranges
    are sampled from the written hashes, not from the texts.
    """
    one = split_documents(docs, id_col, text_col).select("doc_id", "doc", F.posexplode("lines").alias("pos", "line"))
    keyed = one.withColumn("key", line_key("line")).where("key <> ''").select(F.unhex(F.md5("key")).alias("hash"), "doc_id", "doc", "pos")
    ranged = written(keyed, "line-hashes").repartitionByRange("hash", "doc_id", "doc").sortWithinPartitions("hash", "doc_id", "doc", "pos")
    runs = ranged.groupBy("hash", "doc_id", "doc").agg(F.collect_set("pos").alias("positions"), F.count(F.lit(1)).alias("n"))
    return runs.select("hash", "doc_id", "doc", "positions", F.expr("n div size(positions)").alias("times"))


def line_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, class) of the documents that are near copies by their lines, in SQL functions only; others have no row.

    Documents meet where a band of BAND_ROWS MinHash values of their sets of line keys is equal; each is compared with
    the first of its band, exactly: linked where the sets have a Jaccard similarity of PERCENT or more. Classes are the
    components. Two near copies share no band with a chance of at most (1 - 0.8**4)**8, 1.6 percent at the limit; they
    then count as two. Rows equal in id and text are one document; texts without a line that holds more than blanks have
    no class.
    """
    keys = F.filter(F.array_distinct(F.transform("lines", line_key)), lambda k: k != "")
    sets = split_documents(docs, id_col, text_col).select(F.xxhash64("doc").alias("node"), "doc", F.transform(keys, lambda k: F.xxhash64(k)).alias("own")).where("size(own) > 0")
    sets = written(sets, "line-sets")

    def band(i: int) -> Column:
        return F.xxhash64(F.lit(i), *[F.array_min(F.transform("own", lambda k, j=j: F.xxhash64(k, F.lit(j)))) for j in range(i * BAND_ROWS, (i + 1) * BAND_ROWS)])

    places = written(sets.select("node", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("band")).distinct(), "line-bands")
    shared = places.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = places.join(growing(shared), "band").where("node <> hub").select("node", "hub").distinct()
    once = sets.groupBy("node").agg(F.any_value("own").alias("own"))
    both = met.join(growing(once), "node").join(growing(once.select(F.col("node").alias("hub"), F.col("own").alias("others"))), "hub")
    common = F.size(F.array_intersect("own", "others"))
    links = both.where(100 * common >= PERCENT * (F.size("own") + F.size("others") - common)).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    found = components(links).select("node", F.col("component").alias("class"))
    return sets.select("node", "doc").distinct().join(growing(found), "node").select("doc", "class")


def line_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = False,
                 classes: DataFrame | None = None) -> DataFrame:
    """Keep bitmaps (doc, keep) of the documents that lose lines: entry i of `keep` has the bits of the lines from
    64 * i on; blocks after the last that loses a line are left out.

    A line goes if its key (stripped, A-Z lower-cased, not empty) is in at least `min_docs` documents; with
    `keep_first` its first occurrence by id, document and position stays. With `classes` (doc, class), documents of one
    class count once. Every row counts as a document, those with null ids and repeated rows too; rows equal in id and
    text share a bitmap. Null and empty texts have no key and an empty table no bitmap.
    """
    runs = written(line_runs(docs, id_col, text_col), "line-runs")
    first = F.min(F.struct("doc_id", "doc", F.array_min("positions").alias("pos"))).alias("first")
    common = runs.groupBy("hash").agg(F.sum("times").alias("n_docs"), first).where(F.col("n_docs") >= min_docs)
    common = written(common, "line-common")
    if classes is not None:
        held = runs.join(common, "hash").select("hash", "doc").join(growing(classes), "doc", "left")
        spread = held.select("hash", F.coalesce("class", F.xxhash64("doc")).alias("class")).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_classes"))
        common = written(common.join(spread.where(F.col("n_classes") >= min_docs), "hash").select(*common.columns), "line-common")
    lost = runs.join(common, "hash").select("doc", F.explode("positions").alias("pos"), "first")
    if keep_first:
        lost = lost.where((F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos")))
    bit = F.expr(f"shiftleft(1L, pos % {BITS})")
    blocks = lost.groupBy("doc", F.expr(f"pos div {BITS}").cast("int").alias("block")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    maps = blocks.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("map"), F.max("block").alias("last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda b: F.coalesce(F.try_element_at("map", b), F.lit(-1).cast("long")))
    return maps.select("doc", dense.alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    def stays(_: Column, i: Column) -> Column:
        bits = F.coalesce(F.get(keep, F.floor(i / BITS).cast("int")), F.lit(-1).cast("long"))
        return F.getbit(bits, i % BITS) == 1
    return F.when(keep.isNull(), lines).otherwise(F.filter(lines, stays))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = False,
                classes: DataFrame | None = None) -> DataFrame:
    """`docs` with the kept lines as text and two more columns, n_lines and n_dropped (underscores are added to these
    names where `docs` has them already).

    A null or empty text is one empty line and comes back as '' ; empty lines always stay. Every row counts as a document
    and null ids are ordinary; rows with equal id and text lose the same lines. An empty table gives no rows. `classes` is as for `line_bitmaps`.
    """
    doc, keep, lines, left = (fresh(docs, x) for x in ("line_doc", "line_keep", "line_all", "line_left"))
    maps = written(line_bitmaps(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, keep_first=keep_first, classes=classes), "line-bitmaps")
    maps = maps.select(F.col("doc").alias(doc), F.col("keep").alias(keep))
    joined = docs.withColumn(doc, document_key(F.col(id_col), F.col(text_col))).join(maps, doc, "left")
    split = joined.withColumn(lines, lines_of(F.col(text_col)))
    split = split.withColumn(left, kept_lines(F.col(lines), F.col(keep)))
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    return split.select(*[F.array_join(left, "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns],
                        F.size(lines).cast("long").alias(n_lines), (F.size(lines) - F.size(left)).cast("long").alias(n_dropped))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM texts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY r, doc_id
"""
