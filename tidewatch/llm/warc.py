"""WARC archives with revisit records, and capture histories merged from sorted runs by a loser tree."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import lower_ascii, read_table, written

# Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 1000
EPOCH = 1_700_000_000
RECORDS = "run string, seq bigint, url_key string, captured string, url string, record_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then path and query; scheme, www, port and fragment are left out. Null: ''."""
    plain = F.regexp_replace(lower_ascii(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*", 0), r"^www\.|:\d*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(plain, r"^[^/?]*", ""))


def with_record_types(pages: DataFrame, least_bytes: int) -> DataFrame:
    """`pages` (record_id, url, captured, payload) with payload_bytes, payload_digest, record_type and refers_to.

    Only payloads that several records share are kept in the table of originals; it is written, so that the join's
    two sides are plain exchanges and a payload of very many records can be split.
    """
    sized = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    large = sized.where(F.col("payload_bytes") >= least_bytes)
    shared = large.groupBy(F.col("payload_digest").alias("shared_digest"), F.col("payload_bytes").alias("shared_bytes")).agg(
        F.max("record_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 and original is not null").drop("n")
    shared = written(shared, "warc-originals")
    joined = sized.join(shared, (F.col("payload_digest") == F.col("shared_digest")) & (F.col("payload_bytes") == F.col("shared_bytes")), "left")
    again = F.col("original").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("original"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("original"))).drop(
        "shared_digest", "shared_bytes", "original")


def record_text(revisit: Column) -> Column:
    """A record without the two line ends that close it. Header values lose control characters; the payload is whole."""
    def value(c: Column) -> Column:
        return F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")
    body = F.when(revisit, "").otherwise(F.col("payload"))
    record_id = F.col("record_id").cast("string")
    return F.concat(
        F.lit(VERSION + "\r\nWARC-Type: "), F.col("record_type"),
        F.when(F.col("record_id").isNotNull(), F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), record_id, F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Date: "), F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), value(F.col("url")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_REVISIT) -> None:
    """One gzip archive per task, its records sorted by URL key, time and id: a capture run."""
    typed = with_record_types(pages, least_bytes).withColumn("key", url_key(F.col("url")))
    run = typed.sortWithinPartitions("key", "captured", "record_id")
    run.select(record_text(F.col("record_type") == "revisit").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record, by its content length."""
    data, at = content, 0
    while at < len(data):
        head = data.index(END.encode(), at)
        lines = data[at:head].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = head + len(END)
        end = begin + int(headers["Content-Length"])
        yield headers, data[begin:end]
        at = end + len(END)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def number(urn: str | None) -> int | None:
        return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = []
            for headers, payload in parse_archive(gzip.decompress(content)):
                response = headers["WARC-Type"] == "response"
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if response and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {headers.get('WARC-Record-ID')} does not match its digest")
                rows.append((path, len(rows), headers["WARC-Date"], headers.get("WARC-Target-URI"), number(headers.get("WARC-Record-ID")),
                             len(payload) if response else int(headers["WARC-Payload-Length"]), digest, headers["WARC-Type"], number(headers.get("WARC-Refers-To"))))
            frame = pd.DataFrame(rows, columns=["run", "seq", "captured", "url", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield frame.astype({"record_id": "Int64", "refers_to": "Int64"}).assign(url_key=None)[[c.split()[0] for c in RECORDS.split(", ")]]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under `path`, by run and place in it. Payload lengths and digests of responses are taken
    from the payload. Archives are read whole, one at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(_read, RECORDS).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """k-way merge: `losers` holds the loser of each inner match and, at 0, the winner; a step replays one path."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for leaf in range(len(runs)):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return (self.key(self.heads[a]), a) < (self.key(self.heads[b]), b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[self.losers[0]] is not None:
            top = self.losers[0]
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self._replay(top)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the slices of the runs in one range; rows come by run and place."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    keys = list(zip(rows["url_key"], rows["captured"], rows["order_id"], strict=True))
    ends = np.flatnonzero(np.r_[(rows["run"].to_numpy()[1:] != rows["run"].to_numpy()[:-1]), True]) + 1
    begins = np.r_[0, ends[:-1]]
    order = np.fromiter(LoserTree([iter(range(a, b)) for a, b in zip(begins, ends, strict=True)], keys.__getitem__), np.int64, len(rows))
    yield rows.iloc[order].drop(columns="order_id")


def merge_runs(records: DataFrame) -> DataFrame:
    """All records in order of URL key, time and id: partitions are consecutive ranges, each merged from the sorted
    slices of the runs. A range splits where it is large, also within one URL, for its bounds hold time and id too."""
    keyed = records.withColumn("order_id", F.coalesce("record_id", F.lit(-(2**63)).cast("long")))
    index = written(keyed, "warc-index")
    ranged = index.repartitionByRange("url_key", "captured", "order_id", "run", "seq").sortWithinPartitions("run", "seq")
    return ranged.mapInPandas(_merge, records.schema)


def capture_histories(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                      captured: Column | None = None, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """Writes `pages` as archives under `path`, reads them back and merges their index into one globally ordered history.

    Of records with equal payloads of at least `least_bytes` bytes the one with the largest id is a response and the
    others revisit it without payload; rows that share that largest id are all responses, and rows with null id never
    are originals unless all are null, then all are responses. A null payload is empty, a null URL sorts first; without
    `captured` (timestamp) a record's time is EPOCH plus its id in seconds. Empty tables give no rows; repeated rows give
    records of their own. Other columns are ignored.
    """
    number = F.col(id_col).cast("long")
    when = captured if captured is not None else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(number, F.lit(0)), F.lit(10**9)))
    write_archives(pages.select(number.alias("record_id"), F.col(url_col).alias("url"), when.alias("captured"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")),
                   path, least_bytes)
    return merge_runs(read_archives(pages.sparkSession, path))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = capture_histories(read_table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return merged.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM o
"""
