"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written  # noqa: F401

#: A word is a longest run of code points other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def growing(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: it is never broadcast, so the plan is the same at every size."""
    return df.hint("merge")


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """`written`, packed more densely; Spark then removes the shuffle files of the write, which nothing reads any more."""
    conf, wanted = df.sparkSession.conf, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {name: conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            conf.set(name, value)
        return written(df, purpose)
    finally:
        for name, value in before.items():
            conf.set(name, value)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name like `stem` that no column of `df` has, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z; only texts with other than ASCII characters need the slower translation."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def grouped_batches(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with the same `key`, out of batches that are sorted by it. Holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i in range(len(column) + 1):
            if i == len(column):
                if start < i:
                    held.append(batch.slice(start, i - start))
            elif column[i] != last:
                if start < i:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, start = [], column[i], i
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, size: int) -> Iterator[pa.Table]:
    """Tables of whole groups of rows with the same `key`, out of batches that are sorted by it: a table ends with the first
    group that brings it to `size` bytes. Holds one table and one batch at a time."""
    held: list[pa.RecordBatch] = []
    much, last = 0, None
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)[start:]
            each = max(1, batch.nbytes // batch.num_rows)
            if much >= size:
                some = 0
            else:  # rows up to the size, and from there to the end of their group
                some = min(len(column), max(1, -((much - size) // each)))
                last = column[some - 1]
            other = np.flatnonzero(column[some:] != last)
            end = some + int(other[0]) if len(other) else len(column)
            if end:
                held.append(batch.slice(start, end))
                much += end * each
            if len(other):
                yield pa.Table.from_batches(held)
                held, much = [], 0
            start += end
    if held:
        yield pa.Table.from_batches(held)
