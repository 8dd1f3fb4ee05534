"""Tables that a stream extends batch by batch, kept short by compaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class BatchTable:
    """A folder with the rows of each micro-batch under `batch=N`; a repeated batch replaces itself.

    `compact` puts the batches so far, but for the newest, into one base. The base is named by the last batch in it and
    counts from the moment its mark stands, which is written last; so a run that breaks off changes nothing. The newest
    batch stays out because a restarted stream may repeat it. What a base replaces is removed one compaction later, so
    that readers of the moment come to their end. Reading takes the base and the batches after it.
    """

    def __init__(self, spark: SparkSession, path: str, partitions: tuple[str, ...] = ()):
        self.spark, self.path, self.partitions = spark, path, partitions

    def _names(self, pattern: str) -> list[int]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}=*")
        found = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target)
        return sorted(int(s.getPath().getName().split("=")[-1]) for s in found or [])

    def _remove(self, name: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy(*self.partitions).parquet(f"{self.path}/batch={batch}")

    def batches(self) -> list[int]:
        """The batches after the base."""
        marks = self._names("mark")
        return [b for b in self._names("batch") if not marks or b > marks[-1]]

    def last_before(self, batch: int) -> int | None:
        """The newest batch before this one, by the names of the folders alone."""
        return max((b for b in self._names("batch") if b < batch), default=None)

    def read(self) -> DataFrame:
        """All rows with their batch; those of the base have the last batch that it holds."""
        marks, parts = self._names("mark"), []
        if marks:
            parts.append(self.spark.read.parquet(f"{self.path}/base={marks[-1]}").withColumn("batch", F.lit(marks[-1])))
        if newer := self.batches():
            parts.append(self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={b}" for b in newer]))
        out = parts[0]
        return out if len(parts) == 1 else parts[1].unionByName(out)

    def compact(self, merge: Callable[[DataFrame], DataFrame], least: int = 2) -> bool:
        """One base of all batches but the newest, if there are at least `least` of them; `merge` gets their rows with
        `batch` and leaves it out."""
        marks, closed = self._names("mark"), self.batches()[:-1]
        if len(closed) < least:
            return False
        rows = self.read().where(F.col("batch") <= closed[-1])
        merge(rows).write.mode("overwrite").partitionBy(*self.partitions).parquet(f"{self.path}/base={closed[-1]}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/mark={closed[-1]}")
        if marks:  # these went into the base before
            for b in self._names("batch"):
                if b <= marks[-1]:
                    self._remove(f"batch={b}")
            for b in marks[:-1]:
                self._remove(f"mark={b}")
                self._remove(f"base={b}")
        return True


class LateRows(StreamingQueryListener):
    """Adds the rows that came after the watermark, and were dropped, to a table: one row a batch that dropped any.

    A query's own progress holds its last hundred batches only. Rows count as the stateful operator gets them: an
    aggregate gets one row a task, bucket and key. Register it with `spark.streams.addListener`; rows are
    kept under (run, batch), so a batch that is reported twice counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        dropped = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        if dropped:
            row = self.spark.range(1).select(F.lit(str(progress.id)).alias("query"), F.lit(progress.timestamp).alias("at"), F.lit(int(dropped)).cast("bigint").alias("dropped"))
            row.write.mode("overwrite").parquet(f"{self.path}/run={progress.runId}/batch={progress.batchId}")

    def total(self) -> int:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return 0
        return self.spark.read.parquet(self.path).agg(F.sum("dropped")).first()[0]
