"""Bounded stream summaries, compaction of batch tables and the table of late rows."""

import math
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewatch.session import fresh_path
from tidewatch.streaming import batches, sketches, windows


def flood(spark, path, files=4, rows=6000):
    """Flows in files: a few heavy sources, and ever new spoofed ones in each file."""
    for i in range(files):
        n = F.col("id") + i * rows
        source = F.when(n % 3 == 0, F.concat(F.lit("10.0.0."), (n % 7).cast("string"))).otherwise(F.concat(F.lit("198."), (n % 250).cast("string"), F.lit("."), n.cast("string")))
        spark.range(rows).coalesce(1).select(F.timestamp_seconds(F.lit(1_700_000_000) + n % 7200).alias("ts"), source.alias("ip_src"), F.lit("192.0.2.1").alias("ip_dst"),
                                             F.lit(5).alias("sport"), F.lit(80).alias("dport"), F.lit(17).alias("protocol"), (1 + n % 5).alias("packets")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("every", [2, 100])
def test_flood_stays_bounded(spark, every):
    """Ten thousand keys a window are kept as one row with 32 counters, within the stated errors, compacted or not."""
    path, folder = fresh_path(spark, "flood"), fresh_path(spark, "sketched")
    rows = flood(spark, path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    job = sketches.SketchedWindows(folder, [3600, 7200], ["src_ip", "dst_ip"], counters=32, every=every)
    job.run(stream)
    stored = batches.BatchTable(spark, f"{folder}/sketches").read()
    assert stored.groupBy("batch", "bucket", "dim").count().where("count > 1").isEmpty()
    assert stored.agg(F.max(F.size("counters"))).first()[0] == 32
    totals, found = job.windows(stream)
    exact = {}
    for r in rows.select(F.unix_seconds("ts").alias("t"), "ip_src", "packets").collect():
        for size in (3600, 7200):
            held = exact.setdefault((size, r.t - r.t % size), {})
            held[r.ip_src] = held.get(r.ip_src, 0) + r.packets
    assert {(r.window_size, r.window_start): r.total_packets for r in totals.collect()} == {k: sum(v.values()) for k, v in exact.items()}
    heavy = {f"10.0.0.{i}" for i in range(7)}
    for r in found.where("dim = 'src_ip'").collect():
        true = exact[r.window_size, r.window_start]
        total = sum(true.values())
        entropy = -sum(c / total * math.log2(c / total) for c in true.values())
        assert r.weight == total and abs(r.unique - len(true)) <= 0.05 * len(true)
        assert r.entropy_low - 1e-9 <= entropy <= r.entropy_high + 1e-9 and r.entropy_high - entropy < 0.5
        listed = {c.key: c.weight for c in r.counters}
        assert heavy <= set(listed) and all(listed[k] <= true[k] <= listed[k] + r.missed for k in listed)
        assert all(w <= r.missed for k, w in true.items() if k not in listed)


@pytest.mark.parametrize("seed", range(3))
def test_merging(spark, seed):
    """Any grouping of parts gives bounds that hold; with enough counters the summary is exact."""
    rnd = random.Random(seed)
    rows = [(rnd.randrange(12), "src_ip", f"k{min(rnd.randrange(60), rnd.randrange(60))}", rnd.randint(1, 9)) for _ in range(1500)]
    weights = spark.createDataFrame(rows, "part int, dim string, key string, w long").groupBy("part", "dim", "key").agg(F.sum("w").alias("weight"))
    true = {r.key: r.weight for r in weights.groupBy("key").agg(F.sum("weight").alias("weight")).collect()}
    for counters in (5, 200):
        parts = sketches.summaries(weights, ["part", "dim"], counters)
        halves = sketches.merged(parts.withColumn("part", F.col("part") % 3), ["part", "dim"], counters)
        for way in (parts, halves):
            r = sketches.measured(sketches.merged(way, ["dim"], counters)).first()
            listed = {c.key: c.weight for c in r.counters}
            assert len(listed) <= counters and all(listed.get(k, 0) <= w <= listed.get(k, 0) + r.missed for k, w in true.items())
            total = sum(true.values())
            entropy = -sum(c / total * math.log2(c / total) for c in true.values())
            assert r.entropy_low - 1e-9 <= entropy <= r.entropy_high + 1e-9
            if counters == 200:
                assert listed == true and r.missed == 0 and abs(r.entropy_high - entropy) < 1e-9 and abs(r.entropy_low - entropy) < 1e-9


def test_compaction(spark):
    """Reading takes as many folders after 40 batches as after 10; repeated batches replace themselves; nothing is lost."""
    table = batches.BatchTable(spark, fresh_path(spark, "compacted"), ("day",))
    want, sizes = {}, []
    for b in range(13):
        rows = [(b % 3, "a", f"k{i}", i % 2, b * 100 + i) for i in range(b % 3, b % 3 + 4)]
        for _ in range(2):  # a repeated batch
            table.write(spark.createDataFrame(rows, "bucket long, dim string, key string, day long, weight long"), b)
        want.update({r[:3]: r[4] for r in rows})
        if b % 4 == 3:
            assert table.compact(lambda found: windows.latest(found, [*windows.KEYS, "day"]))
            assert table._names("batch")[-1] == b
        sizes.append(len(table.batches()))
        found = windows.latest(table.read(), windows.KEYS)
        assert {(r.bucket, r.dim, r.key): r.weight for r in found.collect()} == want
    assert max(sizes) <= 5 and len(table._names("base")) <= 2 and len(table._names("batch")) <= 9
    assert table.last_before(12) == 11 and not table.compact(lambda found: found, least=9)


def test_late_rows_are_added_up(spark):
    """Over more batches than a query's progress holds, each counted once."""
    late = batches.LateRows(spark, fresh_path(spark, "late"))
    assert late.total() == 0
    for i in range(150):
        progress = SimpleNamespace(id="q", runId="r", batchId=i, timestamp="2024-01-01T00:00:00Z", stateOperators=[SimpleNamespace(numRowsDroppedByWatermark=i if i % 10 == 0 else 0)])
        for _ in range(1 + (i == 20)):
            late.onQueryProgress(SimpleNamespace(progress=progress))
    assert late.total() == sum(range(0, 150, 10))


def test_late_rows_of_a_stream(spark):
    path, folder = fresh_path(spark, "events"), fresh_path(spark, "late-stream")
    for i, (start, n) in enumerate([(5000, 50), (9000, 50), (0, 17), (9100, 5)]):
        spark.range(n).coalesce(1).select(F.timestamp_seconds(F.lit(start) + F.col("id")).alias("ts"), F.col("id").alias("k"), F.lit(i).alias("file")).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time
    late = batches.LateRows(spark, f"{folder}/late")
    spark.streams.addListener(late)
    try:
        rows = spark.readStream.schema("ts timestamp, k long, file int").option("maxFilesPerTrigger", 1).parquet(path)
        counts = rows.withWatermark("ts", "60 seconds").groupBy(F.window("ts", "60 seconds"), "k").count()
        query = counts.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(40):
            if late.total() == 17:
                break
            time.sleep(0.5)
        assert late.total() == 17
    finally:
        spark.streams.removeListener(late)
