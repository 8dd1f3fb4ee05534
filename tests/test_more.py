"""Streams in several batches, model jobs, file sources, order statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import ThresholdSettings
from tidewatch.operators import ml, running, windows
from tidewatch.session import fresh_path
from tidewatch.sources import events as src
from tidewatch.sources import files, messages
from tidewatch.streaming import stateful
from tidewatch.streaming import windows as sw

from .conftest import SMALL

SIZES = [3600, 21600]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in six files of rising time."""
    path = str(tmp_path_factory.mktemp("parts"))
    src.events(spark, SMALL).repartitionByRange(6, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)
    return path


def stream(spark, path):
    schema = src.events(spark, SMALL).schema
    return src.flows_from(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))


def rows(df):
    return sorted(map(str, df.collect()))


def test_windows_over_batches(spark, parts):
    folder = fresh_path(spark, "t")
    # File order follows write time, not event time, so nothing may be late here.
    level = sw.run_windows(stream(spark, parts), f"{folder}/l", f"{folder}/c", SIZES, lateness="40 days")
    got = sw.windows_from(level, SIZES, list(windows.DIMENSIONS))
    want = windows.traffic_features(src.flows(spark, SMALL), SIZES)
    names = ["window_size", "window_start", "total_packets", "total_bytes", "unique_src_ips", F.round("entropy_src_ip", 6).alias("e"), "top_src_ips"]
    assert rows(got.select(*names)) == rows(want.select(*names))


def test_detector_over_batches(spark, parts):
    s = ThresholdSettings(pps=0.001, syn_ratio=0.5, syn_min_pps=0.001, udp_ratio=0.3, udp_min_pps=0.001)
    late = 40 * 86400
    many = sw.Detector(spark, fresh_path(spark, "many"), SIZES, settings=s, lateness_seconds=late)
    many.run(stream(spark, parts))
    one = sw.Detector(spark, fresh_path(spark, "one"), SIZES, settings=s)
    one.run(src.flows_from(spark.readStream.schema(src.events(spark, SMALL).schema).option("pathGlobFilter", "events.parquet").parquet(SMALL)))
    names = ["window_size", "window_start", "rule", F.round("confidence", 6).alias("c")]
    assert rows(many.alert_rows().select(*names)) == rows(one.alert_rows().select(*names))


def test_detector_judges_as_windows_close(spark):
    """Ordered batches with little lateness: windows are judged batch by batch, with the same result."""
    base = fresh_path(spark, "ordered")
    e = src.events(spark, SMALL).withColumn("part", F.expr("cast((unix_micros(cast(ts as timestamp)) - 1704067200000000) div 432000000000 as int)"))
    schema = src.events(spark, SMALL).schema
    s = ThresholdSettings(pps=0.001, syn_ratio=0.5, syn_min_pps=0.001, udp_ratio=0.3, udp_min_pps=0.001)
    d = sw.Detector(spark, fresh_path(spark, "steps"), SIZES, settings=s)
    for i in range(6):
        e.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(base)
        d.run(src.flows_from(spark.readStream.schema(schema).parquet(base)), finish=i == 5)
    want = sw.Detector(spark, fresh_path(spark, "one"), SIZES, settings=s)
    want.run(src.flows_from(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SMALL)))
    names = ["window_size", "window_start", "rule", F.round("confidence", 6).alias("c")]
    assert rows(d.alert_rows().select(*names)) == rows(want.alert_rows().select(*names))
    assert d.alert_rows().select("batch").distinct().count() > 2
    names = ["window_size", "window_start", "attack_type", F.round("confidence", 6).alias("c"), "kept"]
    assert rows(d.table("verdicts").select(*names)) == rows(want.table("verdicts").select(*names))
    admitted = d.table("verdicts").filter("kept").count()
    assert 0 < admitted == d.table("messages").count()
    assert d.table("metrics").filter("name = 'attacks_detected_total'").agg(F.sum("value")).first()[0] == admitted
    # What is carried from batch to batch is bounded, and only days that can still close are read.
    assert d.table("recent").groupBy("batch", "window_size").count().agg(F.max("count")).first()[0] <= s.history
    assert d.table("level").select("day").distinct().count() > 3


def test_sessions_stream_equals_batch(spark):
    """Several micro-batches and an end of input give the records of the batch operator."""
    from tidewatch.operators import flows
    base, folder = fresh_path(spark, "packets"), fresh_path(spark, "s")
    packets = src.packets(spark, SMALL)
    middle = packets.agg(F.percentile_approx("us", 0.5)).first()[0]
    packets.filter(F.col("us") <= middle).coalesce(1).write.parquet(f"{base}/a")
    packets.filter(F.col("us") > middle).coalesce(1).write.parquet(f"{base}/b")
    live = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/*")
    got = stateful.closed_sessions(live, "event_id", folder)
    names = ["flow_id", "first_us", "last_us", *stateful.ENDS, *stateful.COUNTS]
    means = [F.round(c, 6).alias(c) for c in stateful.MEANS]
    want = flows.flow_records(packets, ["event_id"])
    assert rows(got.select(*names, *means)) == rows(want.select(*names, *means))


def test_sessions_stream_serves_flows_in_groups(spark):
    """A row of state holds the open flows of a group: with three groups there are three at most, and the records are the batch operator's."""
    from tidewatch.operators import flows
    base, folder = fresh_path(spark, "packets"), fresh_path(spark, "s")
    packets = src.packets(spark, SMALL)
    first, last = packets.agg(F.min("us"), F.max("us")).first()
    third = F.expr(f"(us - {first}) * 3 div {last - first + 1}")
    for i in range(3):
        packets.filter(third == i).coalesce(1).write.parquet(f"{base}/{i}")
    live = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/*")
    held = []
    for _ in range(3):
        stream = stateful.session_stream(stateful.end_marks(live, f"{folder}/marks"), "event_id", groups=3)
        query = (stream.writeStream.format("parquet").option("path", f"{folder}/t").option("checkpointLocation", f"{folder}/c")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        held += [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
        stateful.mark_end(live, f"{folder}/marks", f"{2200 + len(held)}-01-01 00:00:00")
    assert 0 < max(held) <= 3 and held[-1] == 0 and packets.select("ip_src").distinct().count() > 10
    got = spark.read.schema(stream.schema).parquet(f"{folder}/t")
    names = ["flow_id", "first_us", "last_us", *stateful.ENDS, *stateful.COUNTS]
    want = flows.flow_records(packets, ["event_id"])
    assert rows(got.select(*names)) == rows(want.select(*names))


def test_deltas_over_batches(spark):
    base, folder = fresh_path(spark, "snaps"), fresh_path(spark, "d")
    snaps = src.snapshots_from(src.flows(spark, SMALL)).drop("ip_src", "ip_dst", "protocol")
    cut = F.expr("cast((unix_micros(ts) - 1704067200000000) div 864000000000 as int)")
    from tidewatch.operators import flows
    for i in range(3):
        snaps.filter(cut == i).coalesce(1).write.mode("append").parquet(base)
        live = spark.readStream.schema(snaps.schema).parquet(base)
        got = stateful.drain(stateful.delta_stream(live, "event_id", ttl_seconds=40 * 86400), f"{folder}/t", f"{folder}/c")
    want = flows.counter_deltas(snaps, ["event_id"]).select(got.columns)
    assert rows(got) == rows(want)


def test_quantiles_with_heavy_value(spark, monkeypatch):
    monkeypatch.setattr(running, "CHUNK_VALUES", 50)
    df = spark.range(999).select(F.expr("case when id % 3 = 0 then 7.0D else cast(id as double) end").alias("x"))
    got = running.exact_quantiles(df, [], "x", [0.0, 0.25, 0.5, 0.95, 1.0]).collect()[0]
    want = np.quantile([r["x"] for r in df.collect()], [0.0, 0.25, 0.5, 0.95, 1.0])
    assert np.allclose(list(got), want)


def test_ranges_hold_few_values(spark, monkeypatch):
    """The ranges of a key grow with its values, and none holds much more than its share of them."""
    monkeypatch.setattr(running, "CHUNK_VALUES", 100)
    df = spark.range(6000).select(F.expr("case when id % 10 < 8 then 'a' else 'b' end").alias("k"), (F.col("id") * 37 % 5003).alias("x"))
    found = running.value_chunks(running.value_counts(df, ["k"], "x"), ["k"], "x")
    spans = sorted((r["k"], r["_chunk"], r["low"], r["high"], r["n"]) for r in found.groupBy("k", "_chunk").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).collect())
    assert len(spans) > 40 and max(s[-1] for s in spans) < 400
    assert all(a[0] != b[0] or a[3] < b[2] for a, b in zip(spans, spans[1:]))


def test_oversample_neighbours(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(x), float(y), int(i < 30)) for i, (x, y) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(data, "id long, x double, y double, label int")
    out = ml.oversample(df, ["x", "y"], "label", ["id"], reach=64).collect()
    assert len(out) == 170 // 2 - 30
    points = np.array([(x, y) for _, x, y, l in data if l])
    for r in out:
        p, hit = np.array([r["x"], r["y"]]), False
        for a in points:
            near = points[np.argsort(((points - a) ** 2).sum(axis=1))[1:6]]
            for b in near:
                d = b - a
                t = float((p - a) @ d / (d @ d))
                hit = hit or (-1e-9 <= t <= 1 and np.allclose(a + t * d, p, atol=1e-9))
        assert hit


def test_nearest_rows_are_exact(spark):
    """Whatever the reach, distances to the neighbours are those of brute force; with ties and outliers."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(900, 3)), np.zeros((60, 3)), rng.normal(size=(5, 3)) * 1000])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double, z double")
    got = ml.nearest_rows(df, ["x", "y", "z"], ["id"], reach=4).collect()
    assert sorted(r["id"] for r in got) == list(range(len(x)))
    for r in got:
        want = np.sort(((np.delete(x, r["id"], axis=0) - x[r["id"]]) ** 2).sum(axis=1))[:5]
        assert np.allclose([n["d"] for n in r["_best"]], want, rtol=1e-9, atol=0) and r["rn"] not in [n["r"] for n in r["_best"]]


def test_isolation_forest_ranks_outliers(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))] + [(400, 12.0, -11.0), (401, -13.0, 12.0)]
    df = spark.createDataFrame(data, "id long, x double, y double")
    forest = ml.fit_isolation_forest(df, ["x", "y"], ["id"], trees=50)
    scored = ml.forest_verdicts(ml.score_isolation_forest(df, ["x", "y"], forest), 0.05)
    top = [r["id"] for r in scored.orderBy(F.desc("raw_score")).limit(2).collect()]
    assert set(top) == {400, 401}
    assert scored.filter("ml_is_attack").count() <= 21
    assert scored.filter("raw_score <= 0 or raw_score > 1").count() == 0


def test_csv_and_unknown_format(spark, tmp_path):
    from tidewatch.schemas import LABELLED_WINDOW_CSV
    path = tmp_path / "x.csv"
    names = [f.name for f in LABELLED_WINDOW_CSV.fields]
    path.write_text(",".join(names) + "\n2024-01-15 10:00:00,1.1.1.1,2.2.2.2,6,1,80,150,15000,3.0,50.0,5000.0,5,3.2,0.85,0.1,0.05,0.02,100.0,0,normal\n")
    row = files.load_table(spark, str(path), LABELLED_WINDOW_CSV).collect()[0]
    assert (row["packets"], row["attack_type"], row["timestamp"].hour) == (150, "normal", 10)
    with pytest.raises(ValueError):
        files.load_table(spark, "x.xlsx")


def test_audit_skips_bad_lines(spark, tmp_path):
    path = tmp_path / "audit.json"
    path.write_text('{"timestamp":"2024-01-01T00:00:00","action":"a","user":"u","resource":"r","details":{"k":"v"}}\n\nnot json\n')
    assert files.read_audit(spark, str(path)).count() == 1


def test_packet_scan_and_archive(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"ts":"2024-01-01T00:00:00","ip_src":"a","ip_dst":"b","length":5}\n{"ts":"2024-01-01T00:00:00","eth_src":"x"}\n')
    assert files.read_packets(spark, str(path)).count() == 1
    t = src.flows(spark, SMALL)
    files.archive_older(t, "ts", F.lit("2024-01-10").cast("timestamp"), str(tmp_path / "old"), "20240110")
    assert spark.read.json(str(tmp_path / "old")).count() == t.filter("ts < timestamp'2024-01-10'").count()


def test_send_batch_and_reference_snapshot(spark, tmp_path):
    from tidewatch.operators import drift
    t = src.flows(spark, SMALL).select("event_id", "packets")
    files.send_batch(t, str(tmp_path / "sent"), records_per_file=300)
    assert spark.read.json(str(tmp_path / "sent")).count() == t.count()
    metrics = spark.createDataFrame([("accuracy", 0.9)], "metric_name string, value double")
    drift.reference_snapshot(t, ["packets"], metrics, str(tmp_path / "ref"))
    stored = spark.read.parquet(str(tmp_path / "ref" / "features"))
    shift = drift.covariate_shift(stored, t, ["packets"]).collect()[0]
    assert (shift["ks_statistic"], shift["wasserstein"], shift["drifted"], shift["p_value"]) == (0.0, 0.0, False, 1.0)


def test_archive_and_keep_are_complements(spark):
    from tidewatch.operators import governance
    t = src.flows(spark, SMALL)
    kept, old = governance.split_by_age(t, F.lit("2024-02-05").cast("timestamp"), 20)
    assert kept.unionByName(old).exceptAll(t).count() == 0 and kept.count() + old.count() == t.count()


def test_kafka_options():
    o = messages.kafka_options("h:1", ["a", "b"], "g", "earliest", 500, {"security.protocol": "SSL"})
    assert o["subscribe"] == "a,b" and o["maxOffsetsPerTrigger"] == "500" and o["kafka.security.protocol"] == "SSL"
    with pytest.raises(ValueError):
        messages.kafka_options("h:1", ["a"], start="middle")


def test_message_shape(spark):
    df = spark.createDataFrame([("f1", "1.1.1.1", 1.23456789), (None, "1.1.1.1", 2.0), (None, None, 3.0)], "flow_id string, ip_src string, x double")
    out = messages.to_messages(df, "flows").collect()
    assert [r["key"] for r in out] == ["f1", "1.1.1.1", "unknown"]
    assert '"x":1.234568' in out[0]["value"] and "_producer_timestamp" in out[0]["value"]
    assert "alert_timestamp" in messages.to_messages(df, "alerts").first()["value"]
