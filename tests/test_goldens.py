"""Known values of single operators."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.config import EnsembleSettings, RedirectSettings, RollingSettings, ThresholdSettings
from tidewatch.functions import net, numeric, privacy
from tidewatch.operators import alerts, detect, drift, ensemble, flows, governance, metrics, mitigation, rolling, rules, windows
from tidewatch.schemas import VOTE

T0 = datetime(2024, 1, 1)


def one(df):
    return df.collect()[0]


def test_entropy(spark):
    rows = [(T0, f"10.0.0.{i}", n) for i, n in ((1, 10), (2, 20), (3, 30))]
    f = spark.createDataFrame(rows, "ts timestamp, ip_src string, packets long")
    e = one(windows.key_summaries(windows.key_counts(f, [5], ["src_ip"]), ["src_ip"]))
    assert e["entropy_src_ip"] == pytest.approx(1.459148, abs=1e-6)


def test_zero_packets_weigh_one(spark):
    f = spark.createDataFrame([(T0, "a", 0), (T0, "b", None), (T0, "", 5)], "ts timestamp, ip_src string, packets long")
    t = one(windows.window_totals(f, [5]))
    assert (t["total_packets"], t["w_all"], t["total_flows"]) == (6, 7, 3)
    counts = {r["key"]: r["weight"] for r in windows.key_counts(f, [5], ["src_ip"]).collect()}
    assert counts == {"a": 1, "b": 1}


def window_rows(spark, pps, entropy=None, **extra):
    rows = [(5, i * 5, float(p), float((entropy or [2.0] * len(pps))[i]), extra.get("syn", 0.0), extra.get("udp", 0.0)) for i, p in enumerate(pps)]
    return spark.createDataFrame(rows, "window_size long, window_start long, packets_per_second double, entropy_src_ip double, syn_ratio double, udp_ratio double")


def raised(spark, pps, entropy=None, **extra):
    s = ThresholdSettings()
    d = rolling.dynamic_thresholds(window_rows(spark, pps, entropy, **extra), s)
    return detect.raise_alerts(d, detect.threshold_rules(d, s), s).collect()


def test_volumetric(spark):
    a = raised(spark, [50000])[0]
    assert (a["attack_type"], a["severity"], a["confidence"]) == ("pps_flood", "high", 0.99)
    assert raised(spark, [60001])[0]["severity"] == "critical"
    assert raised(spark, [5000]) == []


def test_entropy_alert(spark):
    a = raised(spark, [10] * 10, [0.8] * 9 + [0.3])
    assert [x["attack_type"] for x in a] == ["distributed_entropy"]
    assert raised(spark, [10] * 9, [0.8] * 8 + [0.3]) == []


def test_ratio_rules(spark):
    assert {x["rule"] for x in raised(spark, [20000], syn=0.9, udp=0.75)} == {"volumetric_pps", "syn_flood", "udp_flood"}
    assert raised(spark, [5000], syn=0.9) == []


@pytest.mark.parametrize("n, fires", [(10, False), (11, True)])
def test_zscore_edge(spark, n, fires):
    z = rolling.rolling_zscore(window_rows(spark, [100] * (n - 1) + [9000]), RollingSettings())
    assert z.filter("is_anomaly_packets").count() == int(fires)


def test_blocks_do_not_change_frames(spark):
    w = window_rows(spark, [(i * 37) % 101 for i in range(400)], [1 + (i % 7) / 3 for i in range(400)]).filter("window_start % 35 <> 5")
    a = rolling.rolling_zscore(w, block=64).orderBy("window_start").collect()
    b = rolling.rolling_zscore(w).orderBy("window_start").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x["rolling_mean_packets"] == pytest.approx(y["rolling_mean_packets"])
        assert (x["is_anomaly_packets"], x["is_anomaly_entropy"]) == (y["is_anomaly_packets"], y["is_anomaly_entropy"])


def votes(spark, *items):
    rows = [(5, 0, *v) for v in items]
    schema = "window_size long, window_start long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VOTE.fields)
    return ensemble.collect_votes(spark.createDataFrame(rows, schema))


def test_strategies(spark):
    v = votes(spark, ("threshold", "syn_flood", 0.9, "high", ["a"]), ("ml", "ddos_ml", 0.85, "high", []))
    assert one(ensemble.weighted(v))["attack_type"] == "syn_flood"
    assert one(ensemble.majority(v))["confidence"] == 0.9
    assert ensemble.consensus(v).count() == 0
    both = votes(spark, ("threshold", "x", 0.7, "medium", []), ("ml", "x", 0.8, "critical", ["z"]))
    c = one(ensemble.consensus(both))
    assert (c["confidence"], c["severity"], c["affected_ips"]) == (pytest.approx(0.75), "critical", ["z"])
    assert ensemble.weighted(votes(spark, ("ml", "x", 0.59, "medium", []))).count() == 0


@pytest.mark.parametrize("attack, confidence, want", [(True, 0.9, 0.9), (True, 0.6, 0.72), (False, 0.9, None), (None, None, 0.72)])
def test_hierarchical(spark, attack, confidence, want):
    v = votes(spark, ("threshold", "syn_flood", 0.9, "high", []))
    ml = spark.createDataFrame([(5, 0, attack, confidence)], "window_size long, window_start long, ml_is_attack boolean, ml_confidence double")
    got = ensemble.hierarchical(v, ml if attack is not None else None, EnsembleSettings()).collect()
    assert [g["confidence"] for g in got] == ([] if want is None else [pytest.approx(want)])


def test_flow_direction_and_quirk(spark):
    rows = [(1, 1_000_000, "b", "a", 5, 80, 6, 2, 100), (2, 2_000_000, "a", "b", 80, 5, 6, 18, 40), (3, 3_000_000, "b", "a", 5, 80, 6, 1, 60)]
    p = spark.createDataFrame(rows, "id long, us long, ip_src string, ip_dst string, sport int, dport int, protocol int, tcp_flags int, length int"
                              ).withColumns({"tcp_window": F.lit(10), "udp_len": F.lit(None).cast("int")})
    r = one(flows.flow_records(p, ["id"]))
    assert (r["packets"], r["packets_reverse"], r["bytes"], r["bytes_reverse"]) == (2, 1, 160, 40)
    assert (r["tcp_syn_count"], r["tcp_syn_ack_count"], r["tcp_fin_count"], r["is_complete"]) == (2, 1, 1, True)
    assert r["duration"] == 2.0 and r["packets_per_sec"] == 1.5
    q = one(flows.flow_records(p, ["id"], direction_aware=False))
    assert (q["packets"], q["packets_reverse"], q["total_packets"]) == (3, 0, 3)


def test_delta_reset_and_passthrough(spark):
    rows = [(1, "f", 10, 100), (2, "f", 15, 150), (3, "f", 15, 150), (4, "f", 3, 30), (5, None, 7, 7)]
    s = spark.createDataFrame([(i, T0 + timedelta(seconds=i), f, p, b, 0, 0, 0) for i, f, p, b in rows],
                              "id long, ts timestamp, flow_id string, total_packets long, total_bytes long, tcp_syn_count long, tcp_rst_count long, tcp_fin_count long")
    got = {r["id"]: r["total_packets"] for r in flows.counter_deltas(s, ["id"]).collect()}
    assert got == {1: 10, 2: 5, 4: 3, 5: 7}


def test_counter_texts(spark):
    df = spark.createDataFrame([("3.7",), ("12",), ("-4",), (None,), ("x",)], "x string")
    assert [r[0] for r in df.select(numeric.counter(F.col("x"))).collect()] == [0, 12, 0, 0, 0]


@pytest.mark.parametrize("pps, bps, seconds, want", [(20000, 1e6, 30, True), (20000, 1e6, 10, False), (100, 2e9, 30, True), (100, 1e6, 60, False)])
def test_redirect(spark, pps, bps, seconds, want):
    s = RedirectSettings(min_pps=10000, min_bps=1e9, min_seconds=30)
    assert one(spark.range(1).select(mitigation.should_redirect(F.lit(pps), F.lit(bps), F.lit(seconds), s)))[0] is want


def test_redirect_target_is_exact(spark):
    active = spark.createDataFrame([("x", "10.0.0.10/32", T0)], "redirect_id string, destination_prefix string, started_at timestamp")
    targets = spark.createDataFrame([("10.0.0.1",), ("10.0.0.10",)], "target_ip string")
    assert [r["target_ip"] for r in mitigation.redirect_for(targets, active).collect()] == ["10.0.0.10"]


def timed(spark, seconds, **cols):
    rows = [(i, T0 + timedelta(seconds=s), "k") for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "id long, ts timestamp, key string").withColumns({k: F.lit(v) for k, v in cols.items()})


def test_bucket_and_window(spark):
    df = timed(spark, [0, 0]).withColumn("cost", F.expr("case id when 0 then 50 else 60 end"))
    assert [r["allowed"] for r in rules.replay_token_bucket(df, ["key"], ["id"], 100, 100, "cost").orderBy("id").collect()] == [True, False]
    fifteen = rules.replay_sliding_window(timed(spark, [0] * 15), ["key"], ["id"], 1, 10)
    assert fifteen.filter("allowed").count() == 10
    edge = rules.replay_sliding_window(timed(spark, [0, 1, 1.1]), ["key"], ["id"], 1, 1).orderBy("id").collect()
    assert [r["allowed"] for r in edge] == [True, False, True]


def test_rule_matching(spark):
    made = [rules.limit_ip("ip", "10.0.0.1", T0), rules.limit_subnet("net", "10.0.0.77/8", T0), rules.limit_subnet("wide", "0.0.0.0/1", T0),
            rules.limit_subnet("v6", "2001:db8::/32", T0), rules.limit_protocol("udp", 17, 5, T0, port=53), rules.limit_subnet("bad", "nonsense", T0)]
    rows = [(1, T0, "10.0.0.1", 6, 80), (2, T0, "2001:db8::7", 17, 53), (3, T0, "junk", 17, 53), (4, T0 + timedelta(seconds=301), "10.0.0.1", 6, 80)]
    t = spark.createDataFrame(rows, "id long, ts timestamp, ip_src string, protocol int, dport int")
    got = {(r["id"], r["rule_id"]) for r in rules.match_rules(t, rules.rule_table(spark, made), ipv6=True).collect()}
    assert got == {(1, "ip"), (1, "net"), (1, "wide"), (2, "v6"), (2, "udp"), (3, "udp")}


def test_bandwidth_rule():
    r = rules.limit_bandwidth("b", "1.1.1.1", 8001, T0)
    assert (r[1], r[2], r[3]) == ("byte", 1000.0, 2000.0)


def test_dedup_compares_with_accepted(spark):
    a = timed(spark, [0, 40, 80, 130], attack_type="x", severity="high")
    assert [r["is_duplicate"] for r in alerts.deduplicate(a, ["id"]).orderBy("id").collect()] == [False, True, False, True]


def test_throttle(spark):
    got = alerts.throttle(timed(spark, [0, 5, 10, 15, 20]), ["id"]).orderBy("id").collect()
    assert [r["kept"] for r in got] == [True, False, True, False, True]


def test_routes_and_inhibition(spark):
    a = spark.createDataFrame([(1, T0, "n", "critical"), (2, T0, "n", "high"), (3, T0, "n", "medium"), (4, T0, "m", "high")],
                              "alert_id long, ts timestamp, attack_type string, severity string")
    assert {r["alert_id"] for r in alerts.inhibit(a).collect()} == {1, 4}
    two = [("high", "first", True), ("high", "second", False), ("high", "third", False)]
    assert [(r["alert_id"], r["receiver"]) for r in alerts.route(a.filter("severity <> 'medium'"), two).orderBy("alert_id", "route_order").collect()] == [
        (1, "webhook"), (2, "first"), (2, "second"), (4, "first"), (4, "second")]


def test_privacy(spark):
    df = spark.createDataFrame([("a@b.c@d",), ("plain",), ("",), (None,)], "e string")
    got = [r[0] for r in df.select(privacy.pseudonym_email(F.col("e"))).collect()]
    assert got[0].endswith("@b.c@d") and got[1].endswith("@unknown") and got[2] == "" and got[3] is None
    import hashlib
    want = "pseudonym:" + hashlib.blake2b(b"1.2.3.4s", digest_size=16).hexdigest()
    ips = spark.createDataFrame([("1.2.3.4",), ("",), (None,)], "ip string")
    assert [r[0] for r in ips.select(privacy.pseudonym_ip(F.col("ip"), "s")).collect()] == [want, "", ""]


def test_mask_keeps_empty(spark):
    df = spark.createDataFrame([("1.1.1.1", "", None, "v")], "ip_src string, phone string, email string, other string")
    m = one(governance.mask(df, "s"))
    assert m["ip_src"].startswith("pseudonym:") and (m["phone"], m["email"], m["other"]) == ("", None, "v")


def test_retention_edges(spark):
    now = F.lit(datetime(2024, 3, 1))
    t = spark.createDataFrame([(1, datetime(2024, 2, 20)), (2, datetime(2024, 2, 20) - timedelta(microseconds=1)), (3, None)], "id long, ts timestamp")
    kept, old = governance.split_by_age(t, now, 10)
    assert {r["id"] for r in kept.collect()} == {1, 3} and {r["id"] for r in old.collect()} == {2}


def test_degradation_levels(spark):
    cur = spark.createDataFrame([("a", 0.95), ("b", 0.9499), ("c", 0.89), ("d", 0.79), ("e", 1.1), ("f", 0.5)], "metric_name string, value double")
    ref = spark.createDataFrame([(m, 1.0) for m in "abcde"] + [("f", None), ("g", 1.0)], "metric_name string, value double")
    got = {r["metric_name"]: r["level"] for r in drift.degradation(cur, ref).collect()}
    assert got["b"] == "slight" and got["c"] == "moderate" and got["d"] == "severe" and got["e"] == "none" and set(got) == set("abcde")


def test_addresses(spark):
    df = spark.createDataFrame([("10.0.1.7/24",), ("10.0.1.7",), ("0.0.0.0/0",), ("999.1.1.1/8",), ("2001:db8::/32",)], "c string")
    got = [tuple(r) for r in df.select(net.cidr_low(F.col("c")), net.cidr_high(F.col("c"))).collect()]
    assert got == [(167772416, 167772671), (167772423, 167772423), (0, 4294967295), (None, None), (None, None)]


def test_alert_records(spark):
    a = spark.range(1).select(F.col("id").alias("alert_id"), F.lit("t").alias("title"), F.sequence(F.lit(1), F.lit(30)).cast("array<string>").alias("source_ips"),
                              F.lit(5).alias("extra"))
    r = one(alerts.to_records(a))
    assert len(r["source_ips"]) == 20 and r["details"] == {"extra": "5"}


def test_observed_counts(spark):
    from tidewatch.operators import metrics
    df, seen = metrics.observed(spark.range(10), "x", {"even": F.col("id") % 2 == 0})
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}


def test_rule_capacity(spark):
    made = rules.rule_table(spark, [rules.limit_ip(f"r{i:02d}", "1.1.1.1", T0 + timedelta(seconds=i)) for i in range(25)])
    assert {r["rule_id"] for r in rules.evict_rules(made, 20).collect()} == {"r00", "r01"}
    assert rules.evict_rules(made, 25).count() == 0
    assert rules.oldest_tenth(made, ["created_at"], 5).count() == 1


def test_settings_are_replaceable():
    assert replace(ThresholdSettings(), pps=1.0).pps == 1.0


def test_increase_by_group(spark):
    """Two counters of a group, one with a restart; a sample at a point's instant counts there, one before its range doesn't."""
    rows = [("a", 0, 5), ("a", 60, 9), ("a", 150, 2), ("b", 90, 1), ("b", 120, 4), ("c", 10, 7)]
    samples = spark.createDataFrame([(s, datetime(2024, 1, 1) + timedelta(seconds=t), v, i) for i, (s, t, v) in enumerate(rows)], "s string, ts timestamp, value long, id long")
    got = metrics.increase_by(samples.withColumn("kind", F.lit("x")), ["s"], ["kind"], 120, 60, ["id"])
    base = samples.agg(F.min(F.unix_seconds("ts"))).first()[0]
    # growth: 4 at 60, 3 at 120, 2 at 150 (restart)
    assert {(r["at"] - base, r.increase) for r in got.collect()} == {(60, 4.0), (120, 7.0), (180, 5.0), (240, 2.0)}
    with pytest.raises(ValueError):
        metrics.increase_by(samples, ["s"], [], 100, 60, ["id"])


def test_address_tiers(spark):
    start = datetime(2024, 1, 1)
    rows = [("10.0.0.1", start, 1, 10**9 * 100, None), ("10.0.0.2", start, 1, 10, "GET")] + [("10.0.0.3", start, 1, 1, "GET")] * 300
    flows = spark.createDataFrame(rows, "ip_src string, ts timestamp, packets long, bytes long, http_method string")
    got = {(r.subject, r.metric, r.severity) for r in detect.address_tiers(flows, 1).collect()}
    assert got == {("10.0.0.1", "bps_per_ip", "critical"), ("10.0.0.3", "http_per_ip", "medium")}
    assert detect.address_tiers(flows.drop("bytes", "http_method"), 1).count() == 0
