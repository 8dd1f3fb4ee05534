"""Ordered folds: brute force, chunked against whole, and hot keys through Spark."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ordered as o
from tidewatch.session import written

M = 1_000_000
BASE = 10 ** 15


def brute_spacing(us, gap):
    last, kept = None, []
    for t in us:
        ok = last is None or t - last >= gap
        kept.append(ok)
        last = t if ok else last
    return kept


def brute_sessions(us, closes, idle, active):
    out, start, last, done, n = [], None, None, True, -1
    for t, c in zip(us, closes):
        if done or t - last > idle:
            start, n = t, n + 1
        out.append(n)
        done = bool(c) or t - start > active
        last = t
    return out


def brute_bucket(us, cost, rate, burst):
    level, at, out = burst * M, us[0], []
    for t, c in zip(us, cost):
        level = min(burst * M, level + int(t - at) * rate)
        at = t
        ok = level >= c * M
        level -= c * M if ok else 0
        out.append(ok)
    return out


def brute_window(us, width, limit):
    seen, out = [], []
    for t in us:
        seen = [x for x in seen if x >= t - width]
        ok = len(seen) < limit
        if ok:
            seen.append(t)
        out.append(ok)
    return out


def brute_hits(us, width):
    out, first, n = [], None, 0
    for t in us:
        if first is None or t - first >= width:
            first, n = t, 0
        n += 1
        out.append(n)
    return out


def rows_for(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 150)
    step = rnd.choice([0, 1, 3, 20, 40])
    us = np.cumsum([rnd.randint(0, step) * M // rnd.choice([1, 3]) for _ in range(n)]).astype(np.int64) + BASE
    closes = np.array([rnd.random() < 0.1 for _ in range(n)])
    cost = np.array([rnd.randint(0, 3) for _ in range(n)])
    return rnd, us, closes, cost


def in_chunks(fold, cols, rnd):
    """The chunked evaluation, without Spark: summaries, walk, replay."""
    us, n, cuts = cols["us"], len(cols["us"]), [0]
    while cuts[-1] < n:
        j = min(n, cuts[-1] + rnd.randint(1, 25))
        while j < n and us[j] == us[j - 1]:
            j += 1
        cuts.append(j)
    chunks = [{k: v[a:b] for k, v in cols.items()} for a, b in zip(cuts, cuts[1:])]
    state, entries = [], []
    for chunk in chunks:
        entries.append(list(state))
        summary = fold.summarize(chunk)
        follows = fold.follow(summary, state)
        if fold.run:
            ran = fold.run(chunk, state)
            assert not summary[0] or follows == ran  # a chunk that forgets leaves the same state from any entry
            follows = ran
        state = follows
    parts = [fold.replay(c, e) for c, e in zip(chunks, entries)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


@pytest.mark.parametrize("seed", range(60))
def test_folds(seed):
    rnd, us, closes, cost = rows_for(seed)
    spacing, sessions = o.spacing(30 * M), o.sessions(30 * M, 60 * M)
    bucket, window = o.token_bucket(2, 3, cost="cost"), o.sliding_window(7 * M, 3)
    assert spacing.replay({"us": us}, [])["kept"].tolist() == brute_spacing(us, 30 * M)
    found = sessions.replay({"us": us, "closes": closes}, [])
    names = list(zip(found["session_us"], found["session_part"]))
    want = brute_sessions(us, closes, 30 * M, 60 * M)
    assert [names[i] == names[i - 1] for i in range(1, len(us))] == [want[i] == want[i - 1] for i in range(1, len(us))]
    assert bucket.replay({"us": us, "cost": cost}, [])["allowed"].tolist() == brute_bucket(us, cost, 2, 3)
    assert window.replay({"us": us}, [])["allowed"].tolist() == brute_window(us, 7 * M, 3)
    quota = o.spacing_with_quota(2 * M, 60 * M, 5)
    hits = o.hit_windows(20 * M)
    assert hits.replay({"us": us}, [])["hit"].tolist() == brute_hits(us, 20 * M)
    sided = o.sessions(30 * M, 60 * M, side="side", size="size", last_sizes=4, last_gaps=3)
    packets = {"us": us, "closes": closes, "side": cost > 1, "size": np.where(cost == 2, np.nan, cost.astype(float))}
    whole, cut = sided.replay(packets, []), in_chunks(sided, packets, rnd)
    for name in ("session_us", "session_part", "forward", "gap_us"):
        assert np.array_equal(whole[name], cut[name]), name
    for name in ("late_gap", "late_size"):  # a chunk may keep more, never less
        assert not (whole[name] & ~cut[name]).any()
    for fold, cols in ((spacing, {"us": us}), (sessions, {"us": us, "closes": closes}), (bucket, {"us": us, "cost": cost}),
                       (window, {"us": us}), (quota, {"us": us}), (hits, {"us": us})):
        whole, cut = fold.replay(cols, []), in_chunks(fold, cols, rnd)
        for name in whole:
            assert np.array_equal(whole[name], cut[name]), name


def hot_frame(spark):
    """One key with two thirds of 3000 rows, the others spread."""
    key = F.expr("case when id % 3 < 2 then 'hot' else concat('k', id % 50) end")
    us = F.expr(f"{BASE} + id * 400000 + (id * 7919 % 13) * 100000")
    return spark.range(3000).select("id", key.alias("key"), us.alias("us"), F.expr("id % 4").alias("cost"), F.expr("id % 97 = 0").alias("closes"))


@pytest.mark.parametrize("name", ["spacing", "sessions", "bucket", "window", "quota", "hits"])
def test_hot_key(spark, name):
    fold = {"spacing": o.spacing(3 * M), "sessions": o.sessions(30 * M, 20 * M), "bucket": o.token_bucket(2, 9, cost="cost"),
            "window": o.sliding_window(5 * M, 3), "quota": o.spacing_with_quota(2 * M, 60 * M, 7), "hits": o.hit_windows(20 * M)}[name]
    df = hot_frame(spark)
    assert o.hot_keys(df, ["key"], 200).count() == 1
    assert o.hot_slots(df, ["key"], "us", 200).select("_chunk").distinct().count() >= 9
    cut = o.run_fold(df, ["key"], ["us", "id"], fold, chunk_rows=200)
    whole = o.run_fold(df, ["key"], ["us", "id"], fold)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_hot_flow_records(spark):
    """A flow with most of the packets gives the same records cut into chunks."""
    from tidewatch.operators import flows
    p = spark.range(2500).select(
        "id", F.expr(f"{BASE} + id * 300000 + (id * 7919 % 11) * 100000").alias("us"),
        F.expr("case when id % 5 = 0 then 'b' else 'a' end").alias("ip_src"), F.expr("case when id % 5 = 0 then 'a' else 'b' end").alias("ip_dst"),
        F.expr("case when id % 7 = 3 then id % 90 else 5 end").cast("int").alias("sport"), F.lit(5).alias("dport"), F.lit(6).alias("protocol"),
        F.expr("60 + id % 40").alias("length"), F.expr("cast(case when id % 701 = 0 then 1 else 2 end as int)").alias("tcp_flags"),
        F.expr("cast(id % 300 as int)").alias("tcp_window"), F.lit(None).cast("int").alias("udp_len"))
    p = p.withColumn("sport", F.when(F.col("ip_src") == "b", 5).otherwise(F.col("sport"))).withColumn("dport", F.lit(5))

    def rounded(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())

    cut, whole = flows.flow_records(p, ["id"], chunk_rows=150), flows.flow_records(p, ["id"])
    assert rounded(cut) == rounded(whole) and whole.count() > 10


def test_hot_lag(spark):
    df = hot_frame(spark)
    cut = o.lag_by_chunks(df, ["key"], ["us", "id"], ["id"], chunk_rows=200)
    whole = o.lag_by_chunks(df, ["key"], ["us", "id"], ["id"])
    key = lambda r: r["id"]
    assert sorted(cut.collect(), key=key) == sorted(whole.collect(), key=key)


def test_groups_over_batches(spark):
    """Groups cut by Arrow batch edges stay whole."""
    df = hot_frame(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        small = o.run_fold(df, ["key"], ["us", "id"], o.spacing(3 * M)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, small)) == sorted(map(tuple, o.run_fold(df, ["key"], ["us", "id"], o.spacing(3 * M)).collect()))


def test_sessions_of_one_microsecond(spark):
    """Every closing packet of one microsecond is a session of its own."""
    fold = o.sessions(30 * M, 60 * M)
    df = spark.range(1200).select("id", F.lit("k").alias("key"), F.lit(BASE).alias("us"), F.lit(True).alias("closes"))
    found = o.run_fold(df, ["key"], ["us", "id"], fold)
    assert found.select("session_us", "session_part").distinct().count() == 1200


def test_dense_second(spark):
    """A second with more rows than a chunk is cut below the second."""
    df = spark.range(4000).select("id", F.lit("k").alias("key"), F.expr(f"{BASE} + id * 700 + (id div 1500) * 5").alias("us"))
    slots = o.hot_slots(df, ["key"], "us", 300)
    assert slots.select("_chunk").distinct().count() >= 12
    fold = o.sliding_window(100_000, 20)
    cut, whole = (o.run_fold(df, ["key"], ["us", "id"], fold, chunk_rows=n) for n in (300, 10_000))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def brute_level(level, refill, cost, full):
    for d, c in zip(refill.tolist(), cost.tolist()):
        level = min(full, level + d)
        level -= c if level >= c else 0
    return level


@pytest.mark.parametrize("seed", range(40))
def test_bucket_maps(seed, monkeypatch):
    """The map of a chunk at every level, whatever way its rows are grouped."""
    rnd = np.random.RandomState(seed)
    full, n = int(rnd.choice([1, 7, 30, 100])), int(rnd.randint(1, 70))
    refill, cost = rnd.randint(0, rnd.choice([2, 9, 40]), n).astype(np.int64), rnd.randint(0, rnd.choice([2, 12, 120]), n).astype(np.int64)
    for block in (1, 3, 1 << 16):
        monkeypatch.setattr(o, "BLOCK_ROWS", block)
        found = o.bucket_map(np.minimum(refill, full), cost, full)
        levels = np.arange(full + 1)
        at = np.searchsorted(found.start, levels, side="right") - 1
        assert (levels * found.slope[at] + found.value[at]).tolist() == [brute_level(x, refill, cost, full) for x in levels.tolist()]


def test_bucket_map_stays_short():
    """A flooded chunk's map has a few pieces a token of the bucket, not one a row."""
    rnd = np.random.RandomState(1)
    n, full = 200_000, 50 * M
    t = np.sort(rnd.randint(0, 100 * M, n)).astype(np.int64)
    found = o.bucket_map(np.diff(t, prepend=t[0]) * 20, np.full(n, M, np.int64), full)
    assert len(found.start) <= 4 * 50


@pytest.mark.parametrize("name", ["bucket", "window", "quota"])
@pytest.mark.parametrize("busy", [False, True])
def test_many_chunks(spark, monkeypatch, name, busy):
    """About 2,000 chunks of one key, with pauses and without any: the rows are read once to be written, and twice after."""
    fold = {"bucket": o.token_bucket(2, 9), "window": o.sliding_window(30 * M, 4), "quota": o.spacing_with_quota(2 * M, 100 * M, 7)}[name]
    pauses = "" if busy else " + (id div 150) * 200000000"
    df = spark.range(4000).select("id", F.lit("k").alias("key"), F.expr(f"{BASE} + id * 300000 + (id * 7919 % 13) * 10000{pauses}").alias("us"))
    tables = []
    monkeypatch.setattr(o, "written", lambda rows, name: tables.append(name) or written(rows, name))
    cut = o.run_fold(df, ["key"], ["us", "id"], fold, chunk_rows=2)
    got = [r[-1] for r in cut.orderBy("us", "id").collect()]
    us = [r.us for r in df.orderBy("us", "id").collect()]
    assert got == fold.replay({"us": np.array(us)}, [])[cut.columns[-1]].tolist() and tables.count("hot-rows") == 1
    if name != "quota":
        assert got == (brute_bucket(us, [1] * len(us), 2, 9) if name == "bucket" else brute_window(us, 30 * M, 4))


def test_chunks_that_forget():
    """After a pause, and with fewer arrivals than the limit, the exit is the same from any entry; in a flood it is not."""
    slow, flood = np.arange(100) * 10 * M + BASE, np.arange(100) * M // 10 + BASE
    paused = np.r_[flood[:50], flood[50:] + 40 * M]
    for fold in (o.sliding_window(30 * M, 5), o.spacing_with_quota(2 * M, 30 * M, 5)):
        assert [fold.summarize({"us": t})[0] for t in (slow, flood, paused)] == [1, 0, 1]


def test_quota_that_cannot_bind():
    rnd = random.Random(3)
    us = np.cumsum([rnd.randint(0, 4) * M for _ in range(300)]).astype(np.int64) + BASE
    fold = o.spacing_with_quota(10 * M, 60 * M, 6)
    assert not fold.run and fold.replay({"us": us}, [])["kept"].tolist() == brute_spacing(us, 10 * M)
