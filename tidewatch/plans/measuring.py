"""Metric roll-ups, evaluation, drift, exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.net import label_safe
from ..functions.numeric import r6
from ..operators import drift, eda, evaluate, metrics, rolling, windows
from ..operators.running import exact_quantiles
from ..session import fresh_path
from ..sources import events as src
from .base import ctes, query
from .base import r6 as q6
from .windows import features, stored

COLUMNS = ["packets", "bytes", "k", "avg_packet_size"]


@query("metric_counters", ctes("alerts") + """
    SELECT 'detections' AS name, attack_type, severity, count(*)::DOUBLE AS value FROM alerts GROUP BY ALL""")
def metric_counters(spark, sf_dir):
    c = metrics.counters(src.alerts(spark, sf_dir), "detections", ["attack_type", "severity"])
    return c.select("name", F.col("labels")["attack_type"].alias("attack_type"), F.col("labels")["severity"].alias("severity"), "value")


@query("metric_bytes", ctes("flows") + """
    SELECT 'bytes' AS name, CAST(protocol AS VARCHAR) AS protocol, sum(bytes)::DOUBLE AS value FROM flows GROUP BY ALL""")
def metric_bytes(spark, sf_dir):
    c = metrics.counters(src.flows(spark, sf_dir), "bytes", ["protocol"], F.col("bytes"))
    return c.select("name", F.col("labels")["protocol"].alias("protocol"), "value")


@query("metric_gauges", ctes("flows") + """
    SELECT ip_src, arg_max(packets, (us, event_id)) AS packets, arg_max(bytes, (us, event_id)) AS bytes FROM flows GROUP BY 1""")
def metric_gauges(spark, sf_dir):
    return metrics.gauges(src.flows(spark, sf_dir), ["ip_src"], ["packets", "bytes"], tie=["event_id"])


@query("metric_top_sources", ctes("flows") + """
    SELECT replace(ip_src, '.', '_') AS label, sum(packets)::BIGINT AS weight FROM flows GROUP BY ip_src ORDER BY weight DESC, ip_src LIMIT 10""")
def metric_top_sources(spark, sf_dir):
    counts = src.flows(spark, sf_dir).groupBy("ip_src").agg(F.sum("packets").alias("weight"))
    return metrics.top_source_gauges(counts)


@query("metric_custom", ctes("flows") + "SELECT 'peak_bytes' AS name, CAST(dport AS VARCHAR) AS dport, max(bytes)::DOUBLE AS value FROM flows GROUP BY ALL")
def metric_custom(spark, sf_dir):
    c = metrics.custom(src.flows(spark, sf_dir), "peak_bytes", ["dport"], F.max("bytes"))
    return c.select("name", F.col("labels")["dport"].alias("dport"), "value")


BOUND_SQL = ", ".join(str(float(b)) for b in metrics.PACKET_SIZE_BOUNDS)


@query("metric_hist", ctes("flows", extra={"b": f"SELECT unnest([{BOUND_SQL}, 'Infinity'::DOUBLE]) AS le"}) + """
    SELECT protocol, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, count(*) FILTER (avg_packet_size <= le) AS n, sum(avg_packet_size) AS total FROM flows, b GROUP BY protocol, le""")
def metric_hist(spark, sf_dir):
    h = metrics.histogram(src.flows(spark, sf_dir), ["protocol"], F.col("avg_packet_size"), metrics.PACKET_SIZE_BOUNDS)
    return h.select("protocol", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "n", F.col("sum").alias("total"))


@query("metric_max_1m", ctes("flows") + """
    SELECT event_id, max(packets) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS peak FROM flows""")
def metric_max_1m(spark, sf_dir):
    samples = src.flows(spark, sf_dir).select("event_id", "user_id", "ts", "packets")
    return metrics.over_time(samples, ["user_id"], F.max, 86400, "peak", "packets").select("event_id", "peak")


RATE = {"l": "SELECT *, lag(total_packets) OVER (PARTITION BY flow_id ORDER BY us, event_id) AS p FROM snapshots",
        "st": "SELECT *, CASE WHEN p IS NULL THEN 0 WHEN total_packets < p THEN total_packets ELSE total_packets - p END AS step FROM l"}


@query("metric_rate", ctes("snapshots", extra=RATE) + f"""
    SELECT event_id, (sum(step) OVER w)::DOUBLE AS increase, {q6('(sum(step) OVER w) / 43200.0::DOUBLE')} AS rate FROM st
    WINDOW w AS (PARTITION BY flow_id ORDER BY us RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW)""")
def metric_rate(spark, sf_dir):
    snaps = src.snapshots_from(src.flows(spark, sf_dir)).select("event_id", "flow_id", "ts", F.col("total_packets").alias("value"))
    r = metrics.increase(snaps, ["flow_id"], 43200, ["event_id"])
    return r.select("event_id", "increase", r6("rate").alias("rate"))


@query("sustained_alert", ctes("totals", extra={
    "h": "SELECT window_size, window_start, total_packets / window_size::DOUBLE AS v, row_number() OVER (PARTITION BY window_size ORDER BY window_start) AS a FROM totals",
    "i": "SELECT *, a - row_number() OVER (PARTITION BY window_size ORDER BY window_start) AS run FROM h WHERE v > 0.1",
    "r": "SELECT window_size, min(window_start) AS starts, max(window_start) AS ends, count(*) AS samples FROM i GROUP BY window_size, run"}) + """
    SELECT window_size, starts, ends, samples FROM r WHERE ends - starts >= 7200""")
def sustained_alert(spark, sf_dir):
    t = stored(windows.rates(windows.window_totals(src.flows(spark, sf_dir), [3600, 21600, 86400])))
    samples = t.select("window_size", F.timestamp_seconds("window_start").alias("ts"), F.col("packets_per_second").alias("value"))
    s = metrics.sustained(samples, ["window_size"], F.col("value") > 0.1, 7200, [], chunk_seconds=86400)
    return s.select("window_size", F.unix_seconds("starts").alias("starts"), F.unix_seconds("ends").alias("ends"), "samples")


@query("metric_by_type_1h", ctes("alerts") + """
    SELECT attack_type, us // 3600000000 AS hour, count(*) AS alerts, sum(packets)::BIGINT AS packets FROM alerts GROUP BY ALL""")
def metric_by_type_1h(spark, sf_dir):
    a = src.alerts(spark, sf_dir)
    return a.groupBy("attack_type", F.expr("unix_micros(ts) div 3600000000").alias("hour")).agg(F.count("*").alias("alerts"), F.sum("packets").alias("packets"))


@query("operator_counters", ctes("flows") + """
    SELECT count(*) AS rows, count(*) FILTER (packets <= 50) AS allowed, count(*) FILTER (packets > 50) AS limited, count(*) FILTER (dport = 0) AS errors FROM flows""")
def operator_counters(spark, sf_dir):
    over = F.col("packets") > 50
    rows, seen = metrics.observed(src.flows(spark, sf_dir), "limiter", {"allowed": ~over, "limited": over, "errors": F.col("dport") == 0})
    rows.filter(~over).write.format("noop").mode("overwrite").save()  # counted while the rows go on to their sink
    return spark.createDataFrame([seen.get], "rows bigint, allowed bigint, limited bigint, errors bigint")


@query("reference_snapshot", ctes("flows") + """
    SELECT event_id, packets, bytes, (SELECT count(*)::DOUBLE FROM flows WHERE is_attack = 0) AS normal_rows FROM flows WHERE is_attack = 0""")
def reference_snapshot(spark, sf_dir):
    normal, path = src.flows(spark, sf_dir).filter("is_attack = 0"), fresh_path(spark, "reference")
    drift.reference_snapshot(normal, ["event_id", "packets", "bytes"], normal.agg(F.count("*").cast("double").alias("normal_rows")), path)
    kept = spark.read.parquet(f"{path}/features")
    return kept.withColumn("normal_rows", F.lit(spark.read.parquet(f"{path}/metrics").first()[0]))


@query("metric_actions_increase_1h", ctes("snapshots", extra=RATE) + """
    SELECT CASE CAST(substr(flow_id, 2) AS BIGINT) % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'rate_limit' ELSE 'notify' END AS action_type,
      ((us + 899999999) // 900000000 + i) * 900 AS at, sum(step)::DOUBLE AS increase
    FROM st, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE p IS NOT NULL GROUP BY ALL""")
def metric_actions_increase_1h(spark, sf_dir):
    snaps = src.snapshots_from(src.flows(spark, sf_dir)).select("event_id", "flow_id", "ts", F.col("total_packets").alias("value"))
    kind = F.expr("case cast(substr(flow_id, 2) as bigint) % 3 when 0 then 'block' when 1 then 'rate_limit' else 'notify' end")
    return metrics.increase_by(snaps.withColumn("action_type", kind), ["flow_id"], ["action_type"], 3600, 900, ["event_id"])


@query("metric_topk", ctes("flows", extra={"g": "SELECT user_id, arg_max(packets, (us, event_id)) AS value FROM flows GROUP BY 1"}) + "SELECT user_id, value FROM g ORDER BY value DESC, user_id LIMIT 10")
def metric_topk(spark, sf_dir):
    f = src.flows(spark, sf_dir).select("user_id", "event_id", "ts", F.col("packets").alias("value"))
    return metrics.top_series(f, ["user_id"], 10, tie=["event_id"])


@query("label_safe", ctes("flows") + "SELECT event_id, replace(ip_src, '.', '_') AS label FROM flows")
def label_names(spark, sf_dir):
    return src.flows(spark, sf_dir).select("event_id", label_safe(F.col("ip_src")).alias("label"))


# ---- evaluation and drift ---------------------------------------------------------------------

@query("confusion", ctes("scored") + """
    SELECT count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
      count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp FROM scored""")
def confusion(spark, sf_dir):
    return evaluate.confusion(src.scored(spark, sf_dir))


DAILY = """SELECT us // 86400000000 AS batch, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
      count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp FROM scored GROUP BY 1"""


def daily(spark, sf_dir):
    s = src.scored(spark, sf_dir).withColumn("batch", F.expr("unix_micros(ts) div 86400000000"))
    return stored(evaluate.rates(evaluate.confusion(s, ["batch"])))


@query("clf_metrics", ctes("scored", extra={"c": DAILY}) + f"""
    SELECT batch, {q6('(tp + tn) / (tp + tn + fp + fn)::DOUBLE')} AS accuracy, {q6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END')} AS precision,
      {q6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END')} AS recall, {q6('CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END')} AS f1_score,
      {q6('CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END')} AS fpr, {q6('CASE WHEN fn + tp > 0 THEN fn / (fn + tp)::DOUBLE ELSE 0 END')} AS fnr FROM c""")
def clf_metrics(spark, sf_dir):
    return daily(spark, sf_dir).select("batch", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1_score", "fpr", "fnr")])


AUC = {"sc": "SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1",
       "cu": "SELECT *, sum(neg) OVER (ORDER BY score) AS cn, sum(pos) OVER (ORDER BY score DESC) AS dp, sum(neg) OVER (ORDER BY score DESC) AS dn FROM sc"}


@query("roc_auc", ctes("scored", extra=AUC) + f"SELECT {q6('sum(pos * (cn - neg + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))')} AS auc_roc FROM cu")
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(src.scored(spark, sf_dir)).select(r6("auc_roc").alias("auc_roc"))


@query("roc_curve", ctes("scored", extra=AUC) + f"""
    SELECT {q6('score')} AS threshold, {q6('dp / (SELECT sum(pos) FROM sc)::DOUBLE')} AS tpr, {q6('dn / (SELECT sum(neg) FROM sc)::DOUBLE')} AS fpr FROM cu""")
def roc_curve(spark, sf_dir):
    return evaluate.roc_curve(src.scored(spark, sf_dir)).select(*[r6(c).alias(c) for c in ("threshold", "tpr", "fpr")])


@query("model_comparison", ctes("scored", extra={
    "m": "SELECT 'low' AS model, score, label, CAST(score >= 0.5 AS INT) AS pred FROM scored UNION ALL SELECT 'high', score * score, label, CAST(score >= 0.9 AS INT) FROM scored",
    "c": "SELECT model, sum(pred * label) AS tp, sum(pred) AS p, sum(label) AS y, count(*) AS n, sum((pred = label)::INT) AS ok FROM m GROUP BY 1"}) + f"""
    SELECT model, {q6('ok / n::DOUBLE')} AS accuracy, {q6('2 * tp / (p + y)::DOUBLE')} AS f1_score FROM c""")
def model_comparison(spark, sf_dir):
    return models(spark, sf_dir).select("model", r6("accuracy").alias("accuracy"), r6("f1_score").alias("f1_score"))


def models(spark, sf_dir):
    s = src.scored(spark, sf_dir)
    low = s.select(F.lit("low").alias("model"), "score", "label", (F.col("score") >= 0.5).cast("int").alias("pred"))
    high = s.select(F.lit("high").alias("model"), (F.col("score") * F.col("score")).alias("score"), "label", (F.col("score") >= 0.9).cast("int").alias("pred"))
    return evaluate.comparison(low.unionByName(high))


@query("best_model", ctes("scored", extra={
    "m": "SELECT 'low' AS model, label, CAST(score >= 0.5 AS INT) AS pred FROM scored UNION ALL SELECT 'high', label, CAST(score >= 0.9 AS INT) FROM scored",
    "c": "SELECT model, 2 * sum(pred * label) / (sum(pred) + sum(label))::DOUBLE AS f1 FROM m GROUP BY 1"}) + f"SELECT arg_max(model, f1) AS model, {q6('max(f1)')} AS f1_score FROM c")
def best_model(spark, sf_dir):
    return evaluate.best_model(models(spark, sf_dir)).select("model", r6("f1_score").alias("f1_score"))


@query("class_counts", ctes("scored") + "SELECT label, count(*) AS rows FROM scored GROUP BY 1")
def class_counts(spark, sf_dir):
    return evaluate.class_counts(src.scored(spark, sf_dir))


@query("labelled_union", ctes("flows") + """
    SELECT CASE WHEN protocol = 17 THEN 1 ELSE 0 END AS label, count(*) AS rows, sum(packets)::BIGINT AS packets FROM flows GROUP BY 1""")
def labelled_union(spark, sf_dir):
    f = src.flows(spark, sf_dir).select("protocol", "packets")
    both = eda.labelled(f.filter("protocol <> 17"), f.filter("protocol = 17"), "label")
    return both.groupBy("label").agg(F.count("*").alias("rows"), F.sum("packets").alias("packets"))


@query("metric_snapshot", ctes("alerts") + """
    SELECT 'alerts' AS name, severity AS label, count(*)::DOUBLE AS value FROM alerts GROUP BY 2
    UNION ALL SELECT 'packets', attack_type, sum(packets)::DOUBLE FROM alerts GROUP BY 2""")
def metric_snapshot(spark, sf_dir):
    """Two metric families written as one snapshot and read back."""
    a = src.alerts(spark, sf_dir)
    path = fresh_path(spark, "metrics")
    families = [metrics.counters(a, "alerts", ["severity"]), metrics.counters(a, "packets", ["attack_type"], F.col("packets"))]
    metrics.export_snapshot(families, path, F.timestamp_seconds(F.lit(MIDDLE)), 0)
    return spark.read.parquet(path).select("name", F.map_values("labels")[0].alias("label"), "value")


@query("corr_matrix", ctes("flows", extra={"p": " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {'1.0' if a == b else f'corr({a}, {b})'} AS r FROM flows" for a in COLUMNS for b in COLUMNS)}) + f"SELECT a, b, {q6('any_value(r)')} AS r FROM p GROUP BY a, b")
def corr_matrix(spark, sf_dir):
    return eda.correlation_matrix(src.flows(spark, sf_dir), COLUMNS).select("a", "b", r6("r").alias("r"))


@query("corr_label", ctes("flows", extra={"p": " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, is_attack) AS r FROM flows" for c in COLUMNS)}) + f"SELECT feature, {q6('r')} AS r FROM p")
def corr_label(spark, sf_dir):
    return eda.label_correlation(src.flows(spark, sf_dir), COLUMNS, "is_attack").select("feature", r6("r").alias("r"))


LONG = " UNION ALL ".join(f"SELECT is_attack, '{c}' AS feature, {c}::DOUBLE AS value FROM flows" for c in COLUMNS)


@query("iqr_outliers", ctes("flows", extra={"l": LONG,
    "q": "SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM l WHERE is_attack = 0 GROUP BY 1"}) + f"""
    SELECT feature, {q6('any_value(a - 1.5 * (b - a))')} AS lower, {q6('any_value(b + 1.5 * (b - a))')} AS upper, count(*) AS rows,
      count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers FROM l JOIN q USING (feature) WHERE is_attack = 1 GROUP BY 1""")
def iqr_outliers(spark, sf_dir):
    o = eda.iqr_outliers(src.flows(spark, sf_dir), COLUMNS, label="is_attack")
    return o.select("feature", r6("lower").alias("lower"), r6("upper").alias("upper"), "rows", "outliers")


@query("quantiles", ctes("flows") + f"""
    SELECT protocol, {q6('quantile_cont(packets, 0.5)')} AS q0, {q6('quantile_cont(packets, 0.95)')} AS q1, {q6('quantile_cont(packets, 1.0)')} AS q2 FROM flows GROUP BY 1""")
def quantiles(spark, sf_dir):
    q = exact_quantiles(src.flows(spark, sf_dir), ["protocol"], "packets", [0.5, 0.95, 1.0])
    return q.select("protocol", *[r6(c).alias(c) for c in ("q0", "q1", "q2")])


@query("histogram", ctes("flows", extra={"e": "SELECT is_attack, min(packets) AS lo, max(packets) AS hi, count(*) AS n FROM flows GROUP BY 1"}) + f"""
    SELECT is_attack, least(49, CAST(floor((packets - lo) / (hi - lo)::DOUBLE * 50) AS INT)) AS bin, count(*) AS rows,
      {q6('count(*) / (any_value(n) * ((any_value(hi) - any_value(lo)) / 50.0::DOUBLE))')} AS density
    FROM flows JOIN e USING (is_attack) GROUP BY 1, 2""")
def histogram(spark, sf_dir):
    h = eda.histogram(src.flows(spark, sf_dir), ["is_attack"], "packets")
    return h.select("is_attack", "bin", "rows", r6("density").alias("density"))


@query("score_stats", ctes("scored") + f"""
    SELECT {q6('avg(score)')} AS mean, {q6('stddev_pop(score)')} AS std, {q6('min(score)')} AS min, {q6('max(score)')} AS max, {q6('quantile_cont(score, 0.95)')} AS p95 FROM scored""")
def score_stats(spark, sf_dir):
    s = eda.score_statistics(src.scored(spark, sf_dir), "score")
    return s.select(*[r6(c).alias(c) for c in ("mean", "std", "min", "max", "p95")])


MIDDLE = 1705320000
DRIFT = {"l": " UNION ALL ".join(f"SELECT us >= {MIDDLE}000000 AS cur, '{c}' AS feature, {c}::DOUBLE AS value FROM flows" for c in COLUMNS),
         "n": "SELECT feature, value, count(*) FILTER (NOT cur) AS a, count(*) FILTER (cur) AS b FROM l GROUP BY ALL",
         "c": """SELECT feature, value, sum(a) OVER w / (sum(a) OVER p)::DOUBLE AS ca, sum(b) OVER w / (sum(b) OVER p)::DOUBLE AS cb,
           lead(value) OVER w - value AS gap FROM n WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)"""}


def shift(spark, sf_dir):
    """With the asymptotic p-value at every size, as the SQL has it."""
    f = src.flows(spark, sf_dir)
    edge = F.timestamp_seconds(F.lit(MIDDLE))
    return drift.covariate_shift(f.filter(F.col("ts") < edge), f.filter(F.col("ts") >= edge), COLUMNS, exact_rows=0)


@query("ks_drift", ctes("flows", extra={**DRIFT, "k": "SELECT feature, max(abs(ca - cb)) AS ks FROM c GROUP BY 1"}) + f"""
    SELECT feature, {q6('ks')} AS ks_statistic, ks > 0.05 AS drifted, CASE WHEN ks < 0.05 THEN 'low' WHEN ks < 0.15 THEN 'medium' ELSE 'high' END AS severity FROM k""")
def ks_drift(spark, sf_dir):
    return shift(spark, sf_dir).select("feature", r6("ks_statistic").alias("ks_statistic"), "drifted", "severity")


PLANTED = {COLUMNS[0]: 3.0, COLUMNS[1]: 1.3}


@query("drift_planted", ctes("flows", extra={**DRIFT, "l": " UNION ALL ".join(
    f"SELECT us >= {MIDDLE}000000 AS cur, '{c}' AS feature, {c}::DOUBLE * CASE WHEN us >= {MIDDLE}000000 THEN {PLANTED.get(c, 1.0)}::DOUBLE ELSE 1 END AS value FROM flows" for c in COLUMNS),
    "k": "SELECT feature, max(abs(ca - cb)) AS ks FROM c GROUP BY 1"}) + f"""
    SELECT feature, {q6('ks')} AS ks_statistic, ks > 0.05 AS drifted, CASE WHEN ks < 0.05 THEN 'low' WHEN ks < 0.15 THEN 'medium' ELSE 'high' END AS severity FROM k""")
def drift_planted(spark, sf_dir):
    """Two features grow in the second half, so that drift is found and graded."""
    f, edge = src.flows(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in COLUMNS}), F.timestamp_seconds(F.lit(MIDDLE))
    current = f.filter(F.col("ts") >= edge).withColumns({c: F.col(c) * k for c, k in PLANTED.items()})
    out = drift.covariate_shift(f.filter(F.col("ts") < edge), current, COLUMNS)
    return out.select("feature", r6("ks_statistic").alias("ks_statistic"), "drifted", "severity")


@query("wasserstein", ctes("flows", extra=DRIFT) + f"SELECT feature, {q6('sum(abs(ca - cb) * coalesce(gap, 0))')} AS wasserstein FROM c GROUP BY 1")
def wasserstein(spark, sf_dir):
    return shift(spark, sf_dir).select("feature", r6("wasserstein").alias("wasserstein"))


REFERENCE = {"accuracy": 0.8, "precision": 0.5, "recall": 0.9, "f1_score": 0.62, "specificity": 0.9}


@query("degradation", ctes("scored", extra={
    "c": "SELECT count(*) AS n, sum(pred * label) AS tp, sum(pred) AS p, sum(label) AS y, sum((pred = label)::INT) AS ok FROM scored",
    "v": """SELECT 'accuracy' AS metric_name, ok / n::DOUBLE AS cur, 0.8::DOUBLE AS ref FROM c UNION ALL SELECT 'precision', tp / p::DOUBLE, 0.5 FROM c
      UNION ALL SELECT 'recall', tp / y::DOUBLE, 0.9 FROM c UNION ALL SELECT 'f1_score', 2 * tp / (p + y)::DOUBLE, 0.62 FROM c""",
    "r": "SELECT *, (cur - ref) / ref AS rel FROM v"}) + f"""
    SELECT metric_name, {q6('cur')} AS current_value, {q6('rel')} AS relative_change, rel < 0 AS degraded,
      CASE WHEN rel < -0.2 THEN 'severe' WHEN rel < -0.1 THEN 'moderate' WHEN rel < -0.05 THEN 'slight' ELSE 'none' END AS level FROM r""")
def degradation(spark, sf_dir):
    table = evaluate.rates(evaluate.confusion(src.scored(spark, sf_dir)))
    current = evaluate.metric_rows(table, [], ["accuracy", "precision", "recall", "f1_score", "fpr"])
    reference = spark.createDataFrame(list(REFERENCE.items()), "metric_name string, value double")
    d = drift.degradation(current, reference)
    return d.select("metric_name", r6("current_value").alias("current_value"), r6("relative_change").alias("relative_change"), "degraded", "level")


@query("concept_drift", ctes("scored", extra={
    "recent": "SELECT * FROM scored ORDER BY us DESC, event_id DESC LIMIT 1000",
    "x": "SELECT count(*) AS n, count(*) FILTER (label = 0 AND pred = 1) / count(*) FILTER (label = 0)::DOUBLE AS fpr, count(*) FILTER (label = 1 AND pred = 0) / count(*) FILTER (label = 1)::DOUBLE AS fnr FROM recent",
    "y": "SELECT count(*) FILTER (label = 0 AND pred = 1) / count(*) FILTER (label = 0)::DOUBLE AS fpr, count(*) FILTER (label = 1 AND pred = 0) / count(*) FILTER (label = 1)::DOUBLE AS fnr FROM scored"}) + f"""
    SELECT {q6('x.fpr')} AS current_fpr, {q6('y.fpr')} AS reference_fpr, {q6('x.fnr')} AS current_fnr, {q6('y.fnr')} AS reference_fnr,
      n >= 1000 AND (abs(x.fpr - y.fpr) > 0.1 OR abs(x.fnr - y.fnr) > 0.1) AS drift FROM x, y""")
def concept_drift(spark, sf_dir):
    s = src.scored(spark, sf_dir)
    c = drift.concept_drift(s, s, ["ts", "event_id"])
    return c.select(*[r6(x).alias(x) for x in ("current_fpr", "reference_fpr", "current_fnr", "reference_fnr")], "drift")


@query("concept_drift_planted", ctes("scored", extra={
    "q": "SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 ELSE pred END AS now FROM scored",
    "recent": "SELECT * FROM q ORDER BY us DESC, event_id DESC LIMIT 1000",
    "x": "SELECT count(*) AS n, count(*) FILTER (label = 0 AND now = 1) / count(*) FILTER (label = 0)::DOUBLE AS fpr, count(*) FILTER (label = 1 AND now = 0) / count(*) FILTER (label = 1)::DOUBLE AS fnr FROM recent",
    "y": "SELECT count(*) FILTER (label = 0 AND pred = 1) / count(*) FILTER (label = 0)::DOUBLE AS fpr, count(*) FILTER (label = 1 AND pred = 0) / count(*) FILTER (label = 1)::DOUBLE AS fnr FROM scored"}) + f"""
    SELECT {q6('x.fpr')} AS current_fpr, {q6('y.fpr')} AS reference_fpr, {q6('x.fnr')} AS current_fnr, {q6('y.fnr')} AS reference_fnr,
      n >= 1000 AND (abs(x.fpr - y.fpr) > 0.1 OR abs(x.fnr - y.fnr) > 0.1) AS drift FROM x, y""")
def concept_drift_planted(spark, sf_dir):
    """A third of the current predictions say attack whatever the score."""
    s = src.scored(spark, sf_dir)
    c = drift.concept_drift(s.withColumn("pred", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("pred"))), s, ["ts", "event_id"])
    return c.select(*[r6(x).alias(x) for x in ("current_fpr", "reference_fpr", "current_fnr", "reference_fnr")], "drift")


CHECKS = {"c": DAILY, "p": "SELECT batch, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy FROM c",
          "k": """SELECT batch, 'fpr' AS feature, fp / nullif(fp + tn, 0)::DOUBLE > 0.28 AS drifted FROM c UNION ALL
            SELECT batch, 'fnr', fn / nullif(fn + tp, 0)::DOUBLE > 0.62 FROM c""",
          "ids": "SELECT batch FROM c ORDER BY batch DESC LIMIT 10"}


def checks(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d, d.select("batch", F.explode(F.array(F.struct(F.lit("fpr").alias("feature"), (F.col("fpr") > 0.28).alias("drifted")),
                                                  F.struct(F.lit("fnr").alias("feature"), (F.col("fnr") > 0.62).alias("drifted")))).alias("x")).select("batch", "x.*")


@query("retrain", ctes("scored", extra=CHECKS) + f"""
    SELECT {q6('dr')} AS drift_ratio, {q6('acc')} AS recent_accuracy, dr > 0.3 OR (0.9 - acc) / 0.9 > 0.3 AS retrain
    FROM (SELECT count(*) FILTER (drifted) / count(*)::DOUBLE AS dr FROM k WHERE batch IN (FROM ids)), (SELECT avg(accuracy) AS acc FROM p WHERE batch IN (FROM ids))""")
def retrain(spark, sf_dir):
    d, k = checks(spark, sf_dir)
    out = drift.should_retrain(k, d.select("batch", "accuracy"), 0.9)
    return out.select(r6("drift_ratio").alias("drift_ratio"), r6("recent_accuracy").alias("recent_accuracy"), "retrain")


@query("retrain_planted", ctes("scored", extra=CHECKS) + f"""
    SELECT {q6('dr')} AS drift_ratio, {q6('acc')} AS recent_accuracy, dr > 0.3 OR (1.5 - acc) / 1.5 > 0.3 AS retrain
    FROM (SELECT count(*) FILTER (drifted) / count(*)::DOUBLE AS dr FROM k WHERE batch IN (FROM ids)), (SELECT avg(accuracy) AS acc FROM p WHERE batch IN (FROM ids))""")
def retrain_planted(spark, sf_dir):
    """A reference accuracy that no batch reaches."""
    d, k = checks(spark, sf_dir)
    out = drift.should_retrain(k, d.select("batch", "accuracy"), 1.5)
    return out.select(r6("drift_ratio").alias("drift_ratio"), r6("recent_accuracy").alias("recent_accuracy"), "retrain")


@query("drift_summary", ctes("scored", extra={**CHECKS, "b": "SELECT batch, bool_or(coalesce(drifted, FALSE)) AS d FROM k GROUP BY 1"}) + f"""
    SELECT count(*) AS checks, bool_or(d) AS drift_detected, {q6('count(*) FILTER (d) / count(*)::DOUBLE')} AS drift_frequency FROM b""")
def drift_summary(spark, sf_dir):
    return drift.drift_summary(checks(spark, sf_dir)[1]).withColumn("drift_frequency", r6("drift_frequency"))


@query("performance_summary", ctes("scored", extra={**CHECKS, "r": "SELECT *, row_number() OVER (ORDER BY batch)::DOUBLE AS i FROM p WHERE batch IN (FROM ids)",
    "s": f"SELECT {q6('regr_slope(accuracy, i)')} AS slope, arg_max(accuracy, batch) AS cur, avg(accuracy) AS m FROM r"}) + f"""
    SELECT (SELECT count(*) FROM c) AS checks, {q6('cur')} AS current_accuracy, {q6('m')} AS mean_accuracy, slope,
      CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def performance_summary(spark, sf_dir):
    p = drift.performance_summary(daily(spark, sf_dir).select("batch", "accuracy"))
    return p.withColumns({"current_accuracy": r6("current_accuracy"), "mean_accuracy": r6("mean_accuracy")})


@query("last_rows", ctes("scored") + "SELECT event_id, score FROM scored ORDER BY us DESC, event_id DESC LIMIT 200")
def last_rows(spark, sf_dir):
    return rolling.last_rows(src.scored(spark, sf_dir), ["ts", "event_id"], 200).select("event_id", "score")


@query("drift_p_values", ctes("flows", extra={**DRIFT, "k": "SELECT feature, max(abs(ca - cb)) AS ks FROM c GROUP BY 1",
    "m": "SELECT feature, sum(a) AS x, sum(b) AS y FROM n GROUP BY 1", "z": "SELECT feature, sqrt(x * y / (x + y)) * ks AS z FROM k JOIN m USING (feature)"}) + f"""
    SELECT feature, {q6('CASE WHEN z < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 61), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * i * i * z * z))))) END')} AS p_value FROM z""")
def drift_p_values(spark, sf_dir):
    return shift(spark, sf_dir).select("feature", r6("p_value").alias("p_value"))


@query("user_drift")
def user_drift(spark, sf_dir):
    """Each user's packets before and after the middle: two small samples a user, so with the exact p-value."""
    f = src.flows(spark, sf_dir)
    late = F.col("ts") >= F.timestamp_seconds(F.lit(MIDDLE))
    counts = f.groupBy(F.col("user_id").cast("string").alias("feature"), F.col("packets").cast("double").alias("value")).agg(
        F.count_if(~late).alias("a"), F.count_if(late).alias("b"))
    found = drift.shift_of_counts(counts).where("ks_statistic is not null")
    return found.select("feature", r6("ks_statistic").alias("ks_statistic"), r6("p_value").alias("p_value"), "drifted")


@query("window_gauges", ctes("features") + f"""
    SELECT window_size, {q6('arg_max(pps, window_start)')} AS pps, {q6('arg_max(entropy_src_ip, window_start)')} AS entropy FROM features GROUP BY 1""")
def window_gauges(spark, sf_dir):
    f = features(spark, sf_dir, top=0)
    g = metrics.gauges(f, ["window_size"], ["packets_per_second", "entropy_src_ip"], ts="window_start")
    return g.select("window_size", r6("packets_per_second").alias("pps"), r6("entropy_src_ip").alias("entropy"))
