"""Model jobs over flow and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EnsembleSettings
from ..functions.numeric import r6
from ..operators import ensemble, ml, rolling, windows
from ..session import cut_lineage, fresh_path, written
from ..sources import events as src
from .base import ctes, query
from .base import r6 as q6
from .windows import features

NAMES = ["packets", "bytes", "avg_packet_size", "sport", "dport", "protocol"]


def frame(spark, sf_dir):
    return src.flows(spark, sf_dir).select("event_id", *[F.col(c).cast("double").alias(c) for c in NAMES], F.col("is_attack").alias("label"))


@query("standard_scaled", ctes("flows", extra={"s": "SELECT avg(packets) AS m, stddev_pop(packets) AS d, avg(bytes) AS mb, stddev_pop(bytes) AS db FROM flows"}) + f"""
    SELECT event_id, {q6('(packets - m) / d')} AS packets, {q6('(bytes - mb) / db')} AS bytes FROM flows, s""")
def standard_scaled(spark, sf_dir):
    out = ml.standard_scale(frame(spark, sf_dir).select("event_id", "packets", "bytes"), ["packets", "bytes"])
    return out.select("event_id", r6("packets").alias("packets"), r6("bytes").alias("bytes"))


@query("robust_scaled", ctes("flows", extra={"s": "SELECT quantile_cont(packets, 0.25) AS a, quantile_cont(packets, 0.5) AS m, quantile_cont(packets, 0.75) AS b FROM flows"}) + f"""
    SELECT event_id, {q6('(packets - m) / (b - a)')} AS packets FROM flows, s""")
def robust_scaled(spark, sf_dir):
    out = ml.robust_scale(frame(spark, sf_dir).select("event_id", "packets"), ["packets"])
    return out.select("event_id", r6("packets").alias("packets"))


@query("log_features", ctes("features") + f"SELECT window_size, window_start, {q6('ln(1 + pps)')} AS pps, {q6('ln(1 + bps)')} AS bps FROM features")
def log_features(spark, sf_dir):
    t = windows.rates(windows.window_totals(src.flows(spark, sf_dir), [3600, 21600, 86400]))
    out = ml.log_features(t)
    return out.select("window_size", "window_start", r6("packets_per_second").alias("pps"), r6("bytes_per_second").alias("bps"))


KNOWN_SQL = dict(zip(ml.TRAINING_FEATURES, [
    "total_packets", "total_bytes", "total_flows", "pps", "bps", "fps", "unique_src_ips", "unique_dst_ips",
    "CASE WHEN window_start % 7200 = 0 THEN 0 ELSE entropy_src_ip END", "entropy_dst_ip", "tcp_ratio", "udp_ratio", "icmp_ratio", "size_mean", "syn_ratio"]))


@query("known_features", ctes("features") + " UNION ALL ".join(
    f"SELECT window_size, window_start, '{name}' AS feature, {q6(f'({expression})::DOUBLE')} AS value FROM features" for name, expression in KNOWN_SQL.items()))
def known_features(spark, sf_dir):
    """The features a frame has, nulls as 0; one known column is missing and one is null at times."""
    gaps = features(spark, sf_dir, top=0).drop("rst_ratio").withColumn("entropy_src_ip", F.expr("case when window_start % 7200 <> 0 then entropy_src_ip end"))
    rows, names = ml.known_features(gaps)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])
    return rows.select("window_size", "window_start", F.explode(pairs).alias("p")).select("window_size", "window_start", "p.feature", r6("p.value").alias("value"))


@query("split_counts", ctes("flows") + "SELECT is_attack AS label, round(count(*) * 0.2)::BIGINT AS test_rows, count(*) - round(count(*) * 0.2)::BIGINT AS train_rows FROM flows GROUP BY 1")
def split_counts(spark, sf_dir):
    s = ml.exact_stratified_split(frame(spark, sf_dir), "label", ["event_id"])
    return s.groupBy("label").agg(F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows"))


@query("smote_counts", ctes("flows") + """
    SELECT 1 AS label, greatest(0, CAST(floor(count(*) FILTER (is_attack = 0) * 0.5) AS BIGINT) - count(*) FILTER (is_attack = 1)) AS rows FROM flows""")
def smote_counts(spark, sf_dir):
    scaled = ml.standard_scale(frame(spark, sf_dir), ["packets", "bytes"])
    return ml.oversample(scaled, ["packets", "bytes"], "label", ["event_id"]).groupBy("label").agg(F.count("*").alias("rows"))


@query("sigmoid", ctes("flows") + f"""
    SELECT event_id, {q6('1 / (1 + exp((50.0 - k) / 20))')} AS anomaly_score, k > 50 AS ml_is_attack,
      {q6('greatest(0.05, least(0.95, CASE WHEN k > 50 THEN 1 / (1 + exp((50.0 - k) / 20)) ELSE 1 - 1 / (1 + exp((50.0 - k) / 20)) END))')} AS ml_confidence FROM flows""")
def sigmoid(spark, sf_dir):
    d = src.flows(spark, sf_dir).select("event_id", ((F.lit(50.0) - F.col("k")) / 20).alias("decision"))
    out = ml.sigmoid_confidence(d, "decision")
    return out.select("event_id", r6("anomaly_score").alias("anomaly_score"), "ml_is_attack", r6("ml_confidence").alias("ml_confidence"))


@query("score_compression", ctes("scored") + f"""
    SELECT event_id, {q6('score / (1 + score)')} AS anomaly_score,
      {q6('greatest(0.05::DOUBLE, least(0.95::DOUBLE, CASE WHEN pred = 1 THEN score / (1 + score) ELSE 1 - score / (1 + score) END))')} AS ml_confidence FROM scored""")
def score_compression(spark, sf_dir):
    s = src.scored(spark, sf_dir).withColumn("ml_is_attack", F.col("pred") == 1)
    out = ml.compressed_confidence(s, "score")
    return out.select("event_id", r6("anomaly_score").alias("anomaly_score"), r6("ml_confidence").alias("ml_confidence"))


@query("soft_vote", ctes("scored") + f"""
    SELECT event_id, {q6('(score + 2 * score * score) / 3')} AS probability, (score + 2 * score * score) / 3 > 0.5 AS ml_is_attack FROM scored""")
def soft_vote(spark, sf_dir):
    s = src.scored(spark, sf_dir).withColumn("squared", F.col("score") * F.col("score"))
    v = ml.probability_verdicts(ml.soft_vote(s, {"score": 1.0, "squared": 2.0}, "probability"), "probability")
    return v.select("event_id", r6("probability").alias("probability"), "ml_is_attack")


@query("iforest_scores")
def iforest_scores(spark, sf_dir):
    rows = frame(spark, sf_dir)
    names = ["packets", "bytes", "avg_packet_size"]
    forest = ml.fit_isolation_forest(rows, names, ["event_id"])
    v = ml.forest_verdicts(cut_lineage(ml.score_isolation_forest(rows, names, forest)))
    return v.select("event_id", r6("raw_score").alias("raw_score"), "ml_is_attack", r6("ml_confidence").alias("ml_confidence"))


@query("window_model_votes")
def window_model_votes(spark, sf_dir):
    """Isolation forest over the window features; its verdicts become votes next to the entropy votes."""
    known, names = ml.known_features(features(spark, sf_dir))
    rows = cut_lineage(ml.sanitized(known, names))
    forest = ml.fit_isolation_forest(rows, names, ["window_size", "window_start"])
    judged = ml.forest_verdicts(cut_lineage(ml.score_isolation_forest(rows, names, forest)), confidence="raw")
    votes = ensemble.collect_votes(ensemble.ml_votes(judged), ensemble.entropy_votes(judged))
    return ensemble.weighted(votes, EnsembleSettings(min_confidence=0.5)).select(
        "window_size", "window_start", "attack_type", r6("confidence").alias("confidence"), "total_votes")


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    rows = frame(spark, sf_dir)
    train, test = ml.stratified_split(rows, "label", ["event_id"])
    model = ml.boosted_trees(NAMES, "label").fit(written(train))
    scored = ml.probability_verdicts(ml.attack_probability(model.transform(test)), "attack_probability")
    return scored.select("event_id", r6("attack_probability").alias("attack_probability"), "ml_is_attack")


@query("rf_importance")
def rf_importance(spark, sf_dir):
    rows = written(frame(spark, sf_dir))
    model = ml.random_forest(NAMES, "label").fit(rows)
    folder = fresh_path(spark, "forest")
    ml.save_model(model, NAMES, folder, spark)
    return ml.importances(ml.load_model(folder), NAMES, spark)


@query("rf_grid_search")
def rf_grid_search(spark, sf_dir):
    """Five folds over a part of FOREST_GRID; the whole grid of 90 fits takes too long for a test table."""
    rows = written(frame(spark, sf_dir))
    search = ml.grid_search(ml.random_forest(NAMES, "label", trees=20), "label", {"maxDepth": [5, 10], "minInstancesPerNode": [2, 10]})
    scored = ml.attack_probability(ml.without_summary(search.fit(rows).bestModel).transform(rows))
    return scored.groupBy("label").agg(F.count("*").alias("rows"), r6(F.avg("attack_probability")).alias("mean_probability"))


@query("gbt_grid_search")
def gbt_grid_search(spark, sf_dir):
    """Five folds over two step sizes, with few trees; BOOST_GRID is the whole grid."""
    rows = written(frame(spark, sf_dir))
    search = ml.grid_search(ml.boosted_trees(NAMES, "label", trees=5, depth=4), "label", {"stepSize": [0.1, 0.3]})
    scored = ml.attack_probability(search.fit(rows).bestModel.transform(rows))
    return scored.groupBy("label").agg(F.count("*").alias("rows"), r6(F.avg("attack_probability")).alias("mean_probability"))


@query("pca_recon")
def pca_recon(spark, sf_dir):
    """Sequences of all window features; components and limit come from the windows without an anomalous rate."""
    known, names = ml.known_features(features(spark, sf_dir))
    rows = written(known.filter("window_size = 3600"))
    vector = rows.withColumn("step", F.array(*[F.col(c).cast("double") for c in names]))
    seq = rolling.sequences(vector, ["window_size"], ["window_start"], F.expr("window_start div (3600 * 256)"), "step", 10, 256)
    seq = seq.withColumn("sequence", F.flatten("sequence"))
    middle = rows.agg(F.percentile_approx("total_packets", 0.9)).first()[0]
    normal = F.col("total_packets") <= middle
    scored, _ = ml.reconstruction_errors(seq, 3, normal)
    v = ml.reconstruction_verdicts(scored, normal)
    return v.select("window_start", r6("error").alias("error"), "ml_is_attack", r6("anomaly_score").alias("anomaly_score"))
