"""Model jobs: what can be said of them without their exact numbers."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import evaluate, ml
from tidewatch.session import fresh_path

from .conftest import SMALL


def planted(spark, n=3000):
    """A label that follows two of three features."""
    x = spark.range(n).select("id", (F.rand(1) * 10).alias("a"), (F.rand(2) * 10).alias("b"), (F.rand(3) * 10).alias("c"))
    return x.withColumn("label", ((F.col("a") + F.col("b") > 12) & (F.col("a") > 3)).cast("int"))


def test_boosting_finds_the_rule(spark):
    train, test = ml.stratified_split(planted(spark), "label", ["id"])
    model = ml.boosted_trees(["a", "b", "c"], "label", trees=20).fit(train)
    scored = ml.attack_probability(model.transform(test), "score")
    assert scored.filter("score < 0 or score > 1").count() == 0 and scored.count() == test.count()
    assert evaluate.roc_auc(scored).first()[0] > 0.97


def test_saved_forest_scores_alike(spark):
    rows = planted(spark)
    model = ml.without_summary(ml.random_forest(["a", "b", "c"], "label", trees=10).fit(rows))
    assert not model.stages[-1].hasSummary
    folder = fresh_path(spark, "saved")
    ml.save_model(model, ["a", "b", "c"], folder, spark)
    again = ml.load_model(folder)
    both = [{r["id"]: r["attack_probability"] for r in ml.attack_probability(m.transform(rows)).select("id", "attack_probability").collect()} for m in (model, again)]
    assert both[0] == both[1]
    ranked = [(r["feature"], r["importance"]) for r in ml.importances(again, ["a", "b", "c"], spark).collect()]
    assert abs(sum(v for _, v in ranked) - 1) < 1e-9 and ranked[-1][0] == "c" and ranked[-1][1] < 0.1


def test_grid_search_prefers_the_deeper_trees(spark):
    search = ml.grid_search(ml.random_forest(["a", "b", "c"], "label", trees=5), "label", {"maxDepth": [1, 6]}, folds=3)
    best = search.fit(planted(spark)).bestModel
    assert best.stages[-1].getOrDefault("maxDepth") == 6


def test_isolation_forest(spark):
    """Planted outliers score highest, every tree has its full sample, and the flagged share is the contamination."""
    x = spark.range(2000).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"))
    x = x.withColumn("a", F.when(F.col("id") < 20, 9 + F.col("a")).otherwise(F.col("a")))
    forest = ml.fit_isolation_forest(x, ["a", "b"], ["id"])
    assert [r["size"] for r in forest.collect()] == [256] * 100
    v = ml.forest_verdicts(ml.score_isolation_forest(x, ["a", "b"], forest)).select("id", "raw_score", "ml_is_attack", "ml_confidence").collect()
    top = sorted(v, key=lambda r: -r["raw_score"])[:20]
    assert sum(r["id"] < 20 for r in top) >= 18
    assert sum(r["ml_is_attack"] for r in v) == 200 and all(0.05 <= r["ml_confidence"] <= 0.95 for r in v)
    few = ml.fit_isolation_forest(x.limit(50), ["a", "b"], ["id"]).collect()
    assert [r["size"] for r in few] == [50] * 100


def test_reconstruction_limit(spark):
    """About one in twenty of the normal rows is above the limit that they set."""
    out = entry.queries()["pca_recon"](spark, SMALL).collect()
    share = np.mean([r["ml_is_attack"] for r in out])
    assert len(out) > 50 and 0.02 < share < 0.4 and all(0 <= r["anomaly_score"] <= 1 for r in out)


def test_scored_rows(spark):
    rows = entry.queries()["gbt_scores"](spark, SMALL).collect()
    assert len(rows) > 0 and all(0 <= r["attack_probability"] <= 1 and r["ml_is_attack"] == (r["attack_probability"] > 0.5) for r in rows)
