"""Classifier evaluation: confusion, rates, ROC, AUC and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .running import running_sums, value_chunks


def confusion(scored: DataFrame, keys: list[str] | None = None, label: str = "label", pred: str = "pred") -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return scored.groupBy(*(keys or [])).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"))


def rates(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and the two error rates; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cm.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)})


def _by_score(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    counts = scored.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return value_chunks(counts, keys, score)


def roc_auc(scored: DataFrame, keys: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Exact area under the ROC curve (ties count half)."""
    keys = keys or []
    ranked = running_sums(_by_score(scored, keys, score, label), keys, score, ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, F.sum(F.col("pos") * below) / pairs).alias("auc_roc"))


def roc_curve(scored: DataFrame, keys: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, tpr, fpr) for every distinct score, highest first."""
    keys = keys or []
    ranked = running_sums(_by_score(scored, keys, score, label), keys, score, ["pos", "neg"], descending=True)
    return ranked.select(*keys, F.col(score).alias("threshold"), ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
                         ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"))


def comparison(scored: DataFrame, model: str = "model") -> DataFrame:
    """One row of figures per model."""
    return rates(confusion(scored, [model])).join(roc_auc(scored, [model]), model)


def best_model(table: DataFrame, model: str = "model", by: str = "f1_score") -> DataFrame:
    return table.agg(F.max_by(F.col(model), F.struct(F.col(by), F.col(model))).alias(model), F.max(by).alias(by))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def metric_rows(table: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Wide metric columns to (metric_name, value) rows."""
    pairs: list[Column] = [F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("value")) for n in names]
    return table.select(*keys, F.explode(F.array(*pairs)).alias("m")).select(*keys, "m.*")
