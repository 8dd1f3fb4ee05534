"""Model jobs on MLlib and Arrow functions: scaling, splits, oversampling, forests, boosting, scoring."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, finite
from ..session import cut_lineage, small_side, written
from .rolling import global_rank, with_reach
from .running import exact_quantiles, unpivot

# Fixed order: training features; only those a frame has are used.
TRAINING_FEATURES = [
    "total_packets", "total_bytes", "total_flows", "packets_per_second", "bytes_per_second", "flows_per_second",
    "unique_src_ips", "unique_dst_ips", "entropy_src_ip", "entropy_dst_ip", "tcp_ratio", "udp_ratio", "icmp_ratio",
    "avg_packet_size", "syn_ratio", "rst_ratio"]
#: Rows that an isolation forest's samples are drawn from at most.
POOL_ROWS = 8192
# Features that get a log transform.
SKEWED = ["packets_per_second", "bytes_per_second", "flows_per_second", "unique_src_ips"]


def known_features(df: DataFrame, names: list[str] = TRAINING_FEATURES) -> tuple[DataFrame, list[str]]:
    """The frame with nulls as 0, and the feature columns it has."""
    found = [c for c in names if c in df.columns]
    return df.na.fill(0, found), found


def sanitized(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in features})


def standard_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """Zero mean, unit population deviation; a constant feature becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    return df.withColumns({c: (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] if stats[f"s_{c}"] else F.lit(0.0) for c in features})


def robust_scale(df: DataFrame, features: list[str]) -> DataFrame:
    """(x - median) / interquartile range with exact quantiles; a zero range divides by 1."""
    q = exact_quantiles(unpivot(df, [], features), ["feature"], "value", [0.25, 0.5, 0.75])
    found = {r["feature"]: r for r in q.collect()}  # one row per feature
    return df.withColumns({c: (F.col(c) - found[c]["q1"]) / ((found[c]["q2"] - found[c]["q0"]) or 1.0) for c in found})


def log_features(df: DataFrame, features: list[str] = SKEWED) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in features if c in df.columns})


def stratified_split(df: DataFrame, label: str, key: list[str], test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the same share of every class, by a seeded hash of the row key.

    Hash buckets keep the class shares for large classes without ranking a class in one task; small
    classes (fewer rows than there are buckets) may be off by a row or two.
    """
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(label), *key), F.lit(1_000_000))
    tagged = df.withColumn("_b", bucket)
    limit = int(test * 1_000_000)
    return tagged.filter(F.col("_b") >= limit).drop("_b"), tagged.filter(F.col("_b") < limit).drop("_b")


def exact_stratified_split(df: DataFrame, label: str, key: list[str], test: float = 0.2, seed: int = 42,
                           chunks: int = 1024) -> DataFrame:
    """Adds `is_test` so that exactly round(share * class size) rows of each class are test rows."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *key))
    chunk = F.shiftright("_h", 64 - (chunks - 1).bit_length())
    ranked = global_rank(hashed, [label], ["_h", *key], chunk, "_rn")
    sizes = df.groupBy(label).agg(F.round(F.count("*") * F.lit(test)).alias("_take"))
    return ranked.join(small_side(sizes), label).withColumn("is_test", F.col("_rn") <= F.col("_take")).select(*df.columns, "is_test")


def nearest_rows(small: DataFrame, features: list[str], key: list[str], neighbours: int = 5, reach: int = 32, seed: int = 42) -> DataFrame:
    """Each row (key, rn, _v) with its nearest other rows, _best: array of (d, r, v), squared distance, rn and vector.

    Rows are ordered by a projection on a seeded direction of length one, so that a gap along it is a lower bound of the
    distance. `reach` places to either side give each row a k-th distance. A row is certain if no row outside of
    that frame can be nearer; others meet all rows whose gap is within their k-th distance.
    """
    direction = np.random.default_rng(seed).normal(size=len(features))
    direction /= np.linalg.norm(direction)
    projection = reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in zip(features, direction)])
    lo, hi, size = small.select(projection.alias("p"), *[F.abs(c).alias(f"_{i}") for i, c in enumerate(features)]).agg(
        F.min("p"), F.max("p"), F.max(F.greatest(F.lit(0.0), *[F.col(f"_{i}") for i in range(len(features))]))).first()
    slack = 1e-14 * len(features) ** 2 * size  # rounding of projections
    step = ((hi - lo) or 1.0) / 1024
    vector = F.array(*[F.col(c).cast("double") for c in features])
    placed = small.select(*key, vector.alias("_v"), projection.alias("_p"))
    chunk = F.floor((F.col("_p") - lo) / step).cast("bigint")
    ranked = written(global_rank(placed, [], ["_p", *key], chunk), "nearest-ranked")
    total = ranked.count()
    block = max(4096, 2 * reach)
    blocks = with_reach(ranked, 2 * reach, block)
    around = Window.partitionBy("_block").orderBy("rn").rowsBetween(-reach, reach)
    near = blocks.withColumns({"_near": F.collect_list(F.struct(F.col("rn").alias("r"), F.col("_v").alias("v"))).over(around),
                               "_low": F.min("_p").over(around), "_high": F.max("_p").over(around)})
    # A row is used in the block that holds both sides of its frame.
    place, start = F.col("rn") - 1, F.col("_block") * block
    rows = near.filter((place >= start - reach) & (place < start + block - reach))

    def distance(v: Column, w: Column) -> Column:
        return F.reduce(F.zip_with(v, w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    others = F.filter(F.transform("_near", lambda n: F.struct(distance(n["v"], F.col("_v")).alias("d"), n["r"].alias("r"), n["v"].alias("v"))),
                      lambda n: n["r"] != F.col("rn"))
    rows = rows.withColumn("_best", F.slice(F.array_sort(others), 1, neighbours))
    few = F.size("_best") < neighbours
    kth = F.sqrt(F.element_at("_best", -1)["d"])
    left = (F.col("rn") <= reach + 1) | (~few & (F.col("_p") - F.col("_low") - slack >= kth)) | (~few & (kth == 0))
    right = (F.col("rn") >= total - reach) | (~few & (F.col("_high") - F.col("_p") - slack >= kth)) | (~few & (kth == 0))
    radius = F.when(left & right, F.lit(None)).when(few, F.lit(float("inf"))).otherwise(kth * (1 + 1e-12) + slack)
    first = written(rows.select(*key, "rn", "_v", "_p", "_best", radius.alias("_radius")), "nearest-first")
    cell = max(256, -(-total // 10_000))
    edges = np.array([r["_p"] for r in ranked.filter((F.col("rn") - 1) % cell == 0).orderBy("rn").select("_p").collect()])  # 10,000 at most

    @F.pandas_udf("array<bigint>")
    def cells(p: pd.Series, r: pd.Series) -> pd.Series:
        a = np.maximum(np.searchsorted(edges, p - r, "left") - 1, 0)
        b = np.maximum(np.searchsorted(edges, p + r, "right") - 1, 0)
        return pd.Series([np.arange(x, y + 1) for x, y in zip(a, b)])

    open_ = first.filter("_radius is not null").select(F.col("rn").alias("_q"), F.col("_v").alias("_qv"), F.col("_p").alias("_qp"), "_radius")
    asked = open_.withColumn("_cell", F.explode(cells("_qp", "_radius")))
    celled = ranked.withColumn("_cell", F.expr(f"(rn - 1) div {cell}")).select("_cell", "rn", "_v", "_p")
    pairs = asked.join(celled, "_cell").filter((F.abs(F.col("_p") - F.col("_qp")) <= F.col("_radius")) & (F.col("rn") != F.col("_q")))
    pairs = pairs.select("_q", distance(F.col("_v"), F.col("_qv")).alias("d"), F.col("rn").alias("r"), F.col("_v").alias("v"))
    nearest = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("_q").orderBy("d", "r"))).filter(F.col("_k") <= neighbours)
    wide = nearest.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct("d", "r", "v"))).alias("_wide"))
    joined = first.join(written(wide, "nearest-wide"), F.col("rn") == F.col("_q"), "left")
    return joined.select(*key, "rn", "_v", F.coalesce("_wide", "_best").alias("_best"))


def oversample(df: DataFrame, features: list[str], label: str, key: list[str], minority: int = 1, share: float = 0.5,
               neighbours: int = 5, reach: int = 32, seed: int = 42) -> DataFrame:
    """Synthetic minority rows between a row and one of its near neighbours, up to `share` of the majority.

    The neighbours are the true nearest ones (`nearest_rows`; `reach` only bears on its work). Only synthetic rows are
    returned.
    """
    small = df.filter(F.col(label) == minority)
    counts = df.groupBy().agg(F.count_if(F.col(label) == minority).alias("few"), F.count_if(F.col(label) != minority).alias("many")).first()
    wanted = max(0, int(counts["many"] * share) - counts["few"])
    if not wanted or counts["few"] < 2:
        return small.select(*features, label).limit(0)
    rows = nearest_rows(small, features, key, neighbours, reach, seed)
    per_row = -(-wanted // counts["few"])
    copies = rows.select(*key, "rn", "_v", "_best", F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("_copy"))
    # Exactly `wanted` rows: every row gives `per_row - 1` copies, the first ones by rank one more.
    extra = wanted - (per_row - 1) * counts["few"]
    copies = copies.filter((F.col("_copy") < per_row) | (F.col("rn") <= extra))
    pick = F.pmod(F.xxhash64(F.lit(seed), "rn", "_copy"), F.size("_best")) + 1
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "rn", "_copy"), F.lit(1_000_000)) / F.lit(1e6)
    chosen = copies.withColumn("_o", F.element_at("_best", pick.cast("int"))["v"]).withColumn("_part", part)
    return chosen.select(*[(F.col("_v")[i] + F.col("_part") * (F.col("_o")[i] - F.col("_v")[i])).alias(c)
                           for i, c in enumerate(features)], F.lit(minority).alias(label))


# ---- isolation forest -------------------------------------------------------------------------

def _path_constant(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list[list[float]]) -> int:
    """Appends the subtree as rows (feature or -1, split or path addition, left, right)."""
    me = len(nodes)
    nodes.append([-1.0, _path_constant(len(x)), -1.0, -1.0])
    if depth >= limit or len(x) <= 1:
        return me
    low, high = x.min(axis=0), x.max(axis=0)
    usable = np.flatnonzero(high > low)
    if not len(usable):
        return me
    f = int(rng.choice(usable))
    split = float(rng.uniform(low[f], high[f]))
    left = x[:, f] <= split
    a = _grow(x[left], rng, depth + 1, limit, nodes)
    b = _grow(x[~left], rng, depth + 1, limit, nodes)
    nodes[me] = [float(f), split, float(a), float(b)]
    return me


def fit_isolation_forest(df: DataFrame, features: list[str], key: list[str], trees: int = 100, sample: int = 256,
                         seed: int = 42) -> DataFrame:
    """(tree, size, nodes): one row per tree, each grown from its own `sample` rows (all rows, if there are fewer).

    A pool of at most POOL_ROWS rows is drawn from the whole table by a seeded hash, and each tree takes the `sample`
    rows of the pool that come first in its own hash order. The rule is the same for every size of the table.
    """
    base = df.select(*key, F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.xxhash64(F.lit(seed), *key).alias("_h"))
    share = min(1.0, 2.0 * POOL_ROWS / max(df.count(), 1))
    drawn = base.filter(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30)))
    pool = written(drawn.orderBy("_h", *key).limit(POOL_ROWS).drop("_h"))
    rows = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), "tree", *key), *key)
    sampled = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf["x"].to_numpy())
        nodes: list[list[float]] = []
        _grow(x, np.random.default_rng([seed, tree]), 0, int(np.ceil(np.log2(max(len(x), 2)))), nodes)
        return pd.DataFrame({"tree": [tree], "size": [len(x)], "nodes": [json.dumps(nodes)]})

    return sampled.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes string")


def score_isolation_forest(df: DataFrame, features: list[str], forest: DataFrame, name: str = "raw_score") -> DataFrame:
    """Anomaly score 2^(-mean depth / c) per row; larger is more anomalous.

    The forest is bounded (trees times twice the sample nodes), so it is collected and sent along.
    """
    grown = forest.orderBy("tree").collect()
    trees = [np.array(json.loads(r["nodes"])) for r in grown]
    norm = _path_constant(max((r["size"] for r in grown), default=1)) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        m = np.stack(x.to_numpy())
        depth = np.zeros(len(m))
        rows = np.arange(len(m))
        for t in trees:
            at = np.zeros(len(m), dtype=np.int64)
            live = rows
            while len(live):
                node = t[at[live]]
                inner = node[:, 0] >= 0
                ends = live[~inner]
                depth[ends] += t[at[ends], 1]
                live, node = live[inner], node[inner]
                if not len(live):
                    break
                left = m[live, node[:, 0].astype(np.int64)] <= node[:, 1]
                at[live] = np.where(left, node[:, 2], node[:, 3]).astype(np.int64)
                depth[live] += 1.0
        return pd.Series(np.exp2(-(depth / len(trees)) / norm))

    return df.withColumn(name, score(F.array(*[F.col(c).cast("double") for c in features])))


def forest_verdicts(scored: DataFrame, contamination: float = 0.1, raw: str = "raw_score", confidence: str = "compressed") -> DataFrame:
    """Attack flag at the contamination quantile, compressed score and clamped confidence.

    The compressed score never exceeds one half, so votes on it never pass a gate above that; `confidence="raw"` lets
    the raw score speak as the confidence instead.
    """
    limit = exact_quantiles(scored, [], raw, [1.0 - contamination]).first()[0]
    marked = scored.withColumn("limit_score", F.lit(limit)).withColumn("ml_is_attack", F.col(raw) > limit)
    judged = compressed_confidence(marked, raw)
    return judged.withColumn("ml_confidence", F.col(raw)) if confidence == "raw" else judged


def compressed_confidence(df: DataFrame, raw: str, attack: str = "ml_is_attack") -> DataFrame:
    """`raw / (1 + raw)` as the anomaly score; confidence in the verdict, kept within 0.05 and 0.95."""
    score = F.when(F.col(raw) > 0, F.col(raw) / (1 + F.col(raw))).otherwise(0.0)
    return df.withColumn("anomaly_score", score).withColumn("ml_confidence", clamp(
        F.when(F.col(attack), F.col("anomaly_score")).otherwise(1 - F.col("anomaly_score")), 0.05, 0.95))


def sigmoid_confidence(df: DataFrame, decision: str, attack: str = "ml_is_attack") -> DataFrame:
    """Decision score to probability: negative decisions are anomalous."""
    return df.withColumn("anomaly_score", 1 / (1 + F.exp(F.col(decision)))).withColumn(
        attack, F.col(decision) < 0).withColumn("ml_confidence", clamp(
            F.when(F.col(attack), F.col("anomaly_score")).otherwise(1 - F.col("anomaly_score")), 0.05, 0.95))


# ---- supervised models ------------------------------------------------------------------------

def _assembled(features: list[str], scale: bool) -> list:
    stages = [VectorAssembler(inputCols=features, outputCol="raw_vector" if scale else "vector", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True, withStd=True))
    return stages


def boosted_trees(features: list[str], label: str, trees: int = 100, depth: int = 6, rate: float = 0.1, seed: int = 42,
                  scale: bool = True) -> Pipeline:
    return Pipeline(stages=[*_assembled(features, scale), GBTClassifier(
        featuresCol="vector", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)])


def random_forest(features: list[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42,
                  scale: bool = True) -> Pipeline:
    return Pipeline(stages=[*_assembled(features, scale), RandomForestClassifier(
        featuresCol="vector", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)])


# The searched grids, under the names that MLlib has for them. MLlib's trees have no class weights by
# resampling, no column share per tree and no positive-class weight; a label weight column takes their place.
FOREST_GRID = {"numTrees": [100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [2, 5, 10]}
BOOST_GRID = {"maxIter": [100, 200], "maxDepth": [4, 6, 8], "stepSize": [0.01, 0.1, 0.3], "subsamplingRate": [0.8, 1.0]}


def grid_search(pipeline: Pipeline, label: str, grid: dict[str, list], folds: int = 5, seed: int = 42,
                parallelism: int = 4) -> CrossValidator:
    """Cross-validated search over parameters of the pipeline's classifier, by F1."""
    classifier = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(name), values)
    metric = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    return CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), evaluator=metric, numFolds=folds,
                          seed=seed, parallelism=parallelism)


def without_summary(model: PipelineModel) -> PipelineModel:
    """The model without what it remembers of its training: a forest's summary holds the training frame, and would travel
    with every scoring task."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkSession.getActiveSession()._jvm.scala.Option.empty())
    return model


def attack_probability(scored: DataFrame, name: str = "attack_probability") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def probability_verdicts(df: DataFrame, probability: str, limit: float = 0.5) -> DataFrame:
    """Attack above the limit; the confidence is that of the verdict."""
    p = F.col(probability)
    return df.withColumns({"ml_is_attack": p > limit, "anomaly_score": p}).withColumn(
        "ml_confidence", F.when(F.col("ml_is_attack"), p).otherwise(1 - p))


def soft_vote(df: DataFrame, weights: dict[str, float], name: str = "attack_probability") -> DataFrame:
    """Weighted mean of several probability columns."""
    total = sum(weights.values())
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(c) * (w / total) for c, w in weights.items()]))


def importances(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """Feature importances of a fitted tree model, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, features: list[str], path: str, spark: SparkSession, stats: dict | None = None) -> None:
    """Scaler and model in one pipeline, with a one-row metadata table beside it."""
    without_summary(model).write().overwrite().save(f"{path}/model")
    meta = spark.createDataFrame([(features, json.dumps(stats or {}))], "features array<string>, statistics string")
    meta.write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


# ---- reconstruction error over sequences ------------------------------------------------------

def reconstruction_errors(sequences: DataFrame, components: int = 3, normal: Column | None = None,
                          column: str = "sequence") -> tuple[DataFrame, PipelineModel]:
    """Mean squared error of rebuilding each sequence from its principal components.

    The components are fitted on the normal sequences; `error` is added to all.
    """
    rows = cut_lineage(sequences.withColumn("_raw", array_to_vector(column)))
    stages = [StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
              PCA(k=components, inputCol="_x", outputCol="_z")]
    model = Pipeline(stages=stages).fit(rows.filter(normal) if normal is not None else rows)
    scaled = model.transform(rows)
    parts = model.stages[1].pc.toArray()
    basis = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in parts])
    x, z = vector_to_array("_x"), vector_to_array("_z")
    rebuilt = F.transform(basis, lambda row: F.reduce(F.zip_with(row, z, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    errors = F.zip_with(x, rebuilt, lambda a, b: (a - b) * (a - b))
    mse = F.reduce(errors, F.lit(0.0), lambda s, v: s + v) / F.size(errors)
    return scaled.withColumn("error", mse).drop("_raw", "_x", "_z"), model


def reconstruction_verdicts(scored: DataFrame, normal: Column | None = None, share: float = 0.95, full: float = 0.5) -> DataFrame:
    """Attack above the 95th percentile of the normal errors; score min(1, error / full)."""
    basis = scored.filter(normal) if normal is not None else scored
    limit = exact_quantiles(basis, [], "error", [share]).first()[0]
    return scored.withColumns({"limit_error": F.lit(limit), "ml_is_attack": F.col("error") > limit,
                               "anomaly_score": F.least(F.lit(1.0), F.col("error") / full)})
