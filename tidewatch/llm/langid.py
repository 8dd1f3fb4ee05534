"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

UNKNOWN = "und"
FEATURES = 1 << 16
ORDERS = (1, 2, 3)
PIECE = 1 << 20
#: Rows the classifier is fitted on at most; languages share them about evenly. Document frequencies count all rows.
SAMPLE_ROWS = 6000
EPOCHS = 2
RATE, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
CALIBRATION_SHARE = 5
MIN_SCORE = 0.5
MODEL = "kind string, lang string, feature int, value double"


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket of every character n-gram of the whole lower-cased text, a piece at a time; blanks stand at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    mixer, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - FEATURES.bit_length() + 1)
    for begin in range(0, len(points), PIECE):
        some = points[begin:begin + PIECE + max(ORDERS) - 1].astype(np.uint64)
        fresh = min(PIECE, len(points) - begin)
        hashed = np.zeros(len(some), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            hashed = (hashed[:len(some) - order + 1] + some[order - 1:] + np.uint64(order)) * mixer
            if order in ORDERS:
                yield ((hashed ^ hashed >> np.uint64(32)) * mixer >> shift).astype(np.int64)[:fresh]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(FEATURES, np.int64)
    for found in grams(text):
        total += np.bincount(found, minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    value = (1 + np.log(n)) * idf[at]
    length = np.sqrt(value @ value)
    return at, value / length if length > 0 else value


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages by features, the last feature is the constant
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, value = tf_idf(text, self.idf)
        return self.weights[:, at] @ value + self.weights[:, FEATURES]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs:
            return UNKNOWN, 0.0
        chance = softmax(self.logits(text) / self.temperature)
        best = int(chance.argmax())
        return self.langs[best], float(min(max(chance[best], 0.0), 1.0))


class Ftrl:
    """Follow the regularised leader, proximal form with per-coordinate rates; the L1 part keeps weights at zero."""

    def __init__(self, classes: int):
        self.z = np.zeros((classes, FEATURES + 1))
        self.n = np.zeros((classes, FEATURES + 1))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / RATE + L2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, FEATURES), np.append(value, 1.0)
        w = self.weights(at)
        miss = softmax(w @ value)
        miss[label] -= 1
        g = miss[:, None] * value
        n = self.n[:, at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / RATE
        self.z[:, at] += g - sigma * w
        self.n[:, at] = n + g * g


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    def loss(log_t: float) -> float:
        chance = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(chance[np.arange(len(labels)), labels], 1e-12)).mean()
    if not len(labels):
        return 1.0
    low, high, g = np.log(0.01), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: pd.DataFrame, langs: list[str], idf: np.ndarray) -> Model:
    """Every CALIBRATION_SHARE-th row is kept for the temperature, the others are learned from in the order given."""
    number = {x: i for i, x in enumerate(langs)}
    labels = rows["lang"].map(number).to_numpy(np.int64)
    features = [tf_idf(t, idf) for t in rows["text"]]
    held = np.arange(len(rows)) % CALIBRATION_SHARE == CALIBRATION_SHARE - 1
    learner = Ftrl(len(langs))
    for _ in range(EPOCHS):
        for i in np.flatnonzero(~held):
            learner.learn(*features[i], int(labels[i]))
    model = Model(langs, idf, learner.weights(slice(None)))
    logits = np.array([model.weights[:, features[i][0]] @ features[i][1] + model.weights[:, FEATURES] for i in np.flatnonzero(held)]).reshape(-1, len(langs))
    model.temperature = best_temperature(logits, labels[held])
    return model


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for text in batch["text"]:
            seen = np.zeros(FEATURES, bool)
            for found in grams(text):
                seen[found] = True
            total += seen
    at = np.flatnonzero(total)
    yield pd.DataFrame({"feature": at, "n": total[at]})


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from `rows` (key, text, lang; no nulls in text and lang).

    Document frequencies are counted over all rows. The classifier is fitted in one task on at most `sample_rows` rows,
    drawn by a hash of `key` so that languages share them about evenly. FEATURES document frequencies and the non-zero
    weights (at most FEATURES + 1 a language) go to the driver.
    """
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(FEATURES), np.zeros((0, FEATURES + 1)))
    frequencies = rows.select("text").mapInPandas(_frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n_docs = sum(sizes.values())
    idf = np.full(FEATURES, np.log(1 + n_docs) + 1)
    for r in frequencies:
        idf[r["feature"]] = np.log((1 + n_docs) / (1 + r["n"])) + 1
    size_of = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    chance = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.withColumn("turn", chance * size_of[F.col("lang")]).where(F.col("turn") <= 1.5 * sample_rows / len(langs))
    drawn = drawn.orderBy("turn", "lang", "text").limit(sample_rows)

    def fit_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            model = fit(pd.concat(held, ignore_index=True), langs, idf)
            for lang, weights in zip(langs, model.weights, strict=True):
                at = np.flatnonzero(weights)
                yield pd.DataFrame({"kind": "weight", "lang": lang, "feature": at, "value": weights[at]})
            yield pd.DataFrame({"kind": ["temperature"], "lang": [None], "feature": [0], "value": [model.temperature]})

    model = Model(langs, idf, np.zeros((len(langs), FEATURES + 1)))
    number = {x: i for i, x in enumerate(langs)}
    for r in drawn.select("text", "lang").coalesce(1).mapInPandas(fit_all, MODEL).toLocalIterator():
        if r["kind"] == "weight":
            model.weights[number[r["lang"]], r["feature"]] = r["value"]
        else:
            model.temperature = r["value"]
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def predicted(model: Model, text: Column, spark: SparkSession) -> Column:
    """struct(lang_pred, score) of a whole text: UNKNOWN and 0 for a null text or one without any letter."""
    model.weights = model.weights.astype(np.float32)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(t) for t in texts]
        return pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})
    return predict(F.when(has_letter(text), text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train_on_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from rows with an id that is not held out, a language and a text with a letter; of them only text and language."""
    usable = F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & has_letter(F.col(text_col))
    return train(docs.where(usable).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), sample_rows)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    A null text or one without any letter is UNKNOWN with score 0, and so is every text if there is nothing to learn
    from. Rows without id are not held out and not learned from. Repeated rows are rows of their own, an empty table
    gives no rows, and other columns are ignored.
    """
    model = train_on_documents(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample_rows=sample_rows)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predicted(model, F.col(text_col), docs.sparkSession).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
