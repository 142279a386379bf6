"""Quality classifier by compression: a zstandard dictionary of good text, one of bad text, and which of them packs a text better.

The text is compressed in blocks with either dictionary.  The normalised difference of the two sizes, and the size per byte
(text that packs to nothing says little to either dictionary, and little to a reader), are turned into a probability by a logistic
fit on labelled rows that the dictionaries have not seen.

Learning takes a bounded sample: at most ``per_class`` labelled rows of each class, in the order of a hash, none longer than
``max_bytes``.  Scoring takes every text, all of it.  Null and empty texts get the score of size 0; repeated rows score alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.llm.common import fresh, table


@dataclass(frozen=True)
class Training:
    per_class: int = 3000
    max_bytes: int = 16_384
    dictionary_bytes: int = 112_640
    block: int = 512
    level: int = 3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic weights; a few hundred kilobytes at most, whatever the corpus."""

    good: bytes
    bad: bytes
    mean: tuple
    scale: tuple
    weights: tuple
    block: int
    level: int

    def compressors(self):
        made = [zstandard.ZstdCompressionDict(d) for d in (self.good, self.bad)]
        for d in made:
            d.precompute_compress(level=self.level)
        options = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}
        return [zstandard.ZstdCompressor(level=self.level, dict_data=d, **options) for d in made]


def sizes(text: str | None, compressors, block: int) -> tuple[int, int, int]:
    raw = (text or "").encode("utf-8", "replace")
    cuts = [raw[i : i + block] for i in range(0, len(raw), block)]
    return (len(raw), *[sum(len(c.compress(x)) for x in cuts) for c in compressors])


def features(rows: list[tuple[int, int, int]]) -> np.ndarray:
    n, good, bad = np.array(rows, float).reshape(-1, 3).T
    return np.column_stack([(bad - good) / (bad + good + 64), np.log((good + bad + 64) / (2 * n + 64)), ((bad - good) / (n + 64))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood; classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    w, share = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (share * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def dictionary(texts: list[str], size: int, block: int) -> bytes:
    samples = [r[i : i + block] for t in texts for r in [t.encode("utf-8", "replace")] for i in range(0, len(r), block)]
    if len(samples) < 50:  # too few for the trainer: their text itself serves
        return b"\n".join(samples)[-size:] or b"\n"
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def fit(rows: list[tuple[str, int]], how: Training, odds: float = 1.0) -> Model:
    """rows: (text, 1 good or 0 bad) in a fixed order; every other one builds the dictionaries, the rest calibrates.

    The calibration weighs both classes alike; ``odds`` (good rows per bad row among all labels) moves it to their true shares.
    """
    by = {k: [t for t, label in rows if label == k] for k in (0, 1)}
    model = Model(dictionary(by[1][::2], how.dictionary_bytes, how.block), dictionary(by[0][::2], how.dictionary_bytes, how.block), (0.0,) * 3, (1.0,) * 3, (0.0,) * 4, how.block, how.level)
    rest = [(t, k) for k in (0, 1) for t in by[k][1::2]]
    if not rest:
        return model
    compressors = model.compressors()
    x, y = features([sizes(t, compressors, how.block) for t, _ in rest]), np.array([k for _, k in rest])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    weights = logistic((x - mean) / scale, y)
    weights[0] += np.log(odds)
    return Model(model.good, model.bad, tuple(mean), tuple(scale), tuple(weights), how.block, how.level)


def scores(model: Model, texts, compressors) -> np.ndarray:
    x = features([sizes(t, compressors, model.block) for t in texts])
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(w[0] + (x - np.array(model.mean)) / np.array(model.scale) @ w[1:], -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """One row per id that may be learnt from: not held out, and with one label only."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id")
    return known.agg(F.min("quality").alias("_label"), F.max("quality").alias("_other")).filter("_label = _other").drop("_other")


def training_rows(docs: DataFrame, known: DataFrame, how: Training = Training()) -> DataFrame:
    """The bounded sample, in a fixed order: of the labelled texts that are short enough to learn from."""
    usable = docs.filter(F.octet_length("text") <= how.max_bytes).select("doc_id")
    known = known.join(usable, "doc_id", "left_semi").withColumn("_at", F.xxhash64("doc_id", F.lit(2)))
    picked = [known.filter(F.col("_label") == k).orderBy("_at", "doc_id").limit(how.per_class) for k in (0, 1)]
    ids = picked[0].union(picked[1])  # at most 2 * per_class rows, so safe to broadcast
    texts = docs.select("doc_id", F.col("text").alias("_text")).filter(F.octet_length("_text") <= how.max_bytes)
    return texts.join(F.broadcast(ids), "doc_id").groupBy("_at", "doc_id", "_label").agg(F.min("_text").alias("_text")).orderBy("_at", "doc_id")


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    known = known_labels(labels)
    n = dict(known.groupBy("_label").count().collect())  # two rows
    odds = (n.get(1, 0) + 1) / (n.get(0, 0) + 1)
    rows = [(r["_text"], r["_label"]) for r in training_rows(docs, known, how).collect()]
    missing = set(n) - {label for _, label in rows}
    if missing and not known.filter(F.col("_label").isin(*missing)).join(docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
        raise ValueError("no text of a label is short enough to learn from")
    return fit(rows, how, odds)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from the threshold on)."""
    blob = docs.sparkSession.sparkContext.broadcast(model)

    rows = fresh(docs, "score", "predicted").withColumn("score", _iterated(blob)(F.col(text)))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _iterated(blob):
    """One pair of compressors serves all batches of a task."""

    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = blob.value.compressors()
        for texts in parts:
            yield pd.Series(scores(blob.value, texts, compressors))

    scored.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scored, "double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
