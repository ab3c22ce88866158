"""Quality classification by positive-unlabelled learning.

A linear classifier on hashed character trigrams and on measures of form is
trained with the non-negative unbiased risk: positives are trusted, everything
else is unlabelled web text, in which a share of positives, the class prior, is assumed.
Where some rows are marked bad, the prior is the share of good rows among the
marked ones and the score is calibrated on them; else the prior is estimated as
the least ratio of unlabelled to positive texts above any score of a classifier that tells
the two apart, and the score is the classifier's own.

Training takes about ``positives`` trusted and ``unlabelled`` other texts
(documented bounds), chosen by a hash of their ids; features come to the driver, texts do not.
Scoring reads every whole text and nothing else.

Defined cases: null and empty texts get the score of an empty text; without any
positive every score is 0, without anything unlabelled 1; labels of unknown ids are ignored, of labels that
contradict each other for one id the least counts; rows may repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fiscalframe.llm.common import slices
from fiscalframe.llm.features import Adam, sigmoid, trigrams, unit

POSITIVES = 2000
UNLABELLED = 3000
BUCKETS = 2048
_KINDS = np.full(256, 4, np.uint8)  # byte classes: 0 lower case, 1 upper case, 2 digit, 3 space, 4 mark, 5 beyond ASCII
for _bytes, _kind in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), ((9, 10, 11, 12, 13, 32), 3), (range(128, 256), 5)):
    _KINDS[list(_bytes)] = _kind


def measures(data: bytes) -> np.ndarray:
    """Form of a text: shares of byte classes and of repetition, lengths on a logarithmic scale."""
    words = data.split()
    kinds = np.bincount(_KINDS[np.frombuffer(data, np.uint8)], minlength=6) / max(1, len(data))
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    n = max(1, len(words))
    lines = data.split(b"\n")
    lengths = [np.log1p(len(words)) / 10, np.log1p(len(data) / n) / 5, np.log1p(len(data) / len(lines)) / 10]
    return np.array([*kinds, len(counts) / n, top / n, len(set(lines)) / len(lines), *lengths, not words], np.float32)


MEASURES = len(measures(b""))


def vector(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    # Form weighs more than spelling, which few texts teach by heart.
    return np.concatenate([0.6 * unit(trigrams(data, BUCKETS)), 6 * measures(data), [np.float32(1)]])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (x @ self.weights).astype(np.float64) + self.offset)


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights of the least non-negative risk with logistic loss.

    The risk of unlabelled texts being called negative, less the positives' part
    in it, cannot truly be below zero; while it is, the steps undo the overfit.
    """
    weights, adam = np.zeros(positive.shape[1], np.float32), Adam(positive.shape[1], 0.1)
    all_positive = positive.mean(axis=0)
    for _ in range(steps):
        of_positive, of_unlabelled = positive @ weights, unlabelled @ weights
        u = sigmoid(of_unlabelled) / len(unlabelled)
        risk = np.logaddexp(0, of_unlabelled).mean() - prior * np.logaddexp(0, of_positive).mean()
        if risk < 0:
            p = sigmoid(of_positive) / len(positive)
            gradient = prior * (p.astype(np.float32) @ positive) - u.astype(np.float32) @ unlabelled
        else:
            # The slopes of both losses of a positive add up to minus one.
            gradient = u.astype(np.float32) @ unlabelled - prior * all_positive
        weights = (weights - adam.step(gradient + decay * weights)).astype(np.float32)
    return weights


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """An upper bound of the share of positives in unlabelled, from scores of both."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 50))
    ratios = [(unlabelled >= c).mean() / max((positive >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratios), 0.01, 0.99))


def calibrated(scores: np.ndarray, good: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Slope and offset of a logistic curve through marked texts."""
    scale = scores.std() or 1.0
    x = np.stack([scores / scale, np.ones(len(scores))], axis=1)
    weights, adam = np.array([1.0, 0.0]), Adam(2, 0.1)
    for _ in range(steps):
        weights = weights - adam.step(x.T @ (sigmoid(x @ weights) - good) / len(x) + 1e-3 * weights)
    return float(max(weights[0], 1e-3) / scale), float(weights[1])


def train(x: np.ndarray, label: np.ndarray) -> Model:
    """label: 1 good, 0 bad, -1 unmarked."""
    positive, unlabelled, bad = x[label == 1], x[label != 1], x[label == 0]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(x.shape[1]), float(bool(len(positive))), 0.0, 50.0 if len(positive) else -50.0)
    marked = np.flatnonzero(label >= 0)
    if len(bad):
        prior = float(np.clip((label[marked] == 1).mean(), 0.01, 0.99))
        # The marked texts, mixed as they come, join the unlabelled ones without their marks.
        unlabelled = x
    else:
        apart = non_negative_risk(positive, unlabelled, 0.5, 100)
        prior = estimated_prior(positive @ apart, unlabelled @ apart)
    weights = non_negative_risk(positive, unlabelled, prior)
    slope, offset = calibrated(x[marked] @ weights, label[marked]) if len(bad) else (1.0, 0.0)
    return Model(weights, prior, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from marked rows (labels: id_col, label_col of 1 or 0) and the other rows of docs."""
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    ids = docs.select(F.col(id_col).alias("id")).join(marks, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))
    marked, other = ids.agg(F.count(F.when(F.col("label") >= 0, 1)), F.count(F.when(F.col("label") < 0, 1))).first()
    # Marked rows come in the mix they have, so that the share of good ones can be told.
    rate = F.when(F.col("label") >= 0, F.lit(positives / max(1, marked))).otherwise(F.lit(unlabelled / max(1, other)))
    part = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30))
    chosen = ids.filter(part < rate * (1 << 30)).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(
        F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) < F.lit(max(positives / max(1, marked), unlabelled / max(1, other)) * (1 << 30))
    )

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.binary())], names=["label", "x"])

    rows = texts.join(chosen, "id").select("label", "text").mapInArrow(featured, "label int, x binary")
    found = rows.toArrow().sort_by([("label", "ascending"), ("x", "ascending")])
    label, packed = found.column("label").to_numpy(), b"".join(x.as_buffer() for x in found.column("x"))
    del found
    return train(np.frombuffer(packed, np.float16).reshape(len(label), BUCKETS + MEASURES + 1).astype(np.float32), label)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with a column text) with score and predicted in place of the text."""
    weights = Model(model.weights.astype(np.float32), model.prior, model.slope, model.offset)
    others = [f.name for f in rows.schema if f.name != "text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = [weights.scores(np.stack([vector(t) for t in texts[k : k + 512]])) for k in range(0, len(texts), 512)]
                scores = np.concatenate(found) if found else np.zeros(0)
                columns = [*[part.column(c) for c in others], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "score", "predicted"])

    schema = T.StructType([*[f for f in rows.schema if f.name != "text"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(scored, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1), predicted (1 from 0.5)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _scored(rows, model).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model predicts to be good, as they are."""
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in named.items()], F.col(text_col).alias("text"))
    return _scored(rows, model).filter("predicted = 1").select(*[F.col(a).alias(c) for c, a in named.items()])
