"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier on hashed character trigrams
predicts each bit, and the language whose codeword has the least loss, weighted by how
reliable the bits were in training, is chosen.  Close calls are flagged.

Training takes about ``sample`` labelled texts in all (a documented bound),
as many of each language, chosen by a hash of their ids; features come to the
driver, texts do not.  Prediction reads every whole text and nothing else.

Defined cases: ``und`` with score 0 for null texts and texts without a letter,
and for all if nothing was labelled; a single known language is always chosen;
rows may repeat; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fiscalframe.llm.common import slices
from fiscalframe.llm.features import BUCKETS, Adam, letters, sigmoid, trigrams, unit

UNKNOWN = "und"
SAMPLE = 4000
AMBIGUOUS = 0.8  # scores below are flagged
_LETTER = re.compile(r"[^\W\d_]")


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 for each class; any two rows differ in many columns.

    Up to six classes every way to part them is a column; beyond, random
    columns, of many draws those whose closest rows are farthest apart.
    """
    if classes < 2:
        return np.zeros((classes, 0))
    if classes <= 6:
        columns = [[1, *[1 if k >> i & 1 else -1 for i in range(classes - 1)]] for k in range(2 ** (classes - 1) - 1)]
        return np.array(columns, float).T
    width, rng, best = int(np.ceil(10 * np.log2(classes))), np.random.default_rng(5), None
    for _ in range(200):
        code = np.where(rng.random((classes, width)) < 0.5, -1.0, 1.0)
        near = (code @ code.T - 2 * width * np.eye(classes)).max()
        if np.all(np.abs(code.sum(axis=0)) < classes) and (best is None or near < best[0]):
            best = (near, code)
    return best[1]


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # buckets + 1 for the bias, bits
    trust: np.ndarray  # of each bit

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of each language, by its codeword's loss."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return share / share.sum(axis=1, keepdims=True)


def train(x: np.ndarray, names: list[str], steps: int = 150) -> Model:
    known = sorted(set(names))
    code = codewords(len(known))
    y = code[[known.index(n) for n in names]]
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # Trigram shares are small numbers; scaled up, few steps suffice.
    weights, adam = np.zeros((x1.shape[1], code.shape[1]), np.float32), Adam((x1.shape[1], code.shape[1]), 1.0)
    for _ in range(steps if code.shape[1] else 0):
        wrong = (y * sigmoid(-y * (x1 @ weights)) / len(x1)).astype(np.float32)
        weights = (weights - adam.step(1e-5 * weights - x1.T @ wrong)).astype(np.float32)
    right = ((x1 @ weights) * y > 0).mean(axis=0)
    return Model(tuple(known), code, weights.astype(np.float32), np.maximum(2 * right - 1, 0.05))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """A model of the languages in the labelled rows of docs, None if there are none."""
    rows = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # The model holds every language anyway, so their counts may come to the driver.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, sample / len(counts) / n)])
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.element_at(shares, F.col("lang")) * (1 << 30)).select("lang", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [unit(trigrams(letters(t))).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(x, pa.binary())], names=["lang", "x"])

    found = chosen.mapInArrow(featured, "lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    if not len(found):
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return train(x, found.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score, ambiguous."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                texts = part.column("text").to_pylist()
                usable = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
                for some in (usable[k : k + 512] for k in range(0, len(usable), 512)):
                    share = model.scores(np.stack([unit(trigrams(letters(texts[i]))) for i in some]))
                    for i, k, s in zip(some, share.argmax(axis=1), share.max(axis=1), strict=True):
                        names[i], scores[i] = model.names[k], s
                close = (scores < AMBIGUOUS).tolist()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(scores), pa.array(close)], names=["id", "lang_pred", "score", "ambiguous"])

    out = rows.mapInArrow(predicted, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)
