"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

A text's features are its distinct hashed 3- to 5-grams of lower-cased letters
(anything else is a blank). Each is scaled by the log ratio of its smoothed
document counts in toxic and clean training texts; the linear model over the
scaled features is fitted on the same labelled sample. Grams seen in fewer than
MIN_TEXTS training texts, or as often toxic as chance allows (SIGNIFICANT
deviations from the share of toxic texts), have ratio 0: else rare grams that
stand in one training text would be learned by heart. Scale and weight are folded into one
table for scoring, and grams of weight 0 are dropped before a text's grams are
made distinct.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField

from . import textgrams as T
from .arrowmap import append_from_text
from .ftrl import Ftrl, logistic
from .labelled import labelled_sample
from .quality import LinearModel

#: Bounds of the training sample, about: its distinct grams are held on the driver.
MOST_ROWS = 8_000
MOST_BYTES = 24_000_000

BITS = 20
ORDERS = (3, 4, 5)
MIN_TEXTS = 3
SIGNIFICANT = 4.0
SCALE = 0.3
EPOCHS = 4
TOXIC_WEIGHT = 4.0


def _distinct_grams(texts: pa.Array, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    for _, _, data, offsets in T.blocks(texts):
        points, first = T.characters(data, offsets)
        runs = []
        for n in ORDERS:
            g = T.char_grams(points, n, BITS)
            inside = np.ones(len(g), bool) if wanted is None else wanted[g]
            for k in range(1, n):  # a gram ends in its own text, or with the blank behind it
                inside[np.maximum(first[1:] - k, first[:-1])] = False
            at = np.flatnonzero(inside)
            runs.append((g[at], np.searchsorted(at, first)))
        for d in range(len(first) - 1):
            yield np.unique(np.concatenate([g[f[d] : f[d + 1]] for g, f in runs]))


class _Scaled(Sequence):
    """Rows of distinct grams with their values; only the grams are held."""

    def __init__(self, rows: list[np.ndarray], values: np.ndarray):
        self.values = values
        self.rows = rows
        for i, at in enumerate(rows):
            rows[i] = at[values[at] != 0]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i):
        return self.rows[i], self.values[self.rows[i]]


def fit_toxicity_model(sample: pa.Table, epochs: int = EPOCHS) -> LinearModel:
    """Weights already scaled by the log-count ratios."""
    labels = np.array(sample["label"].to_pylist(), float)
    rows = [g.astype(np.int32) for g in _distinct_grams(sample["text"].combine_chunks())]
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for at, y in zip(rows, labels, strict=True):
        (toxic if y > 0 else clean)[at] += 1
    n_toxic = labels.sum()
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (len(labels) - n_toxic + 2))
    n, share = toxic + clean, n_toxic / max(len(labels), 1)
    chance = np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    ratio[(n < MIN_TEXTS) | (np.abs(toxic - n * share) < SIGNIFICANT * chance)] = 0
    weights, intercept = Ftrl(BITS, alpha=0.5, l1=0.1).fit(_Scaled(rows, ratio * SCALE), labels, epochs, TOXIC_WEIGHT)
    return LinearModel((weights * ratio * SCALE).astype(np.float32), intercept)


def score_texts(texts: pa.Array, model: LinearModel, threshold: float) -> list[pa.Array]:
    score = logistic(np.array([float(model.weights[g].sum()) + model.intercept for g in _distinct_grams(texts, model.weights != 0)], float).reshape(-1))
    return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with score double (0 to 1, higher: label 1 likelier) and
    predicted int (1 if score >= ``threshold``).

    Fitted on about ``most_rows`` rows and ``most_bytes`` bytes at most of those
    whose id has a non-null label and isn't in ``held_out``. A null or empty
    text, or one without letters, gets the intercept's score (0.5 if there were
    no labels). Repeated rows each get the same score; an id with several labels
    counts once for each; repeated rows are learned from once, texts over a
    sixteenth of the bytes not at all; columns of ``docs`` named score or predicted are
    replaced. Texts of any length are scored whole."""
    sample = labelled_sample(docs, labels, label, held_out, id_col, text_col, most_rows, most_bytes)
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity_model(sample))
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return append_from_text(docs, text_col, fields, lambda texts: score_texts(texts, model.value, threshold), keep)
