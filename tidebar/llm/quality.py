"""Quality: logistic regression over hashed word n-grams, fitted by
follow-the-regularised-leader updates, scored as sparse dot products.

A token is a run of word bytes or of marks, lower-cased; features are tokens
and pairs of neighbours, hashed to 2**BITS, counted and scaled to unit length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField

from . import textgrams as T
from .arrowmap import append_from_text
from .ftrl import Ftrl, logistic
from .labelled import MOST_BYTES, MOST_ROWS, labelled_sample

BITS = 18
EPOCHS = 4


@dataclass
class LinearModel:
    weights: np.ndarray
    intercept: float


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, data, offsets in T.blocks(texts):
        tokens = T.Tokens(data, offsets, T.WORDS_AND_MARKS)
        one = tokens.hash >> np.uint64(64 - BITS)
        two = np.zeros_like(tokens.hash)
        two[:-1] = T.mix(tokens.hash[:-1] * np.uint64(3) + tokens.hash[1:]) >> np.uint64(64 - BITS)
        for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True):
            at, count = np.unique(np.concatenate((one[a:b], two[a : max(a, b - 1)])), return_counts=True)
            x = count.astype(np.float64)
            yield at.astype(np.int64), x / max(1e-9, float(np.sqrt(x @ x)))


def fit_quality_model(sample: pa.Table, epochs: int = EPOCHS) -> LinearModel:
    rows = list(_features(sample["text"].combine_chunks()))
    labels = np.array(sample["label"].to_pylist(), float)
    return LinearModel(*Ftrl(BITS, alpha=2.0, l1=0.05).fit(rows, labels, epochs))


def score_texts(texts: pa.Array, model: LinearModel, threshold: float) -> list[pa.Array]:
    score = logistic(np.array([model.weights[at] @ x + model.intercept for at, x in _features(texts)], float).reshape(-1))
    return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", threshold: float = 0.3, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with score double (0 to 1, higher: label 1 likelier) and
    predicted int (1 if score >= ``threshold``).

    Fitted on about ``most_rows`` rows and ``most_bytes`` bytes at most of those
    whose id has a non-null label and isn't in ``held_out``. A null, empty or
    unseen text has no known feature: its score is the intercept's (0.5 if
    there were no labels). Repeated rows each get the same score; an id with
    several labels counts once for each; repeated rows are learned from once, texts
    over a sixteenth of the bytes not at all; columns of ``docs`` named score or
    predicted are replaced. Texts of any length are scored whole."""
    sample = labelled_sample(docs, labels, label, held_out, id_col, text_col, most_rows, most_bytes)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality_model(sample))
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return append_from_text(docs, text_col, fields, lambda texts: score_texts(texts, model.value, threshold), keep)
