"""Language ID: multinomial naive Bayes over hashed character n-grams.

Learned: log probabilities of 2**BITS buckets of hashed 2- and 3-grams of
lower-cased letters (anything else is a blank) for each language of a bounded
labelled sample. The matrix is broadcast; a batch of whole texts is scored by
gathering its grams' rows and summing them by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from . import textgrams as T
from .arrowmap import append_from_text
from .labelled import MOST_BYTES, MOST_ROWS, labelled_sample

BITS = 16
ORDERS = (2, 3)
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_probability: np.ndarray  # 2**BITS x languages, float32, and a row of zeros


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the grams that begin at each character; 2**BITS for those that would end in another text."""
    points, first = T.characters(data, offsets)
    grams = []
    for n in ORDERS:
        g = T.char_grams(points, n, BITS).astype(np.int64)
        for k in range(1, n):
            g[np.maximum(first[1:] - k, first[:-1])] = 1 << BITS
        grams.append(g)
    return grams, first, points


def fit_language_model(sample: pa.Table) -> LanguageModel:
    """From (text, label) rows. Without rows the model knows no language."""
    texts, labels = sample["text"].combine_chunks(), np.array(sample["label"].to_pylist(), object)
    languages = sorted(set(labels))
    counts = np.ones((1 << BITS, max(1, len(languages))))
    for k, language in enumerate(languages):
        own = texts.take(pa.array(np.flatnonzero(labels == language)))
        for _, _, data, offsets in T.blocks(own):
            for g in _grams(data, offsets)[0]:
                counts[:, k] += np.bincount(g, minlength=1 + (1 << BITS))[:-1]
    prior = np.array([(labels == x).sum() for x in languages] or [1], float)
    table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.append(table, np.zeros((1, table.shape[1]), np.float32), axis=0))


def score_texts(texts: pa.Array, model: LanguageModel) -> list[pa.Array]:
    """Language and posterior probability of each text."""
    best, score = [], []
    for _, _, data, offsets in T.blocks(texts):
        grams, first, points = _grams(data, offsets)
        total = np.tile(model.log_prior, (len(first) - 1, 1))
        for g in grams:
            total += T.sums_by_document(model.log_probability[g], first)
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(axis=1, keepdims=True)
        letters = T.sums_by_document((points != 32).astype(np.float32), first) > 0
        at = share.argmax(axis=1)
        known = letters & bool(model.languages)
        best += [model.languages[k] if ok else UNKNOWN for k, ok in zip(at, known, strict=True)]
        score.append(np.where(known, share[np.arange(len(at)), at], 0.0))
    return [pa.array(best, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())]


def identify_language(docs: DataFrame, held_out: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", keep: list[str] | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with lang_pred string and score double (the language's posterior).

    The model is fitted on about ``most_rows`` rows and ``most_bytes`` bytes at
    most of those with a non-null id, text and language that aren't in
    ``held_out``. Texts over a sixteenth of the bytes aren't learned from; rows that
    repeat id, text and language are learned from once. A text that is null, empty or without a letter, or any text if
    nothing could be learned, gets ``und`` and 0. Ties go to the language first
    in sorted order. Rows stay as many as they are, repeated ones included;
    columns of ``docs`` named lang_pred or score are replaced. Texts of any
    length are scored whole."""
    sample = labelled_sample(docs, None, lang_col, F.lit(False) if held_out is None else held_out, id_col, text_col, most_rows, most_bytes)
    model = docs.sparkSession.sparkContext.broadcast(fit_language_model(sample))
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return append_from_text(docs, text_col, fields, lambda texts: score_texts(texts, model.value), keep)
