"""A bounded sample of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample: expected rows and bytes of text. Rows are drawn whole, by a
#: hash of id and text, and rows that repeat both are drawn as one; texts over a
#: sixteenth of the bytes aren't drawn.
MOST_ROWS = 8_000
MOST_BYTES = 48_000_000


def held_out_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def drawn_share(share: float, name: str, *columns: str) -> Column:
    """Whether a hash of the columns falls into the given share of its range."""
    return F.pmod(F.xxhash64(*columns, F.lit(name)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)) + 1)


def labelled_sample(docs: DataFrame, labels: DataFrame | None, label: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> pa.Table:
    """(text, label) of about ``most_rows`` and ``most_bytes`` at most, in a
    fixed order. ``labels`` (id, label) is joined by id; None: ``docs`` has the
    label itself. Rows with a null id, text or label, or held out, take no part;
    rows that repeat id, text and label take part once, and so do labels that
    repeat an id and a label. An id with several texts or labels has a row for each."""
    longest = most_bytes // 16
    fit = F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out & (F.octet_length(text_col) <= longest)
    usable = docs.where(fit if labels is not None else fit & F.col(label).isNotNull())
    different = F.approx_count_distinct(F.xxhash64(id_col, text_col), 0.02)
    n, rows, size = usable.agg(F.count("*"), different, F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    size *= rows / max(n, 1)
    known = None
    if labels is not None:
        known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(label).alias("__label")).distinct()
        n_known = known.where(~held_out).count()
        size, rows = size * min(1.0, n_known / max(rows, 1)), min(rows, n_known)
    share = min(1.0, most_rows / max(rows, 1), most_bytes / max(size, 1))
    picked = usable.where(drawn_share(share, "labelled sample", id_col, text_col))
    if known is None:
        picked = picked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label).alias("label"))
    else:
        picked = picked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known.select(F.col(id_col).alias("id"), F.col("__label").alias("label")), "id")
    return picked.distinct().toArrow().sort_by([("id", "ascending"), ("text", "ascending"), ("label", "ascending")]).select(["text", "label"])
