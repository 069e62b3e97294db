"""Columns computed from a text column in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_TEXT = "__text"
#: Bytes of an Arrow batch, about: texts, sets and vectors differ too much in size for a count of rows alone.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, or to less where it is set so."""
    now = spark.conf.get(_LIMIT).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def append_from_text(df: DataFrame, text_col: str, fields: list[StructField], compute: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns (or those in ``keep``) and ``fields``, which ``compute``
    makes from a batch of texts. A column of ``df`` with the name of a field
    gives way to it."""
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = StructType([*(df.schema[c] for c in kept), *fields])
    names = schema.names
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(_TEXT)).mapInArrow(run, schema)
