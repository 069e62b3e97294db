"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, content, n_tokens) keyed by the
SHA-256 of the tokenizer (library, its version, the file's bytes) and of the
content. Texts are compared as the tokenizer reads them: a null is the empty
text; nothing else is folded, since spaces, case and forms all change counts.
Distinct contents that the cache lacks are encoded once each and appended; the
counts then come from the cache by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: A tokenizer file is broadcast to the executors; a larger one is refused.
MOST_TOKENIZER_BYTES = 64 << 20
#: Texts given to the library in one call.
CHUNK_BYTES = 4 << 20
CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"


def _library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_digest(path: str) -> str:
    name = _library(path)
    return hashlib.sha256(f"{name} {version(name)} plain\n".encode() + Path(path).read_bytes()).hexdigest()


def counter(library: str, proto: bytes) -> Callable[[list[str]], list[int]]:
    """Token counts of texts, without special tokens, truncation or padding."""
    if library == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(proto.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_bytes long (UTF-8) and n_tokens long of every whole text.

    ``cache_path``: the cache's folder, in storage that all executors share; it
    is made if it isn't there. Null and empty texts have 0 bytes and the count
    of the empty text. Repeated texts are encoded once, however many rows hold
    them; rows stay as many as they are. Columns of ``docs`` named n_bytes or
    n_tokens are replaced. Runs that append to one cache at once may store a
    content twice; readers take one."""
    spark = docs.sparkSession
    library, proto = _library(tokenizer_path), Path(tokenizer_path).read_bytes()
    if len(proto) > MOST_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path}: over {MOST_TOKENIZER_BYTES} bytes")
    digest, model = tokenizer_digest(tokenizer_path), spark.sparkContext.broadcast(proto)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    content = F.unhex(F.sha2(text, 256))

    def stored() -> DataFrame:
        if not _exists(spark, cache_path):
            return spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == digest).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(library, model.value)
        for batch in batches:
            counts = [n for chunk in _chunks(batch.column(1).to_pylist()) for n in count(chunk)]
            yield pa.RecordBatch.from_arrays([pa.array([digest] * len(counts), pa.string()), batch.column(0), pa.array(counts, pa.int64())], names=["tokenizer", "content", "n_tokens"])

    distinct = docs.select(content.alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(stored().select("content"), "content", "left_anti") if _exists(spark, cache_path) else distinct
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("__content"))
    # A written table: Spark splits a hot content's rows only if no aggregate stands between the shuffle and the join.
    counts = Workspace(spark, "tokencount").materialize(stored().withColumnRenamed("content", "__content"), "counts")
    return rows.join(counts, "__content").select(*(F.col(f"`{c}`") for c in kept), "n_bytes", "n_tokens")
