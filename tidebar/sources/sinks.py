"""Writing results, caches and small records."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions.exprs import KEY, TIME


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """By symbol and month, so slices of either read no more than they need."""
    parted = df.withColumns({"year": F.year(TIME), "month": F.month(TIME)})
    parted.repartition(KEY, "year", "month").write.mode("overwrite").partitionBy(KEY, "year", "month").parquet(path)


def cached_features(spark: SparkSession, bars: DataFrame, config: FeatureConfig, folder: str, source: str, build: Callable[[DataFrame, FeatureConfig], DataFrame]) -> DataFrame:
    """Features written once for each configuration and source name, then read."""
    path = f"{folder}/{config.fingerprint()}-{source}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        write_parquet(build(bars, config), path)
    return spark.read.parquet(path).drop("year", "month")


def write_json(record: object, path: str) -> None:
    """A record on the driver: manifest, metrics, feature list."""
    value = dataclasses.asdict(record) if dataclasses.is_dataclass(record) else record  # type: ignore[call-overload]
    write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str))


def _store(path: str):
    spark = SparkSession.builder.getOrCreate()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(path: str, text: str) -> None:
    """A small file in any store that Spark knows."""
    _, p, fs = _store(path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(path: str) -> str:
    spark, p, fs = _store(path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def run_log(spark: SparkSession, path: str) -> list[dict]:
    """The records of ``append_run``, in no order."""
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


def append_run(spark: SparkSession, record: dict, path: str) -> None:
    """A row of the runs log, as JSON text."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").write.mode("append").text(path)
