"""Reading tables, and tables written to cut lineage.

``materialize`` writes Parquet below the folder named in ``spark.checkpoint.dir``
(all executors and the driver share it) and reads it back, so a lost executor
costs no more than the tasks it ran. Where the setting is unset, as in tests, a
folder of this session is used, on a local master alone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list] = []
#: Rows of a file, where a table's rows are known to be bounded: small tables are written in few
#: files. For rows of some 40 bytes; wide ones are in files of WIDE times fewer.
FILE_ROWS = 50_000
WIDE = 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, f"file://{tempfile.gettempdir()}/tidebar-{app}")
    return folder.rstrip("/")


class Workspace:
    """Written tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if _scopes:
            _scopes[-1].append(self)

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}".rstrip("/")

    def materialize(self, df: DataFrame, name: str, rows: int | None = None, wide: bool = False) -> DataFrame:
        """``rows``: a bound of its rows, for tables made behind a shuffle."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows * (WIDE if wide else 1) // FILE_ROWS)))
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; without names, all."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names or [""]:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Workspaces made inside are deleted at the end: what is wanted of them must be written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for work in _scopes.pop():
            work.drop()
