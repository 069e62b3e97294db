"""Spark rows against DuckDB rows, without regard to order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def canonical(df):
    out = df[sorted(df.columns)].copy()
    for c in out:
        if pd.api.types.is_numeric_dtype(out[c]) and out[c].dtype != bool:
            out[c] = out[c].astype(float)
        else:
            out[c] = out[c].map(lambda v: "" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
    order = out.apply(lambda s: s.round(4) if s.dtype == float else s).sort_values(list(out.columns)).index
    return out.loc[order].reset_index(drop=True)


def assert_same(spark_df, sql, db):
    a, b = canonical(spark_df.toPandas()), canonical(db.sql(sql).df())
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-4, rtol=1e-6)
