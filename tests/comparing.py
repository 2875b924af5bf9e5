"""Comparison of a query with its SQL in DuckDB, without regard to order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if hasattr(v, "item") and not isinstance(v, str):
            v = v.item()
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v

    columns = sorted(frame.columns)
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].itertuples(index=False))


def same(spark, sf_dir: str, query, sql: str) -> None:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    ours, theirs = query(spark, sf_dir).toPandas(), db.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
