"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import shared_path, shared_root, staged, sweep

__all__ = ["batches_of", "column", "fresh_name", "held", "let_go", "shared_path", "shared_root", "staged", "sweep", "text_of"]

_held: tuple[Hashable, Any] | None = None


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this process for the tasks that follow until something else is asked for.

    So a Python worker that serves one operator after another holds the tables of one of them at a time.
    """
    global _held
    if _held is None or _held[0] != key:
        _held = None  # goes before the next one is made
        _held = key, make()
    return _held[1]


def let_go() -> None:
    """Drop what :func:`held` keeps; for tasks that need their memory for something else."""
    global _held
    _held = None


def text_of(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly that name, whatever marks it holds."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, upper and lower case being alike."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Jobs that start within hand Python so many rows at a time, of about ``size`` bytes at most; for rows that are large, since JVM and Python each hold a batch whole."""
    given = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {key: spark.conf.get(key) for key in given}
    for key, value in given.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
