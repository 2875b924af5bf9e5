"""Which pages and paragraphs are looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import host


def granted(pages: DataFrame, grants: DataFrame) -> DataFrame:
    """Pages of sites that are granted (column host). Spark broadcasts the grants if they are small."""
    return pages.join(grants.select(F.col("host").alias("_host")).distinct(), host(F.col("url")) == F.col("_host"), "left_semi")


def admitted(pages: DataFrame, grants: DataFrame, single: list[int] | None = None) -> DataFrame:
    """Granted pages, and single pages that are analyzed without a grant; each page once."""
    if not single:
        return granted(pages, grants)
    ones = pages.where(F.col("page_id").isin(single))
    rest = granted(pages.where(~F.coalesce(F.col("page_id").isin(single), F.lit(False))), grants)
    return rest.unionByName(ones)


def analyzable(paragraphs: DataFrame, lang: str = "en", min_chars: int = 1) -> DataFrame:
    """Paragraphs in the language, of the least length."""
    return paragraphs.where((F.col("lang") == lang) & (F.length("text") >= min_chars))
