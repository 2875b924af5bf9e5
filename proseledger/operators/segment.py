"""Pages and documents as ordered paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_paragraphs, line_paragraphs, page_language


def page_paragraphs(pages: DataFrame, headings: bool = False) -> DataFrame:
    """source_kind, source_id, seq (from 0), lang, text of every paragraph of every page. No shuffle."""
    return pages.select(F.lit("page").alias("source_kind"), F.col("page_id").alias("source_id"), page_language(F.col("html")).alias("lang"), F.posexplode(article_paragraphs(F.col("html"), headings)).alias("seq", "text")).select("source_kind", "source_id", "seq", "lang", "text")


def document_paragraphs(docs: DataFrame, kind: str = "document") -> DataFrame:
    """The same of every line of every document."""
    return docs.select(F.lit(kind).alias("source_kind"), F.col("doc_id").alias("source_id"), "lang", F.posexplode(line_paragraphs(F.col("text"))).alias("seq", "text")).select("source_kind", "source_id", "seq", "lang", "text")
