"""Tables as DataFrames. Only the columns that a query uses are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import article_paragraphs, page_language


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files as rows of path, length and content; see ``pdf`` for their text."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "length", "content")


pdf_pages = pdf_files


def as_documents(files: DataFrame, lang: str = "en") -> DataFrame:
    """Files (path, value) as documents: HTML files by their paragraphs, one to a line, others as they are. doc_id is the path itself, since hashes of a billion paths may meet.

    The language is what an HTML file declares, and ``lang`` for all others.
    """
    html = F.lower("path").rlike(r"\.html?$")
    text = F.when(html, F.array_join(article_paragraphs(F.col("value")), "\n")).otherwise(F.coalesce("value", F.lit("")))
    declared = F.when(html, page_language(F.col("value")))
    rows = files.select(F.col("path").alias("source"), text.alias("text"), F.coalesce(F.nullif(declared, F.lit("")), F.lit(lang)).alias("lang"))
    return rows.select(F.col("source").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def exported_documents(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """Exported text and HTML files, one document each."""
    return as_documents(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), lang)
