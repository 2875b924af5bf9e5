"""Summaries of pages: counts, lists and reports of paragraphs that read as AI-generated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CLASSES

AI = len(CLASSES) - 1
CAVEAT = "Scores are estimates, not proof of authorship."


def page_summary(scored: DataFrame) -> DataFrame:
    """source_kind, source_id, n_analyzed, n_ai, ai_share and ai_paragraphs (seq, text, score; in page order) of every page or document.

    One shuffle. Paragraphs without a score (see ``scoring.OnnxScorer``) count as analyzed and never as AI-generated.
    """
    listed = F.collect_list(F.when(F.col("klass") == AI, F.struct("seq", "text", "score")))
    out = scored.groupBy("source_kind", "source_id").agg(F.count("*").alias("n_analyzed"), F.count_if(F.col("klass") == AI).alias("n_ai"), F.array_sort(listed).alias("ai_paragraphs"))
    return out.select("source_kind", "source_id", "n_analyzed", "n_ai", (F.col("n_ai") / F.col("n_analyzed")).alias("ai_share"), "ai_paragraphs")


def page_report(scored: DataFrame) -> DataFrame:
    """source_kind, source_id and report: a text with the counts, each listed paragraph with its chip, the model and the caveat."""
    line = F.when(F.col("klass") == AI, F.struct("seq", F.concat("chip", F.lit(" "), "text").alias("line")))
    out = scored.groupBy("source_kind", "source_id", "model_id").agg(F.count("*").alias("n"), F.count_if(F.col("klass") == AI).alias("n_ai"), F.array_sort(F.collect_list(line)).alias("lines"))
    head = F.concat(F.col("n_ai").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" paragraphs read as AI-generated"))
    tail = F.concat(F.lit("Model: "), F.col("model_id"), F.lit(". " + CAVEAT))
    return out.select("source_kind", "source_id", F.array_join(F.concat(F.array(head), F.transform("lines", lambda x: x["line"]), F.array(tail)), "\n").alias("report"))


def marks(scored: DataFrame, show: tuple[int, ...] = (0, 1, 2, 3), breakdown: bool = True) -> DataFrame:
    """The chips to show: of the chosen classes, with or without the four parts."""
    parts = [F.col("breakdown")[k].alias(k) for k in ("human", "light", "heavy", "ai")] if breakdown else []
    return scored.where(F.col("klass").isin(list(show))).select("source_kind", "source_id", "seq", "chip", "klass", *parts)
