"""Paragraphs that are longer than a model takes: overlapping windows, scored each, and their scores merged by length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import CacheTable
from .scoring import PARTS, Scorer, judged, score_paragraphs

KEYS = ("source_kind", "source_id", "seq")


def word_windows(paragraphs: DataFrame, most: int = 300, overlap: int = 60) -> DataFrame:
    """A row for each window: the paragraph's columns, with the window's text, and window (from 0), start, end (code points) and n_words.

    A paragraph of ``most`` words or fewer is one window. Others are cut every ``most`` - ``overlap`` words, the last window where the
    text ends. Words are what single spaces part, as paragraphs have them. No shuffle; work grows with the text.
    """
    step = most - overlap
    if not 0 <= overlap < most:
        raise ValueError("overlap must be less than a window")
    own, k = paragraphs.columns, F.col("_k")
    words = F.split(F.col("text"), " ")
    rows = paragraphs.withColumns({"_words": words, "_n": F.size(words)})
    last = F.greatest(F.ceil((F.col("_n") - most) / step), F.lit(0)).cast("int")
    # what the words before each window take, each with the space behind it
    sizes = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice("_words", i * step + 1, step), F.lit(0), lambda sum_, w: sum_ + F.length(w) + 1))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda found, size: F.concat(found, F.array(F.element_at(found, -1) + size)))
    rows = rows.withColumn("_starts", starts).select("*", F.posexplode(F.sequence(F.lit(0), last)).alias("_k", "_same"))
    part = F.slice("_words", k * step + 1, most)
    cut = F.array_join(part, " ")
    start = F.element_at("_starts", k + 1)
    return rows.select(*(F.col(c) for c in own if c != "text"), cut.alias("text"), k.alias("window"), start.alias("start"), (start + F.length(cut)).alias("end"), F.size(part).alias("n_words"))


def score_long(paragraphs: DataFrame, scorer: Scorer, most: int = 300, overlap: int = 60, cache: DataFrame | CacheTable | None = None) -> DataFrame:
    """As ``score_paragraphs``, with n_windows: every paragraph is scored in windows, and score and breakdown are their means by number of words.

    A paragraph of one window has that window's score. A window that the model can't score all the same counts for nothing; only a paragraph without a scored window has none.
    Sums are made before anything is joined back, so a paragraph's windows meet as one row for each task.
    """
    scored = score_paragraphs(word_windows(paragraphs, most, overlap).select(*KEYS, "text", "n_words"), scorer, cache)
    known = F.col("score").isNotNull()
    weight = F.sum(F.when(known, F.col("n_words")))
    mean = lambda x: (F.sum(F.when(known, x * F.col("n_words"))) / weight)
    parts = F.struct(*(mean(F.col("breakdown")[p]).alias(p) for p in PARTS))
    merged = scored.groupBy(*KEYS, "model_id").agg(mean(F.col("score")).alias("score"), parts.alias("_parts"), F.count("*").alias("n_windows"))
    merged = merged.select(*KEYS, "model_id", "score", F.when(F.col("score").isNotNull(), F.col("_parts")).alias("breakdown"), "n_windows")
    return judged(paragraphs.withColumn("text_sha256", F.sha2("text", 256)).join(merged, list(KEYS)), scorer)
