"""Summaries that merge: quantiles of scores and distinct texts of pages, added up to sites without reading the pages again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores that a quantile sketch holds before it begins to estimate; its error of rank is then about 2.3 / k ** 0.9 (0.13 % here).
SCORES_K = 4096
#: As a power of two, texts that a set sketch holds before it begins to estimate; its error is then about 1 / sqrt(k) (0.4 % here).
TEXTS_LG = 16


def page_sketches(scored: DataFrame, k: int = SCORES_K, lg: int = TEXTS_LG) -> DataFrame:
    """source_kind, source_id, n, scores and texts: of every page a sketch of its scores and one of its distinct texts' hashes. To be stored."""
    known = F.col("score").isNotNull()
    sketches = [F.kll_sketch_agg_double(F.when(known, F.col("score")), F.lit(k)).alias("scores"), F.theta_sketch_agg("text_sha256", F.lit(lg)).alias("texts")]
    return scored.groupBy("source_kind", "source_id").agg(F.count_if(known).alias("n"), *sketches)


def merged_sketches(sketches: DataFrame, *by: str, lg: int = TEXTS_LG) -> DataFrame:
    """The same of groups of pages (such as sites), from the pages' sketches alone; of all together without ``by``."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("scores").alias("scores"), F.theta_union_agg("texts", F.lit(lg)).alias("texts"))


def score_quantile(part: float, sketch: str = "scores") -> Column:
    """The score that a part of all scores doesn't exceed; null without scores."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(part)))


def n_texts(sketch: str = "texts") -> Column:
    return F.theta_sketch_estimate(sketch)


def shared_texts(others: DataFrame, sketch: str = "texts") -> Column:
    """How many texts of a sketch the pages of ``others`` have too. Their sketches are merged to one, of at most 2 ** ``TEXTS_LG`` hashes, that goes to all tasks."""
    all_others = others.agg(F.theta_union_agg("texts", F.lit(TEXTS_LG)).alias("texts")).first()["texts"]
    if all_others is None:
        return F.lit(0).cast("long")
    return F.theta_sketch_estimate(F.theta_intersection(sketch, F.lit(bytes(all_others))))
