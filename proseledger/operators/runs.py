"""Scores of neighbouring paragraphs: smoothed by a frame, and runs of paragraphs that read alike.

Paragraphs are dealt out by page and stretches of ``STRETCH`` paragraphs, each with copies of the few beyond its ends that it needs, so a page of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("source_kind", "source_id")
STRETCH = 4096


def smoothed(scored: DataFrame, reach: int = 1, stretch: int = STRETCH) -> DataFrame:
    """source_kind, source_id, seq, score, smoothed (the mean over ``reach`` paragraphs before and after, by seq) and change (from the paragraph just before, null without one)."""
    if not 0 < reach < stretch:
        raise ValueError("reach must be positive and less than a stretch")
    rows = scored.select(*PAGE, "seq", "score")
    home = F.floor(F.col("seq") / stretch)
    copies = F.array_distinct(F.array(home, F.floor((F.col("seq") - reach) / stretch), F.floor((F.col("seq") + reach) / stretch)))
    dealt = rows.withColumn("_home", home).withColumn("_at", F.explode(copies))
    near = Window.partitionBy(*PAGE, "_at").orderBy("seq")
    before = F.when(F.lag("seq").over(near) == F.col("seq") - 1, F.lag("score").over(near))
    out = dealt.withColumns({"smoothed": F.avg("score").over(near.rangeBetween(-reach, reach)), "change": F.col("score") - before})
    return out.where(F.col("_at") == F.col("_home")).select(*PAGE, "seq", "score", "smoothed", "change")


def _islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (first, last, n, total) that follow each other without a gap, as one."""
    order = Window.partitionBy(*by).orderBy("first")
    begins = F.coalesce(F.lag("last").over(order) != F.col("first") - 1, F.lit(True)).cast("int")
    numbered = rows.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
    return numbered.groupBy(*by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("total").alias("total")).drop("_run")


def runs(scored: DataFrame, least_class: int = 3, stretch: int = STRETCH) -> DataFrame:
    """source_kind, source_id, first, last (seq), n and mean_score of every run of paragraphs of ``least_class`` or above.

    Runs within a stretch are done; those that reach its ends, at most two for each stretch, are joined across stretches.
    """
    one = scored.where(F.col("klass") >= least_class).select(*PAGE, F.floor(F.col("seq") / stretch).alias("_at"), F.col("seq").alias("first"), F.col("seq").alias("last"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total"))
    inner = _islands(one, [*PAGE, "_at"])
    edge = (F.col("first") == F.col("_at") * stretch) | (F.col("last") == (F.col("_at") + 1) * stretch - 1)
    across = _islands(inner.where(edge).drop("_at"), [*PAGE])
    return inner.where(~edge).drop("_at").unionByName(across).select(*PAGE, "first", "last", "n", (F.col("total") / F.col("n")).alias("mean_score"))
