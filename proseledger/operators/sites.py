"""Exact figures of groups of paragraphs, such as sites: quantiles of their scores, and distinct texts that stand elsewhere too.

Unlike ``operators.sketches``, which estimates beyond what a sketch holds, these are exact at every size. No group is handed
to one task: equal scores and equal texts of a group are made one row first, and scores are ranked in bins.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..folders import staged

#: A group's scores are ranked in so many ranges of scores, each apart from the others.
BINS = 1024


def score_quantiles(rows: DataFrame, by: str, parts: dict[str, str]) -> DataFrame:
    """Of each group n (its scores) and, by name, the least of its scores that a part (a decimal, as text) of all its scores doesn't exceed; null without scores.

    The bin that holds a rank is told by the bins' sizes; only the scores in such bins are ranked. Any score has a bin, and larger
    ones none before it, so the result doesn't hang on how scores spread.
    """
    counts = rows.groupBy(by, "score").agg(F.count("score").alias("n"))
    bin_of = F.least(F.greatest(F.floor(F.col("score") * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts = staged(counts.withColumn("bin", F.when(F.col("score").isNotNull(), bin_of)), "score-counts")
    totals = counts.groupBy(by).agg(F.sum("n").alias("n"))

    sizes = counts.where(F.col("n") > 0).groupBy(by, "bin").agg(F.sum("n").alias("held"))
    group = Window.partitionBy(by)
    sizes = sizes.withColumns({"upto": F.sum("held").over(group.orderBy("bin")), "total": F.sum("held").over(group)})
    rank = lambda q: F.ceil(F.col("total").cast("decimal(20,0)") * F.lit(Decimal(q))).cast("long")  # noqa: E731 (decimals, so that nine tenths of ten are nine)
    ranks = [F.struct(F.lit(name).alias("name"), F.greatest(rank(q), F.lit(1)).alias("rank")) for name, q in parts.items()]
    before = F.col("upto") - F.col("held")
    wanted = sizes.select(by, "bin", before.alias("before"), F.explode(F.array(*ranks)).alias("x"), "upto").where((F.col("x.rank") > F.col("before")) & (F.col("x.rank") <= F.col("upto")))
    wanted = wanted.groupBy(by, "bin").agg(F.first("before").alias("before"), F.collect_list("x").alias("xs"))

    # null is a group like any other
    own = counts.where(F.col("n") > 0).withColumnsRenamed({by: "_by", "bin": "_bin"})
    near = own.join(wanted, F.col("_by").eqNullSafe(F.col(by)) & (F.col("_bin") == F.col("bin")))
    near = near.withColumn("at", F.col("before") + F.sum("n").over(Window.partitionBy(by, "bin").orderBy("score")))
    found = near.select(by, "score", "at", F.explode("xs").alias("x")).where(F.col("at") >= F.col("x.rank"))
    found = found.groupBy(F.col(by).alias("_by")).agg(*(F.min(F.when(F.col("x.name") == name, F.col("score"))).alias(name) for name in parts))
    return totals.join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", *parts)


def text_overlap(rows: DataFrame, others: DataFrame, by: str) -> DataFrame:
    """Of each group n_texts (its distinct texts) and n_shared (how many of them stand in ``others`` too), by text_sha256."""
    known = others.select("text_sha256").distinct().withColumn("known", F.lit(1))
    own = rows.select(by, "text_sha256").distinct()
    return own.join(known, "text_sha256", "left").groupBy(by).agg(F.count("*").alias("n_texts"), F.count("known").alias("n_shared"))
