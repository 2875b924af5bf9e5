import numpy as np
import pytest
from pyspark.sql import functions as F

from proseledger.operators.sketches import merged_sketches, n_texts, page_sketches, score_quantile, shared_texts


def scored(spark, n, kind="page", start=0):
    """n paragraphs on seven pages, two of each text."""
    rows = spark.range(start, start + n).select(F.lit(kind).alias("source_kind"), (F.col("id") % 7).alias("source_id"), (F.xxhash64("id") / 2.0**64 + 0.5).alias("score"), F.sha2((F.col("id") / 2).cast("long").cast("string"), 256).alias("text_sha256"))
    return rows.withColumn("score", F.when(F.col("source_id") != 6, F.col("score")))


def test_merged_sketches_hold_what_all_pages_do(spark):
    rows = scored(spark, 3000)
    pages = page_sketches(rows)
    whole = merged_sketches(pages).select("n", n_texts().alias("texts"), *(score_quantile(q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 1.0)))).first()
    scores = sorted(r.score for r in rows.collect() if r.score is not None)
    assert (whole.n, whole.texts) == (len(scores), 1500)
    assert [whole.q0, whole.q1, whole.q2] == [scores[int(np.ceil(q * len(scores))) - 1] for q in (0.1, 0.5, 1.0)]
    none = pages.where(F.col("source_id") == 6).select(score_quantile(0.5).alias("q"), "n", n_texts().alias("t")).first()
    assert none.q is None and none.n == 0 and none.t > 0


def test_errors_are_bounded_beyond_what_a_sketch_holds(spark):
    rows = scored(spark, 60_000)
    whole = merged_sketches(page_sketches(rows, k=200, lg=10), lg=10).select("n", n_texts().alias("texts"), *(score_quantile(k / 20).alias(f"q{k}") for k in range(1, 20))).first()
    scores = np.sort([r.score for r in rows.collect() if r.score is not None])
    for k in range(1, 20):
        assert abs(np.searchsorted(scores, whole[f"q{k}"], "right") / len(scores) - k / 20) < 0.03
    assert whole.n == len(scores) and whole.texts == pytest.approx(30_000, rel=0.12)


def test_shared_texts(spark):
    pages, others = page_sketches(scored(spark, 2000)), page_sketches(scored(spark, 2000, "document", 1000))
    assert merged_sketches(pages).select(shared_texts(others).alias("n")).first().n == 500
    many = page_sketches(scored(spark, 40_000))  # more than the sketches of Spark's default size hold
    assert merged_sketches(many).select(n_texts().alias("n")).first().n == 20_000 and merged_sketches(pages).select(shared_texts(many).alias("n")).first().n == 1000
    assert merged_sketches(pages).select(shared_texts(others.where("1 = 0")).alias("n")).first().n == 0
