from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from proseledger.operators.sites import score_quantiles, text_overlap


def test_overlap_is_exact_beyond_what_a_sketch_holds(spark):
    """150,000 texts a group, of which a third are elsewhere too; set sketches of 2 ** 16 hashes gave estimates."""
    rows = spark.range(300_000).select((F.col("id") % 2).alias("host"), F.sha2((F.col("id") / 2).cast("long").cast("string"), 256).alias("text_sha256"))
    rows = rows.unionByName(rows.limit(1000))
    others = spark.range(100_000, 250_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"))
    assert sorted(map(tuple, text_overlap(rows, others.unionByName(others), "host").collect())) == [(0, 150_000, 50_000), (1, 150_000, 50_000)]
    assert sorted(map(tuple, text_overlap(rows, others.where("1 = 0"), "host").collect())) == [(0, 150_000, 0), (1, 150_000, 0)]


def test_quantiles_are_exact(spark):
    """Many distinct scores, most of them in one bin, ties, a group of few scores, of none and of null; more scores than a quantile sketch holds."""
    spread = F.xxhash64("id") / 2.0**64 + 0.5
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "wide").alias("host"), F.when(F.col("id") % 2 == 0, spread).when(F.col("id") % 3 == 0, 0.25).otherwise(0.99 + spread / 1e6).alias("score"))
    few = spark.createDataFrame([("ten", k / 10) for k in range(1, 11)] + [("one", 0.0), ("none", None), ("far", -3.0), ("far", 7.0), ("far", None)], "host string, score double")
    rows = rows.unionByName(few).repartition(5)
    own = defaultdict(list)
    for r in rows.collect():
        own[r.host] += [r.score] if r.score is not None else []
    parts = {"low": "0.1", "middle": "0.5", "high": "0.9", "all": "1.0"}
    want = {}
    for name, scores in own.items():
        scores.sort()
        places = [max(1, -(-len(scores) * Fraction(q) // 1)) - 1 for q in parts.values()]
        want[name] = (len(scores), *(scores[int(k)] if scores else None for k in places))
    assert {r.host: tuple(r)[1:] for r in score_quantiles(rows, "host", parts).collect()} == want
