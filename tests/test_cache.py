import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from proseledger.operators.cache import CacheTable
from proseledger.operators.scoring import HashStubScorer, score_paragraphs
from proseledger.streaming.live_cache import live_scores

STUB = HashStubScorer()
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this module


class Counted(HashStubScorer):
    """Refuses texts that it was told to have been scored already."""

    def __init__(self, known):
        self.known = known

    def columns(self, text):
        return None

    def batch(self, texts):
        assert not self.known & set(texts) and len(texts) == len(set(texts))
        return super().batch(texts)


def paragraphs(spark, n, copies=1):
    return spark.range(n * copies).select(F.lit("page").alias("source_kind"), F.col("id").alias("source_id"), F.lit(0).alias("seq"), F.lit("en").alias("lang"), F.concat(F.lit("text "), (F.col("id") % n).cast("string")).alias("text"))


@pytest.fixture
def held(spark, tmp_path):
    return CacheTable(spark, str(tmp_path / "cache"), 4)


def test_only_misses_are_scored_and_each_text_has_one_entry(spark, held):
    held.append(score_paragraphs(paragraphs(spark, 30), STUB))
    held.append(score_paragraphs(paragraphs(spark, 10), STUB))
    assert held.read().count() == 40 and held.entries(STUB.model_id).count() == 30 and held.entries("other").count() == 0
    found = score_paragraphs(paragraphs(spark, 50, copies=3), Counted({f"text {k}" for k in range(30)}), held)
    want = score_paragraphs(paragraphs(spark, 50, copies=3), STUB)
    assert sorted((r.source_id, r.score, r.chip) for r in found.collect()) == sorted((r.source_id, r.score, r.chip) for r in want.collect())
    _, misses = held.lookup(paragraphs(spark, 50).withColumn("text_sha256", F.sha2("text", 256)), STUB.model_id)
    assert misses.count() == 20


def exchanges_over_the_cache(plan):
    """Exchanges that stand above the scan of the cache, by the indents of the plan."""
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "Bucketed: true" in line)
    indent = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = [], indent(lines[at])
    for line in reversed(lines[:at]):
        if indent(line) < level:
            level = indent(line)
            above.append(line)
    return [line for line in above if "Exchange" in line]


@pytest.mark.parametrize("partitions", [2, 4, 64])
def test_the_cache_is_not_shuffled(spark, held, partitions):
    held.append(score_paragraphs(paragraphs(spark, 30), STUB))
    rows = paragraphs(spark, 50).withColumn("text_sha256", F.sha2("text", 256))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for part in (*held.lookup(rows, STUB.model_id), held.entries(STUB.model_id)):
            assert exchanges_over_the_cache(part._jdf.queryExecution().executedPlan().toString()) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_compaction(spark, held, tmp_path):
    for n in (30, 30, 20):
        held.append(score_paragraphs(paragraphs(spark, n), STUB))
    before = sorted(map(str, held.entries(STUB.model_id).collect()))
    for version in (1, 2, 3):
        held.compact()
        assert held.version == version and held.read().count() == 30
    assert sorted(map(str, held.entries(STUB.model_id).collect())) == before
    held.drop_old()
    folders = {p.name: len([*p.glob("*.parquet")]) for p in (tmp_path / "cache").iterdir()}
    assert folders == {"version-2": 4, "version-3": 4}  # a file for each bucket
    (tmp_path / "cache" / "version-9").mkdir()  # a compaction that was lost on the way
    again = CacheTable(spark, held.path, 4)
    assert again.version == 3 and again.read().count() == 30


def test_a_live_entry_is_taken_and_an_expired_one_scored_again(spark, tmp_path):
    def arrive(name, pages):
        rows = [(k, f"https://a.x/{k}", f"<html lang=en><p>{text}") for k, text in pages]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run(ttl_ms, scorer=STUB):
        out = live_scores(spark, str(tmp_path / "in" / "*"), scorer, ttl_ms, str(tmp_path / "out"), str(tmp_path / "state"))
        return {r.source_id: (r.fresh, r.score) for r in out.collect()}

    arrive("a", [(1, "one"), (2, "two"), (3, "one")])
    first = run(20_000)
    began = time.time()
    assert {k: v[0] for k, v in first.items()} == {1: True, 2: True, 3: True} and first[1] == first[3]
    arrive("b", [(4, "one"), (5, "three")])
    second = run(20_000, Counted({"one", "two"}))  # restarted from the checkpoint, the entries are still there
    assert {k: v[0] for k, v in second.items()} == {1: True, 2: True, 3: True, 4: False, 5: True} and second[4][1] == first[1][1]
    time.sleep(max(0, began + 21 - time.time()))
    arrive("c", [(6, "one")])
    third = run(20_000)
    assert third[6] == (True, first[1][1]) and len(third) == 6


class Together(HashStubScorer):
    """Its score is the number of texts that were handed over together."""

    def columns(self, text):
        return None

    def batch(self, texts):
        assert len(texts) == len(set(texts)) <= 64
        return np.full(len(texts), float(len(texts))), np.full((len(texts), 4), 0.25)


def test_live_texts_are_scored_by_buckets(spark, tmp_path):
    """One call for each bucket and not for each text, each text once, and later batches find every entry of their buckets."""
    arrive = lambda name, rows: spark.createDataFrame([(k, f"https://a.x/{k}", f"<html lang=en><p>text {n}") for k, n in rows], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    run = lambda: live_scores(spark, str(tmp_path / "in" / "*"), Together(), 3_600_000, str(tmp_path / "out"), str(tmp_path / "state"), buckets=4).collect()
    arrive("a", [(k, k % 100) for k in range(300)])
    first = run()
    assert len(first) == 300 and all(r.fresh for r in first) and min(r.score for r in first) > 5
    own = {r.text_sha256: r.score for r in first}
    assert len(own) == 100
    arrive("b", [(1000 + k, 50 + k) for k in range(100)])
    second = [r for r in run() if r.source_id >= 1000]
    assert len(second) == 100 and sum(r.fresh for r in second) == 50
    assert all(r.fresh == (r.text_sha256 not in own) and (r.fresh or r.score == own[r.text_sha256]) for r in second)
