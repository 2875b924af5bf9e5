import os

from pyspark.sql import functions as F

from proseledger.operators.scoring import HashStubScorer
from proseledger.operators.upsert import read_upserted, upsert
from proseledger.streaming.pages import newest_summaries


def test_the_newest_version_of_a_page_counts_once(spark, tmp_path):
    def arrive(name, at, pages):
        rows = [(k, f"https://a.x/{k}", "<html lang=en>" + "".join(f"<p>{t}" for t in texts)) for k, texts in pages]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
        for f in (tmp_path / "in" / name).glob("*.parquet"):
            os.utime(f, (at, at))

    def run():
        out = newest_summaries(spark, str(tmp_path / "in" / "*"), HashStubScorer(), "1 hour", str(tmp_path / "out"), str(tmp_path / "state"), buckets=4)
        rows = out.collect()
        assert len({r.source_id for r in rows}) == len(rows)
        return {r.source_id: r.n_analyzed for r in rows}

    (tmp_path / "in" / "none").mkdir(parents=True)
    assert run() == {}
    arrive("a", 100_000, [(1, ["one"]), (2, ["one", "two"]), (3, [])])
    assert run() == {1: 1, 2: 2, 3: 0}
    arrive("b", 100_600, [(1, ["one", "more"]), (4, ["x"])])  # page 1 has changed
    arrive("c", 100_700, [(2, ["one", "two"])])  # page 2 is delivered again
    assert run() == {1: 2, 2: 2, 3: 0, 4: 1}
    arrive("d", 100_300, [(1, ["an", "older", "version"]), (5, ["late", "but", "new"])])
    assert run() == {1: 2, 2: 2, 3: 0, 4: 1, 5: 3}
    arrive("e", 100_900, [(4, [])])
    arrive("f", 100_950, [(1, ["a"] * 5), (1, ["a"] * 5)])
    assert run() == {1: 5, 2: 2, 3: 0, 4: 0, 5: 3}
    assert run() == {1: 5, 2: 2, 3: 0, 4: 0, 5: 3}


def test_only_touched_partitions_are_written(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.lit("old").alias("v"))
    path = str(tmp_path / "t")
    upsert(rows, path, "k", "at", 10)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    new = spark.createDataFrame([(5, 2, "new"), (5, 1, "no"), (6, 0, "older"), (7, 1, "equal")], "k long, at int, v string")
    upsert(new, path, "k", "at", 10)
    upsert(new, path, "k", "at", 10)  # repeated
    upsert(new.limit(0), path, "k", "at", 10)
    found = {r.k: r.v for r in read_upserted(rows, path).collect()}
    assert len(found) == 100 and found[5] == "new" and found[6] == "old" and found[7] == "equal" and found[8] == "old"
    kept = [p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]]
    assert len({p.parent for p in before}) - len({p.parent for p in kept}) <= 3
