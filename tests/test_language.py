from pyspark.sql import functions as F

from proseledger.operators.language import KEPT, detect, learn_profiles, with_language
from proseledger.plans.queries import language_confusion

TEXTS = [("en", "The house is by the river and the old bridge."), ("de", "Das Haus steht am Fluss und an der alten Brücke."), ("fr", "La maison est près de la rivière et du vieux pont."), (None, "ignored"), ("", "also ignored")]


def learned(spark, kept=KEPT):
    return learn_profiles(spark.createDataFrame(TEXTS * 3, "lang string, text string"), kept=kept)


def test_detects_and_tells_how_surely(spark):
    profiles = learned(spark)
    assert profiles.languages == ["de", "en", "fr"]
    rows = [(1, "the river house"), (2, "die alte Brücke am Haus"), (3, "près de la maison"), (4, None), (5, ""), (6, "日本語の文"), (7, "12 %%"), (8, "THE RIVER HOUSE"), (9, "the river house\n" * 20_000)]
    found = {r.k: r for r in detect(spark.createDataFrame(rows, "k long, text string"), profiles, ["k"]).collect()}
    assert [found[k].detected for k in range(1, 10)] == ["en", "de", "fr", None, None, None, None, "en", "en"]
    assert all(found[k].n_parts == 0 and found[k].margin is None for k in (4, 5, 6, 7))
    assert found[1].margin == found[8].margin == found[9].margin > 0 and found[9].n_parts == 20_000 * found[1].n_parts


def test_what_is_kept_is_bounded(spark):
    profiles = learned(spark, kept=5)
    assert 5 <= profiles.parts.count() <= 15
    none = learn_profiles(spark.createDataFrame([(None, "x")], "lang string, text string"))
    assert none.languages == [] and [r.detected for r in detect(spark.createDataFrame([(1, "x")], "k long, text string"), none, ["k"]).collect()] == [None]


def test_declared_languages_stay(spark):
    rows = [("page", 1, 0, "fr", "the river house"), ("page", 1, 1, "", "the river house"), ("page", 1, 2, None, "la vieille maison"), ("page", 1, 3, "", "!!")]
    out = with_language(spark.createDataFrame(rows, "source_kind string, source_id long, seq int, lang string, text string"), learned(spark), ["source_id", "seq"])
    assert {r.seq: r.lang for r in out.collect()} == {0: "fr", 1: "en", 2: "fr", 3: None}


def test_held_out_documents(spark):
    rows = language_confusion(spark, "/root/testdata/sf0.01").collect()
    right, total = sum(r.n for r in rows if r.lang == r.detected), sum(r.n for r in rows)
    assert total > 150 and right / total > 0.98


def test_profiles_are_broadcast_and_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "the river house")], "k long, text string")
    plan = detect(texts, learned(spark), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not any("Exchange hashpartitioning" in line and "text" in line for line in plan.splitlines())
    assert detect(texts, learned(spark), ["k"]).select(F.col("detected")).first()[0] == "en"
