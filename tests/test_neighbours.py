import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseledger.operators.runs import runs, smoothed
from proseledger.operators.scoring import HashStubScorer, score_paragraphs
from proseledger.operators.windows import score_long, word_windows

STUB = HashStubScorer()


def paragraphs(spark, texts):
    return spark.createDataFrame([("page", 1, k, "en", t) for k, t in enumerate(texts)], "source_kind string, source_id long, seq int, lang string, text string")


def slow_windows(text, most, overlap):
    words, at, out = text.split(" "), 0, []
    while True:
        start = len(" ".join(words[:at])) + (at > 0)
        cut = " ".join(words[at : at + most])
        out.append((cut, start, start + len(cut), len(words[at : at + most])))
        if at + most >= len(words):
            return out
        at += most - overlap


@pytest.mark.parametrize(("most", "overlap"), [(5, 2), (5, 0), (1, 0), (7, 6), (300, 60)])
def test_windows_as_brute_force(spark, most, overlap):
    r = random.Random(most)
    texts = [" ".join(r.choice(["a", "bé", "😀😀", "dddd"]) for _ in range(n)) for n in (1, 2, 4, 5, 6, 7, 8, 9, 11, 40)]
    got = {}
    for w in word_windows(paragraphs(spark, texts), most, overlap).orderBy("seq", "window").collect():
        got.setdefault(w.seq, []).append((w.text, w.start, w.end, w.n_words))
    assert got == {k: slow_windows(t, most, overlap) for k, t in enumerate(texts)}
    assert all(texts[k][s:e] == t for k, v in got.items() for t, s, e, _ in v)


def test_scores_are_means_by_length_and_short_texts_keep_theirs(spark):
    texts = ["short one", "w " * 30_000 + "end", " ".join(f"word{k}" for k in range(23))]
    rows = paragraphs(spark, texts)
    out = {x.seq: x for x in score_long(rows, STUB, 10, 3).collect()}
    plain = {x.seq: x for x in score_paragraphs(rows, STUB).collect()}
    assert (out[0].score, out[0].breakdown, out[0].klass, out[0].n_windows) == (plain[0].score, plain[0].breakdown, plain[0].klass, 1)
    for k in (1, 2):
        cut = slow_windows(texts[k], 10, 3) if k == 2 else None
        if cut:
            scores, parts = STUB.batch([c[0] for c in cut])
            weights = [c[3] for c in cut]
            assert out[k].n_windows == len(cut) and out[k].score == pytest.approx(np.average(scores, weights=weights)) and out[k].breakdown.ai == pytest.approx(np.average(parts[:, 3], weights=weights))
        assert out[k].score is not None and sum(out[k].breakdown) == pytest.approx(1) and out[k].reason is None


class Choosy(HashStubScorer):
    """Can't score texts of more than three words."""

    def columns(self, text):
        none = F.size(F.split(text, " ")) > 3
        score, parts = super().columns(text)
        return F.when(~none, score), F.when(~none, parts)


def test_a_window_without_a_score_counts_for_nothing(spark):
    rows = paragraphs(spark, ["a b c d e", "a b c d"])
    out = {x.seq: x for x in score_long(rows, Choosy(), 4, 1).collect()}
    assert out[0].score == pytest.approx(STUB.batch(["d e"])[0][0]) and out[1].score is None and out[1].breakdown is None and out[1].reason


def scored(spark, rows):
    return spark.createDataFrame(rows, "source_kind string, source_id long, seq int, score double, klass int")


@pytest.mark.parametrize("stretch", [3, 5, 4096])
def test_neighbours_across_stretches(spark, stretch):
    r = random.Random(stretch)
    rows = [("page", p, s, r.random(), r.choice([0, 3, 3])) for p in (1, 2) for s in range(40) if r.random() < 0.9] + [("document", 1, 7, 0.5, 3)]
    score = {(k, p, s): x for k, p, s, x, _ in rows}
    got = {(x.source_kind, x.source_id, x.seq): x for x in smoothed(scored(spark, rows), 2, stretch).collect()}
    assert len(got) == len(rows)
    for (k, p, s), x in got.items():
        assert x.smoothed == pytest.approx(np.mean([score[k, p, t] for t in range(s - 2, s + 3) if (k, p, t) in score]))
        assert x.change == (pytest.approx(x.score - score[k, p, s - 1]) if (k, p, s - 1) in score else None)
    want = {}
    for k, p, s, x, klass in sorted(rows):
        if klass == 3:
            first = want.pop((k, p, s - 1), (s, []))
            want[k, p, s] = (first[0], [*first[1], x])
    found = {(x.source_kind, x.source_id, x.last): (x.first, x.n, x.mean_score) for x in runs(scored(spark, rows), 3, stretch).collect()}
    assert found == {k: (f, len(v), pytest.approx(np.mean(v))) for k, (f, v) in want.items()}
