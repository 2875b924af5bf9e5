import random
import re

from pyspark.sql import functions as F
from test_operators import SCRAPS

from proseledger.functions.text import article_paragraphs
from proseledger.operators.places import held_by, holders, paragraph_places


def pages(spark, texts):
    return spark.createDataFrame([(k, "u", t) for k, t in enumerate(texts)], "page_id long, url string, html string")


def test_places_are_those_of_the_paragraphs(spark):
    r = random.Random(6)
    texts = ["".join(r.choices(SCRAPS, k=r.randint(0, 40))) for _ in range(300)] + [None, "", "<p> a <b>b</b>\n c </p>"]
    df = pages(spark, texts)
    want = {(x.page_id, x.seq): x.text for x in df.select("page_id", F.posexplode(article_paragraphs(F.col("html"))).alias("seq", "text")).collect()}
    got = paragraph_places(df).collect()
    assert {(x.source_id, x.seq): x.text for x in got} == want and len(want) > 200
    for x in got:
        part = texts[x.source_id][x.start : x.end]
        if not re.search("[<>&]", part):  # plain text stands there as it is
            assert re.sub(r"\s+", " ", part) == x.text
        assert 0 <= x.start < x.end <= len(texts[x.source_id]) and not part[0].isspace() and not part[-1].isspace()


def slow_holders(text, names):
    out, open_ = [], {n: [] for n in names}
    for m in re.finditer(r"<(/?)(\w+)[^>]*>", text):
        if m[2] in open_:
            if not m[1]:
                open_[m[2]].append((m.start(), len(out)))
                out.append([m[2], m.start(), len(text)])
            elif open_[m[2]]:
                out[open_[m[2]].pop()[1]][2] = m.end()
    return sorted(map(tuple, out))


def test_elements_and_who_holds_whom(spark):
    r = random.Random(7)
    scraps = ["<div>", "</div>", "<div a=1>", "<article>", "</article>", "<section>", "</section>", "text ", "<p>more", "x" * 50]
    texts = ["".join(r.choices(scraps, k=r.randint(0, 30))) for _ in range(200)]
    df = pages(spark, texts)
    found = {}
    for x in holders(df).collect():
        found.setdefault(x.source_id, []).append((x.element, x.start, x.end))
    names = ("article", "section", "main", "aside", "nav", "div")
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, t in enumerate(texts) if (v := slow_holders(t, names))}
    for width in (16, 1 << 14):
        for x in held_by(paragraph_places(df), holders(df), width).collect():
            inside = [(s, n) for n, s, e in slow_holders(texts[x.source_id], names) if s <= x.start < e]
            assert (x.element_start, x.element) == (max(inside) if inside else (None, None))


def test_no_cross_join(spark):
    df = pages(spark, ["<div><p>a</div>"])
    plan = held_by(paragraph_places(df), holders(df))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
