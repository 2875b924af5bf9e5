import hashlib
import json
import struct
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseledger.functions.marks import chip, class_by_breakdown, class_by_score
from proseledger.functions.text import article_paragraphs, line_paragraphs, page_language
from proseledger.operators import cache
from proseledger.operators.filters import admitted, analyzable
from proseledger.operators.report import page_report, page_summary
from proseledger.operators.scoring import HashStubScorer, OnnxScorer, score_paragraphs, scorer, verified_manifest
from proseledger.operators.segment import page_paragraphs
from proseledger.plans.queries import _BatchedStub as Batched
from proseledger.sources.tables import table


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("score", "text"), [(0.0, ".00"), (0.004, ".00"), (0.005, ".01"), (0.5, ".50"), (0.994, ".99"), (0.995, "1.0"), (1.0, "1.0")])
def test_chip(spark, score, text):
    assert one(spark, chip, score, "double") == text


def test_classes(spark):
    rows = spark.createDataFrame([(s,) for s in (0.0, 0.24, 0.25, 0.5, 0.75, 1.0)], "s double")
    assert [r[0] for r in rows.select(class_by_score(F.col("s"))).collect()] == [0, 0, 1, 2, 3, 3]
    parts = spark.createDataFrame([((0.4, 0.4, 0.1, 0.1),), ((0.1, 0.2, 0.3, 0.4),), ((0.25, 0.25, 0.25, 0.25),)], "b struct<human:double,light:double,heavy:double,ai:double>")
    assert [r[0] for r in parts.select(class_by_breakdown(F.col("b"))).collect()] == [0, 3, 0]


@pytest.mark.parametrize(
    ("html", "paragraphs"),
    [
        (None, []),
        ("", []),
        ("<p>outside</p>", ["outside"]),
        ("<p>hello<p>there", ["hello", "there"]),
        ("<title>Name</title><p>text", ["text"]),
        ("<ul><li>item one</li><li>item two</li></ul><div>a</div><div>b<table><tr><td>c<td>d</table>", ["item one", "item two", "a", "b", "c", "d"]),
        ("<article>a<article>b</article>after</article>out", ["a", "b", "after"]),
        ("</article>x<article>y</article>z", ["y"]),
        ("<!-- <p>no</p> --><p>x<!-- > --> z<!---->", ["x z"]),
        ("<template><article><p>t</p></article></template><p>s", ["s"]),
        ("<p title='a>b' id=\"x>y\">text</p>", ["text"]),
        ('<a title="x>y', ["y"]),
        ("<p don't>it's", ["it's"]),
        ("a < b && c", ["a < b && c"]),
        ("<p>a <svg/>b<svg><g><svg></svg></g><text>no</text></svg>c <b>d</b>e</p>", ["a bc de"]),
        ("<h1>Head<p>para<h2>Next</h2>more", ["para", "more"]),
        ("<script>if (a < b) x = '<p>'</SCRIPT ><style>p{}</style>ok<textarea><p>no</textarea>", ["ok"]),
        ("<p>&rarr; &Eacute;&nbsp;&AElig; &nope; &am<b>p;</b> &amp;rarr; a&b;&shy;</p>", ["→ É Æ &nope; &amp; &rarr; a&b;"]),
        ("<p>a" + "<b>x</b>" * 3000 + " y='" + "=" * 5000 + "</p>", ["a" + "x" * 3000 + " y='" + "=" * 5000]),
        ("<p " + "a='>' " * 2000 + ">t</p>", None),
        ("<article><p>one</p><p> two <b>bold</b> </p></article>", ["one", "two bold"]),
        ('<script>var t="</p>";</script><article><h1>Head</h1><p>a<br>b<p>c</article>', ["a b", "c"]),
        ("<article><P class=x>A &amp;lt; B &quot;C&quot;</P><pre>code</pre></article>", ['A &lt; B "C"', "code"]),
        ("<article><p>  </p></article>", []),
        ("<html><body class='x'><p>no article</p><p>two</body></html>", ["no article", "two"]),
        ("<body><nav>x</nav><article><p>one</p></article><aside>no</aside><article id=2>two<p>three</article></body>", ["one", "two", "three"]),
        ("<article><p>unclosed", ["unclosed"]),
        ("<articles>x</articles><body>b</body>", ["x", "b"]),
        ("<article>It&#39;s &#x2014; &mdash;&hellip; &#128512; &#xD800; &#0; &#9999999; &#; &#38;lt; &amp;#39; &#38;amp; &apos;</article>", ["It's — —… 😀 &#xD800; &#0; &#9999999; &#; &lt; &#39; &amp; '"]),
    ],
)
def test_article(spark, html, paragraphs):
    found = one(spark, article_paragraphs, html)
    assert found == paragraphs or paragraphs is None and found  # beyond 300 values in a tag quotes no longer count


def test_headings(spark):
    html = "<h1>One</h1>a<h2>Two<br>lines<p>b<article><h3>Three</h3></article>"
    assert one(spark, lambda x: article_paragraphs(x, headings=True), html) == ["Three"]
    assert one(spark, lambda x: article_paragraphs(x, headings=True), html.replace("article", "div")) == ["One", "a", "Two lines", "b", "Three"]
    assert one(spark, article_paragraphs, html) == []


#: Pieces of pages, put together at random.
SCRAPS = ["<p>", "</p>", "<article>", "</article>", "<article id='>'>", "<div class=\"a>b\">", "</div>", "<template>", "</template>", "<svg>", "<svg/>", "</svg>", "<h2>", "</h2>", "<b>", "</b>", "<br/>", "<!-- x -->", "<!DOCTYPE html>", "<script>x<y</script>", "text ", "more\n", "&amp;lt;", "&#x41;", "&eacute;", "&", "<", ">", "<li>", "<html lang=en>", "</body>", "<noscript>", "</noscript>"]


def test_random_pages_same_as_sql(spark, tmp_path):
    import random

    from comparing import same

    from proseledger.plans.oracle import ORACLE_SQL
    from proseledger.plans.queries import QUERIES

    r = random.Random(5)
    rows = [(k, "https://a.x/", "".join(r.choices(SCRAPS, k=r.randint(0, 40)))) for k in range(400)] + [(400, "https://a.x/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name in "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split():
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    for name in ("page_paragraphs", "page_paragraphs_with_headings"):
        same(spark, str(tmp_path), QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize(("html", "lang"), [('<html lang="en">', "en"), ("<html lang='DE-at'>", "de"), ("<html dir=ltr lang=fr>", "fr"), ("<html>", ""), ("<html data-lang='x' lang = 'es'>", "es")])
def test_language(spark, html, lang):
    assert one(spark, page_language, html) == lang


def test_pages_and_documents_of_one_number_are_two(spark):
    rows = spark.createDataFrame([(kind, 5, k, "en", f"{kind} text {k}") for kind in ("page", "document") for k in range(3)], "source_kind string, source_id long, seq int, lang string, text string")
    scored = score_paragraphs(rows, scorer("stub"))
    assert sorted((r.source_kind, r.n_analyzed) for r in page_summary(scored).collect()) == [("document", 3), ("page", 3)]
    assert page_report(scored).count() == 2


def test_stream_of_no_files(spark, tmp_path):
    from proseledger.streaming.pages import page_summaries

    (tmp_path / "in").mkdir()
    out = page_summaries(spark, str(tmp_path / "in"), scorer("stub"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.columns == ["source_id", "n_analyzed", "n_ai", "ai_share"] and out.count() == 0


def field(number, value):
    """A field of a protocol buffer: whole numbers, texts, bytes and single floats' bytes."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def tiny_model(weights):
    """An ONNX file: the mean of the ids, times four weights."""
    node = lambda kind, given, out, *attributes: field(1, b"".join(field(1, g) for g in given) + field(2, out) + field(4, kind) + b"".join(field(5, a) for a in attributes))
    typed = lambda name, kind, dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, b"".join(field(1, field(2, d)) for d in dims))))
    to_float = field(1, "to") + field(3, 1) + field(20, 2)
    axes = field(1, "axes") + field(8, 1) + field(20, 7)
    weight = field(1, 1) + field(1, 4) + field(2, 1) + field(8, "w") + field(9, struct.pack("<4f", *weights))
    nodes = node("Cast", ["input_ids"], "x", to_float) + node("ReduceMean", ["x"], "m", axes) + node("MatMul", ["m", "w"], "logits")
    graph = nodes + field(2, "g") + field(5, weight) + field(11, typed("input_ids", 7, ["b", "n"])) + field(11, typed("attention_mask", 7, ["b", "n"])) + field(12, typed("logits", 1, ["b", "four"]))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


@pytest.fixture
def model_folder(tmp_path):
    import public_tokenizers

    (tmp_path / "m.onnx").write_bytes(tiny_model([0.0, 1e-4, 2e-4, 3e-4]))
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json"))
    files = [{"path": str(p), "bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in (tmp_path / "m.onnx", vocabulary)]
    (tmp_path / "manifest.json").write_text(json.dumps({"model_id": "tiny", "model": "m.onnx", "tokenizer": str(vocabulary), "files": files}))
    return tmp_path


def test_a_model_scores_paragraphs(spark, model_folder):
    """Through a real model file, with a paragraph that is too long for it."""
    from tokenizers import Tokenizer

    model = scorer("onnx", manifest=str(model_folder / "manifest.json"), max_tokens=20)
    texts = ["one short text", "another, of some more words", "word " * 50, "one short text", "y"]
    rows = spark.createDataFrame([("page", 1, k, "en", t) for k, t in enumerate(texts)], "source_kind string, source_id long, seq int, lang string, text string")
    tokenizer = Tokenizer.from_file(json.loads((model_folder / "manifest.json").read_text())["tokenizer"])
    for r in score_paragraphs(rows, model).collect():
        ids = tokenizer.encode(r.text).ids
        if len(ids) > 20:
            assert (r.score, r.breakdown, r.klass, r.chip, r.reason) == (None, None, None, None, "longer than the model takes")
            continue
        shares = np.exp(np.arange(4) * 1e-4 * np.mean(ids))  # the batch's padding changes a mean, but not in batches of one length
        assert r.model_id == "tiny" and r.reason is None and abs(sum(r.breakdown) - 1) < 1e-6
        if len(texts) == 5 and r.text == "y":
            continue
        assert 0 <= r.score <= 1 and r.klass in range(4) and np.argsort(r.breakdown).tolist() == np.argsort(shares).tolist()
    alone, parts = model.batch(["one short text"])
    ids = tokenizer.encode("one short text").ids
    shares = np.exp(np.arange(4) * 1e-4 * np.mean(ids))
    assert np.allclose(parts[0], shares / shares.sum(), atol=1e-5) and abs(alone[0] - parts[0] @ np.arange(4) / 3) < 1e-9
    with pytest.raises(ValueError, match="tokens"):
        OnnxScorer(str(model_folder / "manifest.json"), 20, "raise").batch(texts)
    assert page_summary(score_paragraphs(rows, model)).first().n_analyzed == 5


def test_pdf_files(spark, tmp_path):
    import zlib

    from proseledger.sources.pdf import StubPdfParser, parsed_pdfs, stub_pdf
    from proseledger.sources.tables import pdf_files

    (tmp_path / "a.pdf").write_bytes(one(spark, stub_pdf, "first é😀\nsecond (line)"))
    packed = zlib.compress(b"BT (plain \\(one\\)) Tj 0 -12 Td (two) Tj ET")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.5\n1 0 obj <<>> stream\n" + packed + b"\nendstream endobj")
    (tmp_path / "c.pdf").write_bytes(b"no PDF at all")
    rows = {r.path[-5:]: (r.text, r.lang, r.error) for r in parsed_pdfs(pdf_files(spark, str(tmp_path)), StubPdfParser()).collect()}
    assert rows == {"a.pdf": ("first é😀\nsecond (line)", "en", None), "b.pdf": ("plain (one)\ntwo", "en", None), "c.pdf": (None, "en", "not a PDF file")}


def test_exported_html(spark, tmp_path):
    from proseledger.sources.tables import exported_documents

    (tmp_path / "a.html").write_text("<html lang='de'><body><p>eins<p>zwei</body></html>")
    (tmp_path / "b.HTM").write_text("<p>nothing around it</p>")
    (tmp_path / "c.txt").write_text("<p>as it is</p>")
    got = {r.source[-5:]: (r.lang, r.text) for r in exported_documents(spark, str(tmp_path)).collect()}
    assert got == {".html": ("de", "eins\nzwei"), "b.HTM": ("en", "nothing around it"), "c.txt": ("en", "<p>as it is</p>")}


def test_lines(spark):
    assert one(spark, line_paragraphs, " a  b \n\n\tc\n") == ["a b", "c"]
    assert one(spark, line_paragraphs, None) == []


def test_admission(spark):
    pages = spark.createDataFrame([(1, "https://a.x/1", ""), (2, "https://b.x/2", ""), (3, None, ""), (2, "https://b.x/2", "")], "page_id long, url string, html string")
    grants = spark.createDataFrame([("a.x",), ("a.x",)], "host string")
    assert sorted(r.page_id for r in admitted(pages, grants).collect()) == [1]
    assert sorted(r.page_id for r in admitted(pages, grants, [1, 3]).collect()) == [1, 3]


def test_properties_of_scores(spark, sf):
    scored = score_paragraphs(analyzable(page_paragraphs(table(spark, sf, "pages"))), scorer("stub"))
    bad = scored.where(~F.col("score").between(0, 1) | ~F.col("klass").between(0, 3) | (F.abs(F.aggregate(F.array("breakdown.human", "breakdown.light", "breakdown.heavy", "breakdown.ai"), F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6))
    assert bad.count() == 0
    summary = page_summary(scored)
    assert summary.where((F.col("n_ai") > F.col("n_analyzed")) | (F.col("n_ai") != F.size("ai_paragraphs"))).count() == 0
    assert page_report(scored).where(F.col("report").contains("stub-md5")).count() == summary.count()


@given(st.lists(st.text(max_size=30), max_size=8))
@settings(max_examples=30, deadline=None)
def test_stub_in_batches(texts):
    score, parts = HashStubScorer().batch(texts)
    assert len(score) == len(parts) == len(texts)
    assert all(0 <= s <= 1 for s in score) and all(abs(p.sum() - 1) < 1e-9 for p in parts)


def test_cold_and_warm_cache_agree(spark, sf, tmp_path):
    rows = analyzable(page_paragraphs(table(spark, sf, "pages")))
    found = lambda scored: sorted(map(tuple, scored.select("source_id", "seq", "text_sha256", "score", "klass", "chip").collect()))
    cold = found(score_paragraphs(rows, Batched()))
    cache.append_cache(score_paragraphs(rows.where(F.col("source_id") < 20), Batched()), str(tmp_path / "c"))
    assert cold == found(score_paragraphs(rows, Batched(), cache.read_cache(spark, str(tmp_path / "c"))))
    assert cold == found(score_paragraphs(rows, HashStubScorer()))


def test_a_damaged_copy_ends_the_job_before_any_score(spark, model_folder):
    from proseledger.operators.scoring import ready_everywhere

    model = OnnxScorer(str(model_folder / "manifest.json"))
    assert ready_everywhere(spark, str(model_folder / "manifest.json")) == spark.sparkContext.defaultParallelism
    (model_folder / "m.onnx").write_bytes(tiny_model([0.0, 1e-4, 2e-4, 9e-4]))
    rows = spark.createDataFrame([("page", 1, 0, "en", "some text")], "source_kind string, source_id long, seq int, lang string, text string")
    with pytest.raises(ValueError, match="not ready: .*isn't the file that the manifest pins"):
        score_paragraphs(rows, model)
    (model_folder / "m.onnx").unlink()
    with pytest.raises(ValueError, match="not ready: .*missing"):
        score_paragraphs(rows, model)


def test_the_model_runs_once_after_pushed_filters(spark, sf):
    plan = score_paragraphs(analyzable(page_paragraphs(table(spark, sf, "pages"))), Batched())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    from proseledger.operators.segment import document_paragraphs

    plan = analyzable(document_paragraphs(rows))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "n_chars" not in plan


def test_manifest(tmp_path):
    (tmp_path / "m.onnx").write_bytes(b"weights")
    good = {"model_id": "m", "model": "m.onnx", "tokenizer": "t", "files": [{"path": "m.onnx", "bytes": 7, "sha256": hashlib.sha256(b"weights").hexdigest()}]}
    (tmp_path / "manifest.json").write_text(json.dumps(good))
    assert verified_manifest(str(tmp_path / "manifest.json"))["model_id"] == "m"
    assert OnnxScorer(str(tmp_path / "manifest.json")).model_id == "m"
    (tmp_path / "m.onnx").write_bytes(b"changed")
    with pytest.raises(ValueError, match="pins"):
        verified_manifest(str(tmp_path / "manifest.json"))
    (tmp_path / "m.onnx").unlink()
    with pytest.raises(FileNotFoundError):
        OnnxScorer(str(tmp_path / "manifest.json"))
    with pytest.raises(ValueError, match="unknown backend"):
        scorer("other")


def test_exported_documents_and_pdf_files(spark, tmp_path):
    from proseledger.sources.tables import exported_documents, pdf_pages

    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    docs = exported_documents(spark, str(tmp_path / "a.txt")).collect()
    assert [(d.text, d.n_chars) for d in docs] == [("one\ntwo", 7)]
    assert [r.length for r in pdf_pages(spark, str(tmp_path)).collect()] == [4]
