"""The queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import shared_path
from ..functions.marks import class_name
from ..functions.text import host
from ..operators import cache as score_cache
from ..operators import report
from ..operators.filters import admitted, analyzable, granted
from ..operators.language import Profiles, detect, learn_profiles, with_language
from ..operators.scoring import HashStubScorer, score_paragraphs, scorer
from ..operators.places import marked_places
from ..operators.runs import runs, smoothed
from ..operators.segment import document_paragraphs, page_paragraphs
from ..operators.sites import score_quantiles, text_overlap
from ..operators.windows import score_long
from ..sources.pdf import StubPdfParser, parsed_pdfs, stub_pdf
from ..sources.tables import as_documents, table
from ..streaming.live_cache import live_scores
from ..streaming.pages import newest_summaries, page_summaries

#: The single page that is analyzed without a grant.
SINGLE_PAGE = 7


def _grants(pages: DataFrame) -> DataFrame:
    """For the tables at hand, sites whose name starts with a to m are granted."""
    return pages.select(host(F.col("url")).alias("host")).where(F.col("host") < "n").distinct()


def _english_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzable(page_paragraphs(table(spark, sf_dir, "pages")))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_paragraphs(_english_pages(spark, sf_dir), scorer("stub"))


def _scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_paragraphs(analyzable(document_paragraphs(table(spark, sf_dir, "documents"))), scorer("stub"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", host(F.col("url")).alias("host"), F.length("html").cast("long").alias("n_chars"))


def granted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return granted(pages, _grants(pages)).select("page_id", "url")


def single_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paragraphs(table(spark, sf_dir, "pages").where(F.col("page_id") == SINGLE_PAGE))


def admitted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return admitted(pages, _grants(pages), [SINGLE_PAGE]).select("page_id", "url")


def page_paragraphs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paragraphs(table(spark, sf_dir, "pages"))


def page_paragraphs_with_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paragraphs(table(spark, sf_dir, "pages"), headings=True)


def document_paragraphs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_paragraphs(table(spark, sf_dir, "documents"))


def english_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _english_pages(spark, sf_dir)


def long_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzable(page_paragraphs(table(spark, sf_dir, "pages")), min_chars=50)


def _rounded(scored: DataFrame) -> DataFrame:
    parts = [F.round(F.col("breakdown")[k], 9).alias(k) for k in ("human", "light", "heavy", "ai")]
    return scored.select("source_kind", "source_id", "seq", "text_sha256", "model_id", F.round("score", 9).alias("score"), *parts, F.col("klass").cast("int").alias("klass"), "chip")


def scored_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored_documents(spark, sf_dir))


class _BatchedStub(HashStubScorer):
    """The stub as a model is run: in batches, in Python."""

    def columns(self, text: object) -> None:
        return None


def model_scored_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path that a model takes: each distinct text once, in Arrow batches, joined back."""
    return _rounded(score_paragraphs(_english_pages(spark, sf_dir), _BatchedStub()))


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy(F.col("klass").cast("int").alias("klass")).agg(F.count("*").alias("n")).withColumn("name", class_name(F.col("klass")))


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("chip").agg(F.count("*").alias("n"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the two upper classes, without the four parts."""
    return report.marks(_scored(spark, sf_dir), show=(2, 3), breakdown=False).drop("source_kind").withColumn("klass", F.col("klass").cast("int"))


def page_ai_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_summary(_scored(spark, sf_dir)).select("source_id", "n_analyzed", "n_ai", F.round("ai_share", 9).alias("ai_share"))


def page_ai_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform("ai_paragraphs", lambda p: F.concat(p["seq"].cast("string"), F.lit(" "), p["text"]))
    return report.page_summary(_scored(spark, sf_dir)).select("source_id", F.array_join(listed, "\n").alias("ai_paragraphs"))


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_report(_scored(spark, sf_dir)).drop("source_kind")


def document_ai_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_summary(_scored_documents(spark, sf_dir)).select("source_id", "n_analyzed", "n_ai", F.round("ai_share", 9).alias("ai_share"))


def _counts(scored: DataFrame, *names: str) -> DataFrame:
    return report.page_summary(scored).select(*names, "n_analyzed", "n_ai", F.round("ai_share", 9).alias("ai_share"))


def mixed_ai_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents in one table: a page and a document of the same number are two."""
    return _counts(_scored(spark, sf_dir).unionByName(_scored_documents(spark, sf_dir)), "source_kind", "source_id")


def pdf_ai_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PDF file that the stub parser reads."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), stub_pdf(F.col("text")).alias("content"))
    paragraphs = document_paragraphs(parsed_pdfs(files, StubPdfParser()).withColumnRenamed("path", "doc_id"), "pdf")
    return _counts(score_paragraphs(analyzable(paragraphs), scorer("stub")), "source_id")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as the files that they would be exported to."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("value"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("value"))
    return document_paragraphs(as_documents(docs.unionByName(pages)), "export")


def exported_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir).select(F.col("source_id").alias("source"), "seq", "lang", "text")


def exported_ai_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(score_paragraphs(analyzable(_exported(spark, sf_dir)), scorer("stub")), "source_id").withColumnRenamed("source_id", "source")


def top_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three highest scores of each page."""
    best = Window.partitionBy("source_kind", "source_id").orderBy(F.desc("score"), "seq")
    return _scored(spark, sf_dir).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 3).select("source_id", "seq", "rank", "chip")


def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by site; pages are summed up before they are joined with their sites."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), host(F.col("url")).alias("host"))
    counts = _scored(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("klass") == report.AI).alias("n_ai"))
    return counts.join(pages, "source_id").groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_analyzed"), F.sum("n_ai").alias("n_ai"))


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of pages and documents together, by kind and class, with totals."""
    both = _scored(spark, sf_dir).select("source_kind", "klass", "score").unionByName(_scored_documents(spark, sf_dir).select("source_kind", "klass", "score"))
    out = both.rollup("source_kind", F.col("klass").cast("int").alias("klass")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
    return out.select("source_kind", "klass", "n", "mean_score")


def class_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each class."""
    return _scored(spark, sf_dir).groupBy("source_id").agg(*(F.count_if(F.col("klass") == k).alias(name) for k, name in enumerate(("n_human", "n_light", "n_heavy", "n_ai"))))


def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _english_pages(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct(F.sha2("text", 256)).alias("n_distinct"))


def _warm_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that was filled by an earlier run: here, of the pages with even numbers."""
    path = shared_path(spark, "score-cache")
    even = table(spark, sf_dir, "pages").where(F.col("page_id") % 2 == 0)
    score_cache.append_cache(score_paragraphs(analyzable(page_paragraphs(even)), scorer("stub")), path)
    return score_cache.read_cache(spark, path)


def _warm_table(spark: SparkSession, sf_dir: str) -> score_cache.CacheTable:
    """The same as a bucketed table: of the pages with even numbers, then of those divisible by four again, made one."""
    held = score_cache.CacheTable(spark, shared_path(spark, "score-table"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages = table(spark, sf_dir, "pages")
    for k in (2, 4):
        held.append(score_paragraphs(analyzable(page_paragraphs(pages.where(F.col("page_id") % k == 0))), scorer("stub")))
    held.compact()
    return held


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _english_pages(spark, sf_dir).withColumn("text_sha256", F.sha2("text", 256))
    hits, _ = score_cache.lookup(rows, _warm_cache(spark, sf_dir), "stub-md5")
    return hits.select("model_id", "text_sha256", F.round("score", 9).alias("score"))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _english_pages(spark, sf_dir).withColumn("text_sha256", F.sha2("text", 256))
    return score_cache.lookup(rows, _warm_cache(spark, sf_dir), "stub-md5")[1].select("text_sha256", "text")


def cached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs with a warm cache: the same as without one."""
    return _rounded(score_paragraphs(_english_pages(spark, sf_dir), _BatchedStub(), _warm_cache(spark, sf_dir)))


def table_cached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs with a warm, bucketed cache: the same as without one."""
    return _rounded(score_paragraphs(_english_pages(spark, sf_dir), _BatchedStub(), _warm_table(spark, sf_dir)))


def live_cached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs scored as they arrive, each distinct text once."""
    out = live_scores(spark, f"{sf_dir}/pages.parquet*", scorer("stub"), ttl_ms=24 * 3600 * 1000)
    parts = [F.round(k, 9).alias(k) for k in ("human", "light", "heavy", "ai")]
    return out.select("source_kind", "source_id", "seq", "text_sha256", "model_id", F.round("score", 9).alias("score"), *parts, F.col("klass").cast("int").alias("klass"), "chip")


def _profiles(spark: SparkSession, sf_dir: str) -> Profiles:
    return learn_profiles(table(spark, sf_dir, "documents"))


def detected_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every turn of every conversation, which declare none; learned from the documents."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return detect(turns, _profiles(spark, sf_dir), ["conv_id", "turn"])


def detected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every benchmark item."""
    return detect(table(spark, sf_dir, "benchmark"), _profiles(spark, sf_dir), ["item_id"])


def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against detected languages of the documents whose checksum is divisible by five, learned from all others."""
    docs = table(spark, sf_dir, "documents").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    found = detect(docs.where(F.col("held")), learn_profiles(docs.where(~F.col("held"))), ["doc_id", "lang"])
    return found.groupBy("lang", "detected").agg(F.count("*").alias("n"))


def english_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as paragraphs, scored where they are detected as English."""
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("source_kind"), F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("seq"), F.lit("").alias("lang"), "text")
    told = with_language(turns, _profiles(spark, sf_dir), ["source_id", "seq"])
    return _rounded(score_paragraphs(analyzable(told), scorer("stub")))


#: Windows of the query below: so many words, of which so many are the window before's too.
WINDOW, OVERLAP = 40, 10


def windowed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English paragraphs in windows of 40 words, the path that a model takes; scores merged by length."""
    out = score_long(_english_pages(spark, sf_dir), _BatchedStub(), WINDOW, OVERLAP)
    return out.select("source_id", "seq", F.round("score", 9).alias("score"), F.round("breakdown.ai", 9).alias("ai"), F.col("klass").cast("int").alias("klass"), "n_windows")


def smoothed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of English paragraphs with the means over their neighbours."""
    out = smoothed(_scored(spark, sf_dir), reach=2)
    return out.select("source_id", "seq", *(F.round(c, 9).alias(c) for c in ("score", "smoothed", "change")))


def ai_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of paragraphs that read as heavily edited or AI-generated, of pages and documents."""
    out = runs(_scored(spark, sf_dir).unionByName(_scored_documents(spark, sf_dir)), least_class=2)
    return out.select("source_kind", "source_id", "first", "last", "n", F.round("mean_score", 9).alias("mean_score"))


def _site_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored paragraphs with their sites."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), host(F.col("url")).alias("host"))
    return _scored(spark, sf_dir).select("source_id", "score", "text_sha256").join(pages, "source_id")


def site_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each site the scores that a tenth, half and nine tenths of its paragraphs don't exceed."""
    found = score_quantiles(_site_paragraphs(spark, sf_dir), "host", {"low": "0.1", "middle": "0.5", "high": "0.9"})
    return found.select("host", "n", *(F.round(name, 9).alias(name) for name in ("low", "middle", "high")))


def site_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each site its distinct paragraphs, and how many of them stand in documents too."""
    return text_overlap(_site_paragraphs(spark, sf_dir), _scored_documents(spark, sf_dir), "host")


def mark_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each mark stands in its page's HTML, and the innermost element that holds it."""
    out = marked_places(table(spark, sf_dir, "pages"), _scored(spark, sf_dir))
    return out.withColumn("klass", F.col("klass").cast("int"))


def stream_page_ai_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_summaries(spark, f"{sf_dir}/pages.parquet*", scorer("stub"))
    return out.select("source_id", "n_analyzed", "n_ai", F.round("ai_share", 9).alias("ai_share"))


def stream_newest_ai_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where pages may arrive again; pages without English paragraphs have counts of none."""
    out = newest_summaries(spark, f"{sf_dir}/pages.parquet*", scorer("stub"), buckets=8)
    return out.select("source_id", "n_analyzed", "n_ai", F.round("ai_share", 9).alias("ai_share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "web_pages": web_pages,
    "granted_pages": granted_pages,
    "single_page": single_page,
    "admitted_pages": admitted_pages,
    "page_paragraphs": page_paragraphs_query,
    "page_paragraphs_with_headings": page_paragraphs_with_headings,
    "document_paragraphs": document_paragraphs_query,
    "english_paragraphs": english_paragraphs,
    "long_paragraphs": long_paragraphs,
    "scored_paragraphs": scored_paragraphs,
    "scored_documents": scored_documents,
    "model_scored_paragraphs": model_scored_paragraphs,
    "class_counts": class_counts,
    "chips": chips,
    "marks": marks,
    "page_ai_count": page_ai_count,
    "page_ai_list": page_ai_list,
    "page_report": page_report,
    "document_ai_count": document_ai_count,
    "mixed_ai_count": mixed_ai_count,
    "pdf_ai_count": pdf_ai_count,
    "exported_paragraphs": exported_paragraphs,
    "exported_ai_count": exported_ai_count,
    "top_paragraphs": top_paragraphs,
    "site_summary": site_summary,
    "corpus_report": corpus_report,
    "class_columns": class_columns,
    "dedup_ratio": dedup_ratio,
    "cache_hits": cache_hits,
    "cache_misses": cache_misses,
    "cached_scores": cached_scores,
    "table_cached_scores": table_cached_scores,
    "live_cached_scores": live_cached_scores,
    "windowed_scores": windowed_scores,
    "smoothed_scores": smoothed_scores,
    "ai_runs": ai_runs,
    "site_quantiles": site_quantiles,
    "site_overlap": site_overlap,
    "mark_places": mark_places,
    "detected_turns": detected_turns,
    "detected_items": detected_items,
    "language_confusion": language_confusion,
    "english_turns": english_turns,
    "stream_page_ai_count": stream_page_ai_count,
    "stream_newest_ai_count": stream_newest_ai_count,
}
