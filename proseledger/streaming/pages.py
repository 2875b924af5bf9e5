"""Pages as they arrive: the batch plan, applied to each micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import shared_path, staged
from ..operators.filters import analyzable
from ..operators.report import page_summary
from ..operators.scoring import Scorer, score_paragraphs
from ..operators.segment import page_paragraphs
from ..operators.upsert import read_upserted, upsert
from ..schemas import PAGES, SUMMARY


def page_summaries(spark: SparkSession, source: str, scorer: Scorer, sink: str | None = None, checkpoint: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Summaries of all pages in new files under ``source``, appended to ``sink``; ends when no file is left.

    A page comes in one file, so its summary is complete in one batch and no state is kept. A batch that is run again
    overwrites its own folder, so that each page is there once.
    """
    sink, checkpoint = sink or shared_path(spark, "stream-sink"), checkpoint or shared_path(spark, "stream-state")

    def write(pages: DataFrame, batch: int) -> None:
        scored = score_paragraphs(analyzable(page_paragraphs(pages)), scorer)
        page_summary(scored).drop("source_kind", "ai_paragraphs").write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    # so that there is something to read if no page ever arrives
    spark.createDataFrame([], SUMMARY).write.mode("overwrite").parquet(f"{sink}/batch=-1")
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{SUMMARY}, batch int").parquet(sink).select("source_id", "n_analyzed", "n_ai", F.col("ai_share"))


def newest_summaries(spark: SparkSession, source: str, scorer: Scorer, delay: str = "1 hour", sink: str | None = None, checkpoint: str | None = None, files_per_batch: int = 1000, buckets: int = 64) -> DataFrame:
    """Summaries of all pages in new files under ``source``, of each page that of its newest file; ends when no file is left.

    A page counts as of its file's modification time. The same page with the same content within ``delay`` is one arrival, however
    often it is delivered; a page that changed replaces its summary; a version that comes after a newer one doesn't. What is
    later than ``delay`` behind the newest file is left out. State is the pages' hashes within the delay.
    """
    sink, checkpoint = sink or shared_path(spark, "newest-sink"), checkpoint or shared_path(spark, "newest-state")

    def write(pages: DataFrame, batch: int) -> None:
        last = pages.groupBy("page_id").agg(F.max_by(F.struct("url", "html"), F.struct("arrived", "version")).alias("x"), F.max("arrived").alias("arrived"))
        last = staged(last.select("page_id", "x.url", "x.html", "arrived"), "arrivals")
        counts = page_summary(score_paragraphs(analyzable(page_paragraphs(last)), scorer)).drop("source_kind", "ai_paragraphs")
        # a page that has lost all its paragraphs has a summary of none
        arrived = last.select(F.col("page_id").alias("source_id"), "arrived")
        zero = {"n_analyzed": 0, "n_ai": 0}
        upsert(arrived.join(counts, "source_id", "left").fillna(zero).select(*columns), sink, "source_id", "arrived", buckets)

    empty = spark.createDataFrame([], f"{SUMMARY}, arrived timestamp")
    columns = empty.columns
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    pages = pages.select("page_id", "url", "html", F.col("_metadata.file_modification_time").alias("arrived"), F.sha2("html", 256).alias("version"))
    pages = pages.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["page_id", "version"])
    pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    try:
        return read_upserted(empty, sink)
    except AnalysisException:  # no page ever arrived
        return empty
