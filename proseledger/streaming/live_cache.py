"""The score cache as live state: paragraphs are scored as they arrive, each text once until its entry expires.

The state is kept by buckets of text hashes in a state store that survives restarts from the checkpoint. An entry lives for a set time after
it was scored; a text that comes again later is scored again. Python and the store are called once for each bucket that a batch touches, not for
each text, which took about 2 ms; so a batch reads the live entries of its buckets, and of all of them if it has many more texts than there are
buckets. A task holds the entries of one bucket at a time. All paragraphs of one text go to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..folders import shared_path
from ..functions.marks import chip, class_by_breakdown, class_by_score
from ..operators.filters import analyzable
from ..operators.scoring import PARTS, Scorer
from ..operators.segment import page_paragraphs
from ..schemas import PAGES

ROWS = "source_kind string, source_id long, seq int, text_sha256 string, model_id string, score double, human double, light double, heavy double, ai double, fresh boolean"
#: Scores of texts that were scored together: arrays of equal length.
ENTRIES = "model_id string, hashes array<string>, score array<double>, human array<double>, light array<double>, heavy array<double>, ai array<double>"
#: What the state store needs for entries with a time to live.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Streams started within run with these; without batches without data, since state that may expire asks for them without end."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ScoreState(StatefulProcessor):
    """Keeps the scores of a bucket of texts by one model. Texts that are scored together are one element of the state, with one expiry."""

    def __init__(self, scorer: Scorer, ttl_ms: int) -> None:
        self._scorer, self._ttl = scorer, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._entries = handle.getListState("entries", ENTRIES, self._ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known: dict[str, tuple[float, ...]] = {}
        for model_id, hashes, *values in self._entries.get():
            if model_id == self._scorer.model_id:  # else another model's
                known.update(zip(hashes, zip(*values, strict=True), strict=True))
        scored: dict[str, tuple[float, ...]] = {}
        for batch in rows:
            texts = batch.drop_duplicates("text_sha256")
            texts = texts[[h not in known and h not in scored for h in texts["text_sha256"]]]
            new: dict[str, tuple[float, ...]] = {}
            for at in range(0, len(texts), 64):
                part = texts.iloc[at : at + 64]
                score, parts = self._scorer.batch(part["text"].tolist())
                new.update(zip(part["text_sha256"], zip(map(float, score), *(map(float, parts[:, k]) for k in range(len(PARTS))), strict=True), strict=True))
            if new:
                self._entries.appendValue((self._scorer.model_id, [*new], *map(list, zip(*new.values(), strict=True))))
                scored |= new
            hashes = batch["text_sha256"].tolist()
            own = pd.DataFrame([scored[h] if h in scored else known[h] for h in hashes], batch.index, ["score", *PARTS], dtype=float)
            keys = batch[["source_kind", "source_id", "seq", "text_sha256"]]
            yield pd.concat([keys, own], axis=1).assign(model_id=self._scorer.model_id, fresh=[h in scored for h in hashes])[[c.split()[0] for c in ROWS.split(", ")]]

    def close(self) -> None:
        pass


def live_scores(spark: SparkSession, source: str, scorer: Scorer, ttl_ms: int, sink: str | None = None, checkpoint: str | None = None, files_per_batch: int = 1000, buckets: int = 4096) -> DataFrame:
    """Scores of the paragraphs of all pages in new files under ``source``, appended to ``sink``; ends when no file is left.

    The columns of ``ROWS``, with klass and chip; fresh tells whether the text was scored in that batch or its live entry was taken. A batch that is run again after a
    failure reads the state as it was before, and overwrites its own folder. A checkpoint is always opened with the same number of ``buckets``.
    """
    sink, checkpoint = sink or shared_path(spark, "live-sink"), checkpoint or shared_path(spark, "live-state")
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = analyzable(page_paragraphs(pages)).withColumn("text_sha256", F.sha2("text", 256)).select("source_kind", "source_id", "seq", "text_sha256", "text")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("text_sha256"), F.lit(buckets)).cast("int"))
    scored = rows.groupBy("bucket").transformWithStateInPandas(ScoreState(scorer, ttl_ms), ROWS, "Append", "ProcessingTime")
    klass = class_by_score(F.col("score")) if scorer.rule == "score" else class_by_breakdown(F.struct(*PARTS))
    out = scored.withColumns({"klass": klass, "chip": chip(F.col("score"))})

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(f"{sink}/batch=-1")
    with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*out.schema.fields, StructField("batch", IntegerType())])).parquet(sink)
