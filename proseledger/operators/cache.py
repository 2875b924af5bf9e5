"""A table of scores by model and text hash. Entries don't expire (see ``streaming.live_cache`` for those that do); a new model has a new id."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCORE_CACHE

_COLUMNS = ["model_id", "text_sha256", "score", "breakdown"]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_CACHE).parquet(path)


def append_cache(scored: DataFrame, path: str) -> None:
    """Add scores, one for each text. Pass what :func:`lookup` found missing, so that nothing is stored twice."""
    scored.select(*_COLUMNS).dropDuplicates(["model_id", "text_sha256"]).write.mode("append").parquet(path)


def lookup(rows: DataFrame, cache: DataFrame | None, model_id: str) -> tuple[DataFrame, DataFrame]:
    """Of rows with text and text_sha256: the cache's entries for them, and the distinct texts that it doesn't hold."""
    texts = rows.groupBy("text_sha256").agg(F.first("text").alias("text"))
    if cache is None:
        return rows.sparkSession.createDataFrame([], SCORE_CACHE), texts
    known = cache.where(F.col("model_id") == model_id).dropDuplicates(["text_sha256"]).select(*_COLUMNS)
    return known.join(texts.select("text_sha256"), "text_sha256", "left_semi").select(*_COLUMNS), texts.join(known.select("text_sha256"), "text_sha256", "left_anti")


class CacheTable:
    """The cache as a bucketed table: a text's entry lies in the bucket of its hash, sorted, so that lookups never shuffle the cache.

    The table is a folder that any session can open. New entries come as further files of their buckets; :meth:`compact` makes
    them one sorted file for each bucket and model again, with one entry for each text, beside the old files, and then switches over. A lost
    executor repeats its own buckets. One writer at a time; readers may go on while a compaction runs and then open the table anew.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self._spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._open()

    def _versions(self) -> list[int]:
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [f.getPath().getName() for f in system.listStatus(folder) if system.exists(self._spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))

    def _open(self) -> None:
        found = self._versions()
        self.version = found[-1] if found else 0
        self._name = self._table(self.version)
        if not found:
            self._write(self._spark.createDataFrame([], SCORE_CACHE), self._name, 0)

    def _table(self, version: int) -> str:
        """The catalog's table over a version's folder; catalogs that forget tables get it again."""
        name = f"score_cache_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{version}"
        columns = SCORE_CACHE.replace(":", " : ")
        self._spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (path '{self.path}/version-{version}') "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS"
        )
        return name

    def _write(self, entries: DataFrame, name: str, version: int) -> None:
        dealt = entries.select(*_COLUMNS).repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256")
        # an empty table gets its mark of success too
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").option("path", f"{self.path}/version-{version}").saveAsTable(name)

    def read(self) -> DataFrame:
        return self._spark.table(self._name)

    def append(self, scored: DataFrame) -> None:
        """Add scores of texts that :meth:`lookup` found missing, one for each."""
        self._write(scored.select(*_COLUMNS).dropDuplicates(["model_id", "text_sha256"]), self._name, self.version)
        self._spark.catalog.refreshTable(self._name)

    def compact(self) -> None:
        """One sorted file for each bucket, and one entry for each model and text: of several, that with the highest score."""
        once = self.read().groupBy("text_sha256", "model_id").agg(F.max(F.struct("score", "breakdown")).alias("x")).select("model_id", "text_sha256", "x.score", "x.breakdown")
        version = self.version + 1
        name = self._table(version)
        self._write(once, name, version)
        self.version, self._name = version, name

    def drop_old(self) -> None:
        """Delete all versions but the newest two; readers may still be at the one before."""
        for version in self._versions()[:-2]:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._table(version)}")
            folder = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version-{version}")
            folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(folder, True)

    def entries(self, model_id: str) -> DataFrame:
        """One entry for each text of a model. Equal hashes lie in one bucket, so this shuffles nothing."""
        once = self.read().where(F.col("model_id") == model_id).groupBy("text_sha256").agg(F.max(F.struct("score", "breakdown")).alias("x"))
        return once.select(F.lit(model_id).alias("model_id"), "text_sha256", "x.score", "x.breakdown")

    def lookup(self, rows: DataFrame, model_id: str) -> tuple[DataFrame, DataFrame]:
        """As :func:`lookup`: the distinct texts are dealt out as the buckets are, and the cache stays where it lies.

        One outer join tells both; a semi or anti join would be moved before the dealing out, and the cache then shuffled where there are fewer buckets than partitions.
        """
        texts = rows.groupBy("text_sha256").agg(F.first("text").alias("text")).repartition(self.buckets, "text_sha256")
        told = texts.join(self.entries(model_id), "text_sha256", "left")
        held = F.col("model_id").isNotNull()
        return told.where(held).select(*_COLUMNS), told.where(~held).select("text_sha256", "text")
