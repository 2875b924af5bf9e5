"""A table of which a run replaces only what it brings: partitions of key hashes, written over where they are touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..folders import staged


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(rows: DataFrame, path: str, key: str, newest: str, buckets: int = 64) -> None:
    """Of each key the row that is largest in ``newest``, of those in the table and the new ones; of equal ones a new one.

    The touched partitions are read, merged with the new rows in one shuffle, written to the shared folder and then over
    themselves. A run that is lost on the way can be repeated: its rows replace themselves. One writer at a time.
    """
    spark = rows.sparkSession
    new = staged(rows.withColumn("_bucket", _bucket(key, buckets)).withColumn("_new", F.lit(1)), "upsert")
    touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # at most one for each partition
    if not touched:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        old = spark.read.schema(new.drop("_new").schema).parquet(path).where(F.col("_bucket").isin(touched)).withColumn("_new", F.lit(0))
        new = new.unionByName(old)
    names = rows.columns
    merged = new.groupBy("_bucket", key).agg(F.max_by(F.struct(*names), F.struct(newest, "_new")).alias("x")).select("x.*", "_bucket")
    # dealt out by partition, so that each is a few files
    merged = staged(merged, "upsert-merged").repartition("_bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4)))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def read_upserted(rows: DataFrame, path: str) -> DataFrame:
    """The table, with the columns of ``rows``."""
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)
