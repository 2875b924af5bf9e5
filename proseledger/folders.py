"""Tables and folders in the place that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session a new folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`sweep` deletes."""
    path = f"{shared_root(spark).rstrip('/')}/proseledger/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and lost executors cost no rerun of it.

    Of ``large_rows`` the sizes of pages and row groups are looked at after every row, since a hundred of them may be too many already.
    """
    path = shared_path(df.sparkSession, name)
    # small row groups: each open file holds one in the heap
    writer = df.write.option("parquet.block.size", (8 if large_rows else 32) << 20)
    if large_rows:
        writer = writer.option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep() -> int:
    """Delete every staged table of this driver; call it once the results that came from them are written."""
    n = 0
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
        except Exception as why:  # the session may have ended already; the files are then the cluster's to clear
            print(f"not deleted: {path} ({type(why).__name__})")
            break
    return n


@atexit.register
def _at_exit() -> None:
    if _written and _written[-1][0].sparkContext._jsc is not None:
        sweep()
