"""Shared-folder tables, size checks and the few session look-ups that operators need.

Intermediate results that must survive the loss of an executor are written as Parquet below the folder named by
``spark.checkpoint.dir``.  Only when that setting is absent (tests, a laptop) is a private folder made.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Data measured to be below this many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; set only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tripleloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; it is removed when the JVM ends."""
    path = f"{shared_dir(spark)}/tripleloom/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, at Parquet's compressed size."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """A driver-made table (a few values per partition or rule), sent through Arrow."""
    return spark.createDataFrame(pa.table({k: pa.array(v, types[k]) for k, v in columns.items()}))


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's upper estimate of the size of ``df`` in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimiser's size estimate is within ``limit``; else as it is.

    Without the hint the join is a shuffle join whose skewed partitions AQE splits.
    """
    return F.broadcast(df) if planned_bytes(df) <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A scan whose files give fewer partitions than there are cores, shuffled once to that many; others as they are.

    For costly work by row.  Files of one row group cannot be split, however many cores wait.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once; needed where it is not installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tripleloom-")) / "tripleloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path("tripleloom") / f.relative_to(package))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
