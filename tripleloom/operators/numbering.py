"""Exact global row numbers without a single-task window.

Rows are range-partitioned and sorted, written to the shared folder, counted per written file, and the counts are
prefix-summed.  A row's number is its file's offset plus its index in the file, so any number of rows of one key is
numbered by as many tasks as its size needs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import new_path, partitions, small_table


@dataclass(frozen=True)
class Numbered:
    """``df`` has the input's columns, ``pos`` (0-based number) and ``chunk_file`` (number of the file).

    ``starts`` has the first position of every file, in order; the list is as long as the number of partitions.
    """

    df: DataFrame
    starts: list[int]
    rows: int


def number_rows(df: DataFrame, *order: str | Column, parts: int | None = None) -> Numbered:
    """Number the rows of ``df`` in the given order; ties are numbered in an arbitrary but fixed order.

    Nulls come first.  An empty table gives an empty result.  The columns ``pos`` and ``chunk_file`` replace columns
    of those names.
    """
    spark = df.sparkSession
    path = new_path(spark, "numbered")
    columns = [c for c in df.columns if c.lower() not in ("pos", "chunk_file")]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(parts or partitions(spark), *order).sortWithinPartitions(*order)
    ranged.select(*[f"`{c}`" for c in columns]).write.parquet(path)
    back = spark.read.schema(ranged.select(*[f"`{c}`" for c in columns]).schema).parquet(path)
    back = back.select(*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("index_"))
    counts = {r["file_"]: r["count"] for r in back.groupBy("file_").count().collect()}  # one row a partition
    names = sorted(counts, key=lambda n: int(re.match(r"part-(\d+)", n)[1]))
    starts, total = [], 0
    for n in names:
        starts.append(total)
        total += counts[n]
    offsets = small_table(spark, {"file_": names, "start_": starts, "chunk_file": list(range(len(names)))}, {"file_": pa.string(), "start_": pa.int64(), "chunk_file": pa.int32()})
    out = back.join(F.broadcast(offsets), "file_").select(*[F.col(f"`{c}`") for c in columns], (F.col("start_") + F.col("index_")).alias("pos"), "chunk_file")
    return Numbered(out, starts, total)
