"""Versioned triples from a log of insertions and deletions: intervals by gaps and islands.

A period begins with an insertion when none is open; further insertions change nothing.  A deletion ends the last
period at the deletion's version, later deletions move that end.  A deletion without any insertion before it leaves a
tombstone: NULL to its version.  NULL terms, versions or operations do not count; of one version deletions come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["s", "p", "o"]


def intervals(log: DataFrame) -> DataFrame:
    """(s, p, o, valid_from, valid_to) of a log (s, p, o, version, deleted)."""
    clean = log.select(*KEY, F.col("version").cast("bigint").alias("version"), "deleted").dropna().distinct()
    order = Window.partitionBy(*KEY).orderBy("version", F.desc("deleted"))
    before = F.lag("deleted").over(order)
    begins = clean.withColumn("begins", (~F.col("deleted") & F.coalesce(before, F.lit(True))).cast("int"))
    island = begins.withColumn("island", F.sum("begins").over(order))
    return island.groupBy(*KEY, "island").agg(F.min(F.when(~F.col("deleted"), F.col("version"))).alias("valid_from"), F.max(F.when(F.col("deleted"), F.col("version"))).alias("valid_to")).drop("island")


def current(periods: DataFrame) -> DataFrame:
    """The triples whose last period is open."""
    return periods.where("valid_to IS NULL").select(*KEY)


def as_of(periods: DataFrame, version: int) -> DataFrame:
    return periods.where((F.col("valid_from") <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") > version))).select(*KEY)


def tombstones(periods: DataFrame) -> DataFrame:
    return periods.where("valid_from IS NULL")
