"""Queries of the text problems over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixture, tokenise, truncation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode(table(spark, d, "documents"), ["doc_id"])


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids."""
    return tokenise.decode(p7_ids(spark, d), ["doc_id"])


P7_ROUND_TRIP_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.select(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_round_trip, p8_mix, p8_shares, p9_found, p9_rates)}
SQL = {"p7_round_trip": P7_ROUND_TRIP_SQL}
