"""Relational tables as triples: one subject a row, one predicate a column.

Nothing is materialised: the triples of a table are a union of one narrow projection a column, so a pattern with a
constant predicate is one pruned scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE

# The names that rows, columns and tables get.
ROW, COLUMN, TABLE = "urn:t/", "urn:p/", "urn:t/"


@dataclass(frozen=True)
class Mapping:
    """How a table becomes triples: its key columns, plain columns, and foreign keys {column: table}."""

    table: str
    key: tuple[str, ...]
    columns: tuple[str, ...] = ()
    links: dict[str, str] = field(default_factory=dict)


def subject(table: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<{ROW}{table}/"), F.concat_ws("/", *[p.cast("string") for p in parts]), F.lit(">"))


def literal(column: str, kind: str) -> Column:
    """Key of a value: whole numbers as they are, dates and booleans typed, everything else as a string."""
    text = F.col(column).cast("string")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return text
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def triples(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Triples of a table; NULL values have none."""
    kinds = dict(df.dtypes)
    me = subject(mapping.table, *[F.col(k) for k in mapping.key])
    parts = [df.select(me.alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(f"<{TABLE}{mapping.table}>").alias("o"))]
    for c in mapping.columns:
        parts.append(df.where(F.col(c).isNotNull()).select(me.alias("s"), F.lit(f"<{COLUMN}{c}>").alias("p"), literal(c, kinds[c]).alias("o")))
    for c, other in mapping.links.items():
        parts.append(df.where(F.col(c).isNotNull()).select(me.alias("s"), F.lit(f"<{COLUMN}{c}>").alias("p"), subject(other, F.col(c)).alias("o")))
    return reduce(DataFrame.unionByName, parts)


def graph(tables: Sequence[tuple[DataFrame, Mapping]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [triples(df, m) for df, m in tables])
