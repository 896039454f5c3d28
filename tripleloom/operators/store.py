"""A set of triples as a DataFrame: scans, look-ups, counts, views, and changes that give new sets.

The layout replaces indices: written with ``write``, a store is partitioned by predicate and sorted by subject and
object, so constants prune files and row groups.  NULL terms are not triples and are dropped on insertion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import sort_key_udf
from .numbering import number_rows

SCHEMA = "s string, p string, o string"
PLACES = ["s", "p", "o"]
INDICES = ("spo", "pos", "osp", "sop", "ops", "pso")


def as_triples(df: DataFrame) -> DataFrame:
    return df.select(*PLACES).dropna()


class TripleStore:
    def __init__(self, triples: DataFrame, distinct: bool = False):
        self.df = triples.select(*PLACES) if distinct else as_triples(triples).distinct()

    @staticmethod
    def empty(spark: SparkSession) -> TripleStore:
        return TripleStore(spark.createDataFrame([], SCHEMA), True)

    @staticmethod
    def of(spark: SparkSession, rows: Iterable[Sequence[str]]) -> TripleStore:
        return TripleStore(spark.createDataFrame([tuple(r) for r in rows], SCHEMA))

    # -- changes

    def insert(self, triples: DataFrame) -> TripleStore:
        """With ``triples`` added; what is there already is not added again."""
        fresh = as_triples(triples).distinct().join(self.df, PLACES, "left_anti")
        return TripleStore(self.df.unionByName(fresh), True)

    def new_triples(self, triples: DataFrame) -> DataFrame:
        """Those of ``triples`` that ``insert`` would add."""
        return as_triples(triples).distinct().join(self.df, PLACES, "left_anti")

    def delete(self, triples: DataFrame) -> TripleStore:
        """Without ``triples``; a triple that is not there is no error."""
        return TripleStore(self.df.join(as_triples(triples), PLACES, "left_anti"), True)

    def overlay(self) -> Overlay:
        return Overlay(self)

    def map_terms(self, f: Callable[[Column], Column]) -> TripleStore:
        """With ``f`` applied to each term of each triple."""
        return TripleStore(self.df.select(*[f(F.col(c)).alias(c) for c in PLACES]))

    # -- look-ups

    def where(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Triples with the given terms; any of the eight shapes."""
        found = self.df
        for place, term in zip(PLACES, (s, p, o)):
            if term is not None:
                found = found.where(F.col(place) == F.lit(term))
        return found

    def contains(self, s: str, p: str, o: str) -> bool:
        return not self.where(s, p, o).limit(1).isEmpty()

    def members(self, triples: DataFrame) -> DataFrame:
        """Those of ``triples`` that are in the store."""
        return as_triples(triples).join(self.df, PLACES, "left_semi")

    def lookup(self, place: str, keys: DataFrame) -> DataFrame:
        """Triples whose term at ``place`` is among ``keys`` (one column): many look-ups as one semi-join."""
        return self.df.join(keys.toDF(place), place, "left_semi")

    def count(self) -> int:
        return self.df.count()

    def lead_counts(self, place: str) -> DataFrame:
        return self.df.groupBy(place).agg(F.count("*").alias("n"))

    # -- order

    def scan(self, index: str = "spo", descending: Sequence[str] = ()) -> DataFrame:
        """All triples ordered by a permutation of the places, each ascending or descending."""
        keyed = self.df.withColumns({f"{c}_key": sort_key_udf(F.col(c)) for c in PLACES})
        return keyed.orderBy(*[F.desc(f"{c}_key") if c in descending else F.asc(f"{c}_key") for c in index]).select(*PLACES)

    def terms(self) -> DataFrame:
        """(term, sort_key) of every term that occurs, once."""
        found = self.df.select(F.explode(F.array(*PLACES)).alias("term")).distinct()
        return found.withColumn("sort_key", sort_key_udf(F.col("term")))

    def ordinals(self, index: str = "spo", descending: Sequence[str] = ()) -> DataFrame:
        """(s, p, o, ordinal): the 0-based place of each triple in the order of ``scan``, numbered in parallel."""
        keyed = self.df.withColumns({f"{c}_key": sort_key_udf(F.col(c)) for c in PLACES})
        return number_rows(keyed, *[F.desc(f"{c}_key") if c in descending else F.asc(f"{c}_key") for c in index]).df.select(*PLACES, F.col("pos").alias("ordinal"))

    def ordinal(self, s: str, p: str, o: str) -> int | None:
        row = self.ordinals().where((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).first()
        return None if row is None else row["ordinal"]

    def view(self, index: str) -> DataFrame:
        """Nested view of a permutation: the sorted third terms of each pair of first and second terms."""
        a, b, c = index
        keyed = self.df.withColumn("key_", sort_key_udf(F.col(c)))
        leaves = F.transform(F.array_sort(F.collect_list(F.struct("key_", F.col(c).alias("term")))), lambda x: x["term"])
        return keyed.groupBy(a, b).agg(leaves.alias(c))

    # -- files

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Parquet partitioned by predicate.  Rows are spread by (p, hash of s), so a predicate that holds most triples
        is written by many tasks."""
        spread = self.df.withColumn("part_", F.pmod(F.xxhash64("s"), F.lit(32))).repartition("p", "part_").sortWithinPartitions("p", "s", "o").drop("part_")
        spread.write.partitionBy("p").mode(mode).parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> TripleStore:
        return TripleStore(spark.read.schema("s string, o string, p string").parquet(path), True)


class Overlay:
    """Additions on top of a store: reads see both, a clean exit commits, an exception discards."""

    def __init__(self, base: TripleStore):
        self.base, self.current, self.committed = base, base, base

    def __enter__(self) -> Overlay:
        return self

    def insert(self, triples: DataFrame) -> None:
        self.current = self.current.insert(triples)

    @property
    def df(self) -> DataFrame:
        return self.current.df

    def __exit__(self, kind, value, trace) -> bool:
        self.committed = self.base if kind else self.current
        if kind:
            self.current = self.base
        return False
