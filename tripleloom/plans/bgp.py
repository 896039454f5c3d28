"""Basic graph patterns as DataFrame joins.

A pattern is (s, p, o) of canonical keys and variables.  The patterns are folded into a natural equi-join on shared
variables: constants are filters that reach the scan, repeated variables an equality, a pattern without new variables
a semi-join.  Join order: most constants first, then connected patterns, so that a Cartesian product is made only where
the query itself has unconnected parts.  Catalyst and AQE choose the physical joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import sort_key_udf
from ..runtime import stored

PLACES = ["s", "p", "o"]
TRIPLE = "struct<s:string,p:string,o:string>"


@dataclass(frozen=True, order=True)
class Var:
    name: str

    def __repr__(self) -> str:
        return f"${self.name}"


Term = str | Var
Pattern = tuple[Term, Term, Term]


def variables(pattern: Pattern) -> list[str]:
    """Names in the order of their places, each once."""
    return list(dict.fromkeys(t.name for t in pattern if isinstance(t, Var)))


def scan(triples: DataFrame, pattern: Pattern, lineage: str | None = None) -> DataFrame:
    """The matches of one pattern, a column for each variable, and the triple as array ``lineage`` if it is named."""
    first: dict[str, str] = {}
    for place, term in zip(PLACES, pattern):
        if not isinstance(term, Var):
            triples = triples.where(F.col(place) == F.lit(term))
        elif term.name in first:
            triples = triples.where(F.col(place) == F.col(first[term.name]))
        else:
            first[term.name] = place
    columns = [F.col(place).alias(name) for name, place in first.items()]
    if lineage:
        columns.append(F.array(F.struct("s", "p", "o")).alias(lineage))
    return triples.select(*columns) if columns else triples.select(F.lit(1).alias("match_")).limit(1)


def join_order(patterns: Sequence[Pattern], bound: Iterable[str] = ()) -> list[int]:
    """Greedy: connected to what is bound, then fewest free variables, then a bound subject, then as written.

    A bound subject usually has few objects, while a bound object may have a great many subjects.
    """
    seen, left, order = set(bound), list(range(len(patterns))), []
    while left:
        def rank(i: int) -> tuple:
            names = set(variables(patterns[i]))
            subject = patterns[i][0]
            return (bool(seen) and not names & seen and bool(names), len(names - seen), isinstance(subject, Var) and subject.name not in seen, i)

        best = min(left, key=rank)
        left.remove(best)
        order.append(best)
        seen |= set(variables(patterns[best]))
    return order


def match(triples: DataFrame | Sequence[DataFrame], patterns: Sequence[Pattern], bindings: DataFrame | dict[str, str] | None = None, lineage: str | None = None) -> DataFrame:
    """Solutions of all patterns: one column for each variable.

    ``triples`` is one table, or one for each pattern.  ``bindings`` are given values: a dict, or a table of solutions to
    join with.  ``lineage`` names a column for the distinct set of matched triples.  No pattern gives one empty solution.
    """
    tables = list(triples) if not isinstance(triples, DataFrame) else [triples] * len(patterns)
    if isinstance(bindings, dict):
        patterns = [tuple(bindings.get(t.name, t) if isinstance(t, Var) else t for t in p) for p in patterns]
    solution = bindings if isinstance(bindings, DataFrame) else None
    spark = (triples if isinstance(triples, DataFrame) else tables[0]).sparkSession
    for i in join_order(patterns, solution.columns if solution is not None else ()):
        names = variables(patterns[i])
        found = scan(tables[i], patterns[i], "matched_" if lineage else None)
        if solution is None:
            solution = found.withColumnRenamed("matched_", lineage) if lineage else found
            continue
        shared = [n for n in names if n in solution.columns]
        if not names:
            solution = solution.join(F.broadcast(found)) if lineage else solution.join(F.broadcast(found)).drop("match_")  # at most one row
        elif shared:
            solution = solution.join(found, shared, "left_semi" if len(shared) == len(names) and not lineage else "inner")
        else:
            solution = solution.crossJoin(found)
        if lineage:
            merged = F.array_union(F.coalesce(F.col(lineage), F.array().cast(f"array<{TRIPLE}>")), F.col("matched_")) if lineage in solution.columns else F.col("matched_")
            solution = solution.withColumn(lineage, merged).drop("matched_")
    if solution is None:
        solution = spark.range(1).select()
    if lineage and lineage in solution.columns:
        solution = solution.withColumn(lineage, F.array_sort(F.array_distinct(lineage)))
    if isinstance(bindings, dict):
        solution = solution.withColumns({n: F.lit(v) for n, v in bindings.items()})
    return solution.drop("match_")


def order_of(columns: Sequence[str], order_by: Sequence[tuple[str, bool]] = ()) -> list[tuple[str, bool]]:
    """The conditions (name, ascending), then the other variables ascending by name."""
    unknown = [n for n, _ in order_by if n not in columns]
    if unknown:
        raise ValueError(f"ORDER BY names variables that no pattern binds: {unknown}")
    return [*order_by, *[(n, True) for n in sorted(columns) if n not in {n for n, _ in order_by}]]


def with_sort_keys(solutions: DataFrame, order_by: Sequence[tuple[str, bool]] = ()) -> tuple[DataFrame, list[Column]]:
    """Solutions with a binary key for each variable, and the sort expressions over the keys; unbound is lowest."""
    order = order_of(solutions.columns, order_by)
    keyed = solutions.withColumns({f"key{i}_": sort_key_udf(F.col(n)) for i, (n, _) in enumerate(order)})
    return keyed, [F.col(f"key{i}_").asc_nulls_first() if up else F.col(f"key{i}_").desc_nulls_last() for i, (_, up) in enumerate(order)]


def ordered(solutions: DataFrame, order_by: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    """Solutions in the total order of terms."""
    keyed, sorts = with_sort_keys(solutions, order_by)
    return keyed.orderBy(*sorts).select(*solutions.columns)


class Statistics:
    """How many triples each pattern of a query visited; read after the query ran."""

    def __init__(self) -> None:
        self._seen: list = []

    def watch(self, df: DataFrame) -> DataFrame:
        from pyspark.sql import Observation

        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    @property
    def triples_visited(self) -> int:
        return sum(o.get["n"] for o in self._seen)


def execute(triples: DataFrame, patterns: Sequence[Pattern], order_by: Sequence[tuple[str, bool]] = (), bindings: DataFrame | dict[str, str] | None = None) -> tuple[DataFrame, Statistics]:
    """Ordered solutions and the statistics of the run.  The query runs here, once: a sort may read its input twice."""
    stats = Statistics()
    solutions = match([stats.watch(_constants(triples, p)) for p in patterns] if patterns else triples, patterns, bindings)
    order_of(solutions.columns, order_by)
    if solutions.columns:
        solutions = stored(solutions, "solutions")
    return ordered(solutions, order_by), stats


def _constants(triples: DataFrame, pattern: Pattern) -> DataFrame:
    for place, term in zip(PLACES, pattern):
        if not isinstance(term, Var):
            triples = triples.where(F.col(place) == F.lit(term))
    return triples
