"""Closure of rules over triples by semi-naive rounds, with derivations, deletion and set-at-a-time callbacks.

Each round joins the last round's new triples (the delta) with everything so far, once for every body pattern; the new
triples are those not there yet.  A round's result is a table in the shared folder, so lineage does not grow and lost
executors cost one round at most.  One aggregate over the delta tells which body patterns can match it at all; branches
that cannot are not planned.  Derivations are kept apart from triples and never trigger rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import INFERRED_FROM, RDF_BAG, RDF_MEMBER, RDF_TYPE
from ..runtime import broadcast_if_small, new_path
from .bgp import PLACES, TRIPLE, Pattern, Var, match, scan
from .rules import Rule

DERIVED = f"s string, p string, o string, rule string, premises array<{TRIPLE}>"


@dataclass(frozen=True)
class Callback:
    """``fn(matches, full)`` gives (s, p, o, premises) for the new matches of ``pattern``."""

    pattern: Pattern
    fn: Callable[[DataFrame, DataFrame], DataFrame]
    name: str = "callback"


def row_callback(pattern: Pattern, fn: Callable[..., list[tuple[str, str, str]]], name: str = "callback") -> Callback:
    """A callback by rows: ``fn`` gets the pattern's variables by name and gives triples, with the match as premise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(*t, row["matched"]) for row in b.to_dict("records") for t in fn(**{k: v for k, v in row.items() if k != "matched"})]
            yield pd.DataFrame(made, columns=["s", "p", "o", "premises"])

    return Callback(pattern, lambda matches, _: matches.mapInPandas(run, f"s string, p string, o string, premises array<{TRIPLE}>"), name)


@dataclass(frozen=True)
class RuleCallback:
    """``fn`` gets the variables of a match of ``pattern`` by name and gives rules, which then hold for all triples.

    The new matches of a round are read by the driver, because rules are plans: the pattern should be that of a
    declaration.  A rule that was given before is not added again.
    """

    pattern: Pattern
    fn: Callable[..., list[Rule]]


@dataclass
class Closure:
    """``triples`` with ``round`` (0: asserted), ``derivations`` if they were kept, and what each round brought."""

    triples: DataFrame
    derivations: DataFrame | None
    rounds: list[int] = field(default_factory=list)


def _constants(pattern: Pattern) -> tuple:
    return tuple(t if not isinstance(t, Var) else None for t in pattern)


#: Matches of a pattern, counted beforehand, up to which they are broadcast (some megabytes of terms).
BROADCAST_ROWS = 20_000


def _possible(delta: DataFrame, shapes: set[tuple]) -> tuple[int, dict[tuple, int]]:
    """Number of triples of ``delta``, and how many have each shape (constants or None by place) that some have; one job."""
    listed = sorted(shapes, key=str)

    def has(shape: tuple):
        conditions = [F.col(c) == F.lit(t) for c, t in zip(PLACES, shape) if t is not None]
        return F.count_if(reduce(lambda a, b: a & b, conditions, F.lit(True))).alias(f"f{listed.index(shape)}")

    row = delta.agg(F.count("*").alias("n"), *[has(s) for s in listed]).first()
    return row["n"], {s: row[f"f{i}"] for i, s in enumerate(listed) if row[f"f{i}"]}


def _heads(solutions: DataFrame, rule: Rule, lineage: str | None) -> DataFrame:
    for a, b in rule.differ:
        solutions = solutions.where(F.col(a) != F.col(b))
    for condition in rule.conditions:
        solutions = solutions.where(condition(F.col))
    made = [F.struct(*[(F.col(t.name) if isinstance(t, Var) else F.lit(t)).alias(c) for c, t in zip(PLACES, h)]) for h in rule.head]
    extra = [F.lit(rule.name).alias("rule"), F.col(lineage).alias("premises")] if lineage else []
    return solutions.select(F.inline(F.array(*made)), *extra) if not extra else solutions.select(F.explode(F.array(*made)).alias("h"), *extra).select("h.*", "rule", "premises")


_HIDDEN = "<urn:x-tripleloom:path:"


def accelerate(rules: Sequence[Rule]) -> list[Rule]:
    """The same consequences in logarithmically many rounds along chains.

    A rule (t P u), (x Q t) -> (x Q u) climbs one link of P a round.  It is replaced by the closure of P, which doubles
    its reach in each round, under a hidden predicate, and one step along it.
    """
    made: list[Rule] = []
    for rule in rules:
        steps = [(a, b) for a, b in (rule.body, rule.body[::-1])] if len(rule.body) == 2 and len(rule.head) == 1 and not rule.differ and not rule.conditions else []
        for (t, link, u), (x, q, again) in steps:
            names = [v for v in (t, u, x, again) if isinstance(v, Var)]
            if len(names) == 4 and len({t, u, x}) == 3 and again == t and not isinstance(link, Var) and not isinstance(q, Var) and rule.head == ((x, q, u),) and link != q:
                path, mid = f"{_HIDDEN}{link[1:]}", Var("mid_")
                made += [
                    Rule(((t, link, u),), ((t, path, u),), (), f"{rule.name}/path"), Rule(((t, path, mid), (mid, path, u)), ((t, path, u),), (), f"{rule.name}/join"),
                    Rule(((t, path, u), (x, q, t)), ((x, q, u),), (), rule.name),
                ]
                break
        else:
            made.append(rule)
    return list(dict.fromkeys(made))


def derive(rules: Sequence[Rule], old: DataFrame, delta: DataFrame, full: DataFrame, live: dict | None = None, there: dict | None = None, before: dict | None = None, lineage: bool = False) -> list[DataFrame]:
    """Heads of all rule instances with at least one premise in ``delta``; ``full`` is ``old`` and ``delta``.

    Pattern i of a body reads the delta, patterns before it ``old`` and patterns behind it ``full``, so each instance is
    found once.  ``live``, ``there`` and ``before`` have the constant shapes that occur in delta, in full and in old, and
    how often.  Patterns with few matches by these counts (declarations, mostly) are broadcast, so that the triples that
    they are joined with are not shuffled by predicate.
    """
    found = []

    def sized(source: DataFrame, pattern: Pattern, counts: dict | None) -> DataFrame:
        small = counts is not None and _constants(pattern) != (None, None, None) and counts.get(_constants(pattern), 0) <= BROADCAST_ROWS
        return F.broadcast(source) if small else source

    for rule in rules:
        for i, trigger in enumerate(rule.body):
            if live is not None and _constants(trigger) not in live:
                continue
            if there is not None and any(_constants(p) not in there for p in rule.body):
                continue
            if before is not None and any(_constants(p) not in before for p in rule.body[:i]):
                continue
            sources = [sized(old, p, before) for p in rule.body[:i]] + [sized(delta, trigger, live)] + [sized(full, p, there) for p in rule.body[i + 1 :]]
            found.append(_heads(match(sources, rule.body, lineage="premises_" if lineage else None), rule, "premises_" if lineage else None))
    return found


def closure(triples: DataFrame, rules: Sequence[Rule], callbacks: Sequence[Callback | RuleCallback] = (), provenance: bool = False, base: DataFrame | None = None, most_rounds: int | None = None, fast: bool = False) -> Closure:
    """Least fixpoint of ``rules`` over ``triples``; with ``base``, a closed set that ``triples`` are added to.

    The result does not depend on the order of loading.  With ``provenance`` every derivation is kept: the first ones of
    a triple always, later ones unless they are circular in one step.  Rules alone always end; callbacks that make ever
    new terms do not.  ``most_rounds`` bounds the rounds that bring something new: a closure that needs more of them
    raises a RuntimeError and returns nothing.  ``fast`` uses ``accelerate``; it keeps no
    derivations, and ``round`` is then the round in which the accelerated rules found a triple.
    """
    rules = list(rules)
    if fast:
        if provenance:
            raise ValueError("accelerated rules have other premises")
        rules = accelerate(rules)
    spark = triples.sparkSession
    root = new_path(spark, "closure")
    base = base.select(*PLACES) if base is not None else spark.createDataFrame([], "s string, p string, o string")
    start = triples.select(*PLACES).dropna().distinct().join(base, PLACES, "left_anti")
    start.write.parquet(f"{root}/triples/round=0")
    shapes = {_constants(p) for r in rules for p in r.body} | {_constants(c.pattern) for c in callbacks}
    there = _possible(base, shapes)[1]
    read = lambda rounds: spark.read.schema("s string, p string, o string").parquet(*[f"{root}/triples/round={k}" for k in rounds])
    counts, k = [], 0
    while True:
        delta = read([k])
        n, live = _possible(delta, shapes)
        counts.append(n)
        if not n:
            break
        if most_rounds is not None and k > most_rounds:
            raise RuntimeError(f"no fixpoint after {most_rounds} rounds: round {k} brings {n} more triples")
        before, there = there, {k: there.get(k, 0) + live.get(k, 0) for k in there.keys() | live.keys()}
        old = base.unionByName(read(range(k))) if k else base
        full = base.unionByName(read(range(k + 1)))
        found = derive(rules, old, delta, full, live, there, before, provenance)
        for c in callbacks:
            if isinstance(c, RuleCallback):
                if _constants(c.pattern) in live:
                    given = [r for m in scan(delta, c.pattern).distinct().collect() for r in c.fn(**m.asDict())]
                    given = [r for r in dict.fromkeys(given) if r not in rules]
                    rules = [*rules, *given]
                    late = shapes | {_constants(p) for r in given for p in r.body}
                    if late != shapes:
                        shapes, there = late, _possible(full, late)[1]
                    found += derive(given, base.where("false"), full, full, lineage=provenance)
            elif _constants(c.pattern) in live:
                made = c.fn(scan(delta, c.pattern, "matched"), full)
                found.append(made.select(*PLACES, F.lit(c.name).alias("rule"), F.array_sort(F.array_distinct("premises")).alias("premises")) if provenance else made.select(*PLACES))
        if not found:
            break
        heads = reduce(DataFrame.unionByName, found)
        k += 1
        if provenance:
            heads.distinct().write.parquet(f"{root}/candidates/{k}")
            heads = spark.read.schema(DERIVED).parquet(f"{root}/candidates/{k}")
            fresh = heads.select(*PLACES).distinct().join(full, PLACES, "left_anti")
            fresh.write.parquet(f"{root}/triples/round={k}")
            first = heads.join(read([k]), PLACES, "left_semi")
            again = heads.join(full, PLACES, "left_semi")
            if k > 1:
                known = spark.read.schema(DERIVED).parquet(*[f"{root}/derivations/{j}" for j in range(1, k)])
                again = _not_circular(again, known)
                again = again.join(known, [*PLACES, "premises"], "left_anti")
            first.unionByName(again).dropDuplicates([*PLACES, "premises"]).write.parquet(f"{root}/derivations/{k}")
        else:
            heads.distinct().join(full, PLACES, "left_anti").write.parquet(f"{root}/triples/round={k}")
    every = spark.read.schema("s string, p string, o string, round int").option("basePath", f"{root}/triples").parquet(*[f"{root}/triples/round={j}" for j in range(len(counts))])
    if fast:
        every = every.where(~F.col("p").startswith(_HIDDEN))
    kept = None
    if provenance:
        kept = spark.read.schema(DERIVED).parquet(*[f"{root}/derivations/{j}" for j in range(1, k + 1)]) if k else spark.createDataFrame([], DERIVED)
    result = base.withColumn("round", F.lit(0)).unionByName(every)
    return Closure(result, kept, counts)


def _not_circular(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Without derivations of which a premise was itself derived from the head."""
    used = known.select(F.struct(*PLACES).alias("premise"), F.explode("premises").alias("head")).distinct()
    one = candidates.withColumn("head", F.struct(*PLACES)).withColumn("premise", F.explode("premises"))
    bad = one.join(used, ["head", "premise"], "left_semi").select(*PLACES, "premises").distinct()
    return candidates.join(bad, [*PLACES, "premises"], "left_anti")


def quoted(s, p, o):
    """Key of a triple as a term."""
    return F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" >>"))


def provenance_triples(derivations: DataFrame) -> DataFrame:
    """Derivations as statements about statements: one premise directly, several through a bag.

    A bag is named by a hash of its premises and head, so an identical bag is one bag.
    """
    head = quoted(F.col("s"), F.col("p"), F.col("o"))
    premise = lambda x: quoted(x["s"], x["p"], x["o"])
    told = derivations.select(head.alias("head"), F.transform("premises", premise).alias("premises"))
    bag = F.concat(F.lit("_:bag/"), F.sha2(F.concat_ws("\n", F.col("head"), F.array_join("premises", "\n")), 256))
    said = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    single = F.array(said(F.col("head"), INFERRED_FROM, F.element_at("premises", 1)))
    several = F.concat(F.array(said(F.col("head"), INFERRED_FROM, bag), said(bag, RDF_TYPE, F.lit(RDF_BAG))), F.transform("premises", lambda x: said(bag, RDF_MEMBER, x)))
    return told.where(F.size("premises") > 0).select(F.inline(F.when(F.size("premises") == 1, single).otherwise(several))).distinct()


def delete(asserted: DataFrame, deleted: DataFrame, rules: Sequence[Rule], callbacks: Sequence[Callback] = (), provenance: bool = False) -> Closure:
    """Closure of what is asserted and not deleted.  A deleted triple that still follows stays, as an inferred one."""
    return closure(asserted.select(*PLACES).join(deleted.select(*PLACES), PLACES, "left_anti"), rules, callbacks, provenance)


def delete_incremental(asserted: DataFrame, closed: DataFrame, deleted: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The same triples as ``delete``, from the closed set: over-delete what may depend, then derive again what still follows.

    ``closed`` is the closure of ``asserted``.  Rules are matched from the deleted triples on, and then backwards from the
    over-deleted ones: their terms bind the head's variables before any body pattern is read.
    """
    spark = closed.sparkSession
    root = new_path(spark, "deleted")
    closed = closed.select(*PLACES)
    asserted = asserted.select(*PLACES).join(deleted.select(*PLACES), PLACES, "left_anti")
    read = lambda rounds: spark.read.schema("s string, p string, o string").parquet(*[f"{root}/{k}" for k in rounds])
    deleted.select(*PLACES).distinct().join(closed, PLACES, "left_semi").write.parquet(f"{root}/0")
    shapes = {_constants(p) for r in rules for p in r.body}
    there = _possible(closed, shapes)[1]
    k = 0
    while True:
        gone = read([k])
        n, live = _possible(gone, shapes)
        found = derive(rules, closed, gone, closed, live, there, there) if n else []
        if not found:
            break
        heads = reduce(DataFrame.unionByName, found).distinct().join(closed, PLACES, "left_semi").join(read(range(k + 1)), PLACES, "left_anti")
        k += 1
        heads.write.parquet(f"{root}/{k}")
    over = read(range(k + 1))
    left = closed.join(over, PLACES, "left_anti")
    again = [over.join(asserted, PLACES, "left_semi")]
    heads = {_constants(h) for r in rules for h in r.head}
    wanted = _possible(over, heads)[1]
    for rule in rules:  # what follows at once from what is left, among the over-deleted
        for head in rule.head:
            if _constants(head) in wanted:
                bound = broadcast_if_small(scan(over, head).distinct())
                again.append(_heads(match(left, rule.body, bindings=bound if bound.columns != ["match_"] else None), replace(rule, head=(head,)), None).join(over, PLACES, "left_semi"))
    seed = reduce(DataFrame.unionByName, again).distinct()
    return closure(seed, rules, base=left).triples.select(*PLACES)
