"""Queries of the graph operators over the driver's tables, each beside its SQL.

Relational tables are seen as triples (``sources.relational``); ``triples`` is a graph as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import INFERRED_FROM, OWL, RDF_BAG, RDF_MEMBER, RDF_TYPE, RDFS
from ..operators import versions
from ..operators.numbering import number_rows
from ..operators.store import TripleStore
from ..plans import reasoner
from ..plans.bgp import Var, match, with_sort_keys
from ..plans.rules import default_rules, parse
from ..runtime import new_path, stored
from ..sources import relational, serialise, turtle
from ..sources.relational import Mapping

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MAPPINGS = {
    "region": Mapping("region", ("r_regionkey",), ("r_name",)),
    "nation": Mapping("nation", ("n_nationkey",), ("n_name",), {"n_regionkey": "region"}),
    "supplier": Mapping("supplier", ("s_suppkey",), ("s_name",), {"s_nationkey": "nation"}),
    "customer": Mapping("customer", ("c_custkey",), ("c_name", "c_mktsegment"), {"c_nationkey": "nation"}),
    "part": Mapping("part", ("p_partkey",), ("p_brand", "p_type", "p_size")),
    "orders": Mapping("orders", ("o_orderkey",), ("o_orderstatus", "o_orderpriority"), {"o_custkey": "customer"}),
    "lineitem": Mapping("lineitem", ("l_orderkey", "l_linenumber"), ("l_returnflag", "l_linestatus"), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
}
GEO = ("region", "nation", "supplier")
NUMBERS = {"p_size"}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def graph(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return relational.graph([(table(spark, d, n), MAPPINGS[n]) for n in names])


def as_set(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """The graph without repeats; only line items have a key that is not unique."""
    once = [n for n in names if n != "lineitem"]
    return graph(spark, d, "lineitem").distinct().unionByName(graph(spark, d, *once))


def pred(column: str) -> str:
    return f"<urn:p/{column}>"


def row(name: str, key: object) -> str:
    return f"<urn:t/{name}/{key}>"


# -- SQL of the mapping


def _iri(name: str, *columns: str) -> str:
    return f"'<urn:t/{name}/' || " + " || '/' || ".join(columns) + " || '>'"


def _triples_sql(name: str) -> str:
    m = MAPPINGS[name]
    s = _iri(name, *m.key)
    parts = [f"SELECT {s} AS s, '{RDF_TYPE}' AS p, '<urn:t/{name}>' AS o FROM {name}"]
    parts += [f"SELECT {s}, '{pred(c)}', " + (f"CAST({c} AS VARCHAR)" if c in NUMBERS else f"'\"' || {c} || '\"'") + f" FROM {name} WHERE {c} IS NOT NULL" for c in m.columns]
    parts += [f"SELECT {s}, '{pred(c)}', {_iri(other, c)} FROM {name} WHERE {c} IS NOT NULL" for c, other in m.links.items()]
    return " UNION ALL ".join(parts)


def _with(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}t AS (" + " UNION ALL ".join(_triples_sql(n) for n in names) + ")"


GEO_SQL = _with(*GEO)
_RANK = "CASE WHEN {0} LIKE '<%' THEN 3 WHEN {0} LIKE '\"%' THEN 4 ELSE 6 END, CASE WHEN {0} LIKE '<%' OR {0} LIKE '\"%' THEN left({0}, length({0}) - 1) ELSE {0} END"


def _order(column: str, down: bool = False) -> str:
    return _RANK.format(column) if not down else ", ".join(x + " DESC" for x in _RANK.format(column).split(", CASE", 1)[:1]) + ", CASE" + _RANK.format(column).split(", CASE", 1)[1] + " DESC"


# -- scans and look-ups

_SHAPES = {
    "scan_predicate": (None, pred("n_name"), None), "scan_subject": (row("nation", 7), None, None), "scan_object": (None, None, row("region", 2)),
    "scan_sp": (row("nation", 7), pred("n_name"), None), "scan_po": (None, pred("n_regionkey"), row("region", 1)), "scan_so": (row("nation", 7), None, "<urn:t/nation>"),
    "scan_spo": (row("nation", 7), RDF_TYPE, "<urn:t/nation>"),
}


def _shape(shape: tuple) -> Query:
    return lambda spark, d: TripleStore(graph(spark, d, *GEO), True).where(*shape)


for _name, _terms in _SHAPES.items():
    _where = " AND ".join(f"{c} = '{t}'" for c, t in zip("spo", _terms) if t)
    query(_name, f"{GEO_SQL} SELECT * FROM t WHERE {_where}")(_shape(_terms))


@query("scan_all", f"{GEO_SQL} SELECT * FROM t")
def scan_all(spark, d):
    return TripleStore(graph(spark, d, *GEO), True).scan("pos", ["o"])


@query("contains", f"{GEO_SQL}, w AS (SELECT s, p, o FROM t WHERE p = '{pred('n_name')}' UNION ALL SELECT '<x>', '<y>', '<z>') SELECT w.s, count(t.s) > 0 AS found FROM w LEFT JOIN t USING (s, p, o) GROUP BY w.s")
def contains(spark, d):
    store = TripleStore(graph(spark, d, *GEO), True)
    wanted = store.where(p=pred("n_name")).unionByName(spark.createDataFrame([("<x>", "<y>", "<z>")], "s string, p string, o string"))
    there = store.members(wanted).select("s", F.lit(True).alias("found"))
    return wanted.select("s").join(there, "s", "left").select("s", F.coalesce("found", F.lit(False)).alias("found"))


@query("multi_lookup", f"{GEO_SQL} SELECT * FROM t WHERE s IN (SELECT {_iri('nation', 's_nationkey')} FROM supplier)")
def multi_lookup(spark, d):
    keys = graph(spark, d, "supplier").where(F.col("p") == pred("s_nationkey")).select("o").distinct()
    return TripleStore(graph(spark, d, *GEO), True).lookup("s", keys)


@query("term_dictionary", f"{GEO_SQL} SELECT s AS term FROM t UNION SELECT p FROM t UNION SELECT o FROM t")
def term_dictionary(spark, d):
    return TripleStore(graph(spark, d, *GEO), True).terms().select("term")


@query("triple_ordinal", f"{GEO_SQL} SELECT s, p, o, row_number() OVER (ORDER BY {_order('s')}, {_order('p')}, {_order('o')}) - 1 AS ordinal FROM t")
def triple_ordinal(spark, d):
    return TripleStore(graph(spark, d, *GEO), True).ordinals()


def _lead(place: str) -> Query:
    return lambda spark, d: TripleStore(graph(spark, d, *GEO), True).lead_counts(place).withColumnRenamed(place, "term")


for _place in "spo":
    query(f"lead_counts_{_place}", f"{GEO_SQL} SELECT {_place} AS term, count(*) AS n FROM t GROUP BY {_place}")(_lead(_place))


def _view(index: str) -> Query:
    a, b, c = index
    return lambda spark, d: TripleStore(graph(spark, d, *GEO), True).view(index).select(F.col(a).alias("a"), F.col(b).alias("b"), F.array_join(c, " ").alias("leaves"))


for _index in ("spo", "pos", "osp", "sop", "ops", "pso"):
    _a, _b, _c = _index
    query(f"index_view_{_index}", f"{GEO_SQL} SELECT {_a} AS a, {_b} AS b, string_agg({_c}, ' ' ORDER BY {_order(_c)}) AS leaves FROM t GROUP BY {_a}, {_b}")(_view(_index))


# -- patterns

N, R, C, L, ORDER, X, Y, Z = (Var(v) for v in ("n", "r", "c", "l", "ord", "x", "y", "z"))


@query("bgp_star", "SELECT " + _iri("nation", "n_nationkey") + " AS n, '\"' || n_name || '\"' AS name, " + _iri("region", "n_regionkey") + " AS r FROM nation")
def bgp_star(spark, d):
    return match(graph(spark, d, *GEO), [(N, RDF_TYPE, "<urn:t/nation>"), (N, pred("n_name"), Var("name")), (N, pred("n_regionkey"), R)])


_CHAIN = f"""SELECT DISTINCT {_iri('lineitem', 'l_orderkey', 'l_linenumber')} AS l, {_iri('orders', 'o_orderkey')} AS ord, {_iri('customer', 'c_custkey')} AS c,
 {_iri('nation', 'n_nationkey')} AS n, {_iri('region', 'n_regionkey')} AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


@query("bgp_chain", _CHAIN)
def bgp_chain(spark, d):
    patterns = [(L, pred("l_orderkey"), ORDER), (ORDER, pred("o_custkey"), C), (C, pred("c_nationkey"), N), (N, pred("n_regionkey"), R)]
    return match(as_set(spark, d, "lineitem", "orders", "customer", "nation"), patterns)


@query("bgp_cycle", f"SELECT DISTINCT {_iri('supplier', 's_suppkey')} AS x, {_iri('lineitem', 'l_orderkey', 'l_linenumber')} AS l, {_iri('nation', 's_nationkey')} AS n, {_iri('customer', 'c_custkey')} AS c, {_iri('orders', 'o_orderkey')} AS ord FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey AND c_nationkey = s_nationkey")
def bgp_cycle(spark, d):
    patterns = [(L, pred("l_suppkey"), X), (X, pred("s_nationkey"), N), (C, pred("c_nationkey"), N), (ORDER, pred("o_custkey"), C), (L, pred("l_orderkey"), ORDER)]
    return match(as_set(spark, d, "lineitem", "orders", "customer", "supplier"), patterns)


@query("bgp_cross", "SELECT '\"' || r_name || '\"' AS x, '\"' || n_name || '\"' AS y FROM region, nation")
def bgp_cross(spark, d):
    """A product, because the query's two patterns share nothing; both sides are fixed tables."""
    return match(graph(spark, d, *GEO), [(Var("a"), pred("r_name"), X), (Var("b"), pred("n_name"), Y)]).select("x", "y")


@query("bgp_repeated_var", "SELECT DISTINCT s AS x, p FROM triples WHERE s = o")
def bgp_repeated_var(spark, d):
    return match(table(spark, d, "triples").select("s", "p", "o").distinct(), [(X, Var("p"), X)])


@query("bgp_pred_var", f"{GEO_SQL} SELECT p, o AS x FROM t WHERE s = '{row('nation', 3)}'")
def bgp_pred_var(spark, d):
    return match(graph(spark, d, *GEO), [(row("nation", 3), Var("p"), X)])


@query("bgp_literal_const", f"SELECT {_iri('orders', 'o_orderkey')} AS ord, {_iri('customer', 'o_custkey')} AS c FROM orders WHERE o_orderstatus = 'F'")
def bgp_literal_const(spark, d):
    return match(graph(spark, d, "orders"), [(ORDER, pred("o_orderstatus"), '"F"'), (ORDER, pred("o_custkey"), C)])


@query("bgp_bindings", f"SELECT {_iri('nation', 'n_nationkey')} AS n, {_iri('region', 'n_regionkey')} AS r, '\"' || n_name || '\"' AS name FROM nation WHERE n_regionkey IN (1, 3)")
def bgp_bindings(spark, d):
    given = spark.createDataFrame([(row("region", 1),), (row("region", 3),), ("<none>",)], "r string")
    return match(graph(spark, d, *GEO), [(N, pred("n_regionkey"), R), (N, pred("n_name"), Var("name"))], given)


@query("bgp_semi_join", f"SELECT {_iri('supplier', 's_suppkey')} AS x, {_iri('nation', 's_nationkey')} AS n FROM supplier")
def bgp_semi_join(spark, d):
    return match(graph(spark, d, *GEO), [(X, pred("s_nationkey"), N), (N, RDF_TYPE, "<urn:t/nation>"), (row("region", 0), RDF_TYPE, "<urn:t/region>")])


_WHY = "'<urn:t/nation/' || n_nationkey || '> <urn:p/n_regionkey> <urn:t/region/' || n_regionkey || '>'"


@query("bgp_lineage", f"SELECT {_iri('nation', 'n_nationkey')} AS n, {_WHY} || ' | <urn:t/region/' || r_regionkey || '> <urn:p/r_name> \"' || r_name || '\"' AS why FROM nation JOIN region ON n_regionkey = r_regionkey")
def bgp_lineage(spark, d):
    found = match(graph(spark, d, *GEO), [(N, pred("n_regionkey"), R), (R, pred("r_name"), Var("name"))], lineage="why")
    return found.select("n", F.array_join(F.transform("why", lambda t: F.concat_ws(" ", t["s"], t["p"], t["o"])), " | ").alias("why"))


@query("order_by_mixed", f"{GEO_SQL} SELECT s, p, o, row_number() OVER (ORDER BY {_order('o', True)}, {_order('p')}, {_order('s')}) - 1 AS place FROM t")
def order_by_mixed(spark, d):
    """Place of each solution in the order: object descending, then the others by name."""
    keyed, sorts = with_sort_keys(match(graph(spark, d, *GEO), [(Var("s"), Var("p"), Var("o"))]), [("o", False)])
    return number_rows(keyed, *sorts).df.select("s", "p", "o", F.col("pos").alias("place"))


PERSON_KNOWS = f"""WITH t AS (SELECT DISTINCT s, p, o FROM triples WHERE s IS NOT NULL AND o IS NOT NULL)
SELECT a.s AS x, a.o AS y, b.o AS z FROM t a JOIN t b ON a.s = b.s JOIN t c ON c.s = a.o AND c.o = b.o
WHERE a.p = '<http://xmlns.com/foaf/0.1/knows>' AND b.p = '<https://schema.org/worksFor>' AND c.p = '<https://schema.org/worksFor>' AND a.s <> a.o"""


@query("bgp_colleagues", PERSON_KNOWS)
def bgp_colleagues(spark, d):
    """People who know somebody who works for the same organisation."""
    works = "<https://schema.org/worksFor>"
    t = table(spark, d, "triples").select("s", "p", "o").where(F.col("p").isin("<http://xmlns.com/foaf/0.1/knows>", works)).dropna().distinct()
    return match(t, [(X, "<http://xmlns.com/foaf/0.1/knows>", Y), (X, works, Z), (Y, works, Z)]).where("x <> y")


# -- rules


def _rules(text: str):
    return parse(f"@prefix rdf: <{RDF_TYPE[1:-5]}> .\n@prefix rdfs: <{RDFS}> .\n@prefix owl: <{OWL}> .\n@prefix p: <urn:p/> .\n@prefix t: <urn:t/> .\n{text}")


def inferred(spark: SparkSession, triples: DataFrame, rules, extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    """What the closure adds."""
    if extra:
        triples = triples.unionByName(spark.createDataFrame(list(extra), "s string, p string, o string"))
    return reasoner.closure(triples, rules).triples.where("round > 0").select("s", "p", "o")


SIBLING = _rules("($a p:n_regionkey $r), ($b p:n_regionkey $r) st ($a is-not $b) -> ($a p:sibling $b) .")
SIBLING_SQL = f"SELECT {_iri('nation', 'a.n_nationkey')} AS s, '<urn:p/sibling>' AS p, {_iri('nation', 'b.n_nationkey')} AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"


@query("rule_sibling_is_not", SIBLING_SQL)
def rule_sibling_is_not(spark, d):
    return inferred(spark, graph(spark, d, "nation"), SIBLING)


@query("rule_multi_head", f"SELECT {_iri('region', 'n_regionkey')} AS s, '<urn:p/has>' AS p, {_iri('nation', 'n_nationkey')} AS o FROM nation UNION SELECT {_iri('nation', 'n_nationkey')}, '{RDF_TYPE}', '<urn:t/place>' FROM nation")
def rule_multi_head(spark, d):
    return inferred(spark, graph(spark, d, "nation"), _rules("($n p:n_regionkey $r) -> ($r p:has $n), ($n a t:place) ."))


@query("rule_fixed_subject", f"SELECT {_iri('region', 'n_regionkey')} AS s, '<urn:p/of>' AS p, '{row('nation', 4)}' AS o FROM nation WHERE n_nationkey = 4")
def rule_fixed_subject(spark, d):
    return inferred(spark, graph(spark, d, "nation"), _rules("(<urn:t/nation/4> p:n_regionkey $r) -> ($r p:of <urn:t/nation/4>) ."))


@query("rule_fixed_object", f"SELECT {_iri('customer', 'c_custkey')} AS s, '{RDF_TYPE}' AS p, '<urn:t/builder>' AS o FROM customer WHERE c_mktsegment = 'BUILDING'")
def rule_fixed_object(spark, d):
    return inferred(spark, graph(spark, d, "customer"), _rules('($c p:c_mktsegment "BUILDING") -> ($c a t:builder) .'))


@query("rule_member_of", f"SELECT {_iri('nation', 'n_nationkey')} AS s, '<urn:p/in>' AS p, {_iri('region', 'n_regionkey')} AS o FROM nation")
def rule_member_of(spark, d):
    member = graph(spark, d, "nation").where(F.col("p") == pred("n_regionkey")).select(F.col("o").alias("s"), F.lit(RDF_MEMBER).alias("p"), F.col("s").alias("o"))
    return inferred(spark, member, _rules("($r ∈ $n) -> ($n p:in $r) ."))


@query("rdfs_domain", f"SELECT {_iri('supplier', 's_suppkey')} AS s, '{RDF_TYPE}' AS p, '<urn:t/firm>' AS o FROM supplier")
def rdfs_domain(spark, d):
    return inferred(spark, graph(spark, d, "supplier"), default_rules(), [(pred("s_nationkey"), f"<{RDFS}domain>", "<urn:t/firm>")])


@query("rdfs_range", f"SELECT DISTINCT {_iri('nation', 's_nationkey')} AS s, '{RDF_TYPE}' AS p, '<urn:t/state>' AS o FROM supplier")
def rdfs_range(spark, d):
    return inferred(spark, graph(spark, d, "supplier"), default_rules(), [(pred("s_nationkey"), f"<{RDFS}range>", "<urn:t/state>")])


@query("rdfs_subproperty", f"SELECT {_iri('orders', 'o_orderkey')} AS s, '<urn:p/by>' AS p, {_iri('customer', 'o_custkey')} AS o FROM orders")
def rdfs_subproperty(spark, d):
    return inferred(spark, graph(spark, d, "orders"), default_rules(), [(pred("o_custkey"), f"<{RDFS}subpropertyOf>", "<urn:p/by>")])


_SUBCLASS = f"<{RDFS}subclassOf>"


@query("rdfs_subclass", f"SELECT {_iri('part', 'p_partkey')} AS s, '{RDF_TYPE}' AS p, c AS o FROM part, (VALUES ('<urn:t/goods>'), ('<urn:t/thing>')) v(c)")
def rdfs_subclass(spark, d):
    return inferred(spark, graph(spark, d, "part"), default_rules(), [("<urn:t/part>", _SUBCLASS, "<urn:t/goods>"), ("<urn:t/goods>", _SUBCLASS, "<urn:t/thing>")])


_TYPES_SQL = f"""WITH RECURSIVE base AS (SELECT DISTINCT s, p, o FROM triples WHERE s IS NOT NULL AND o IS NOT NULL AND p IN ('{RDF_TYPE}', '{_SUBCLASS}')),
c AS (SELECT s, o FROM base WHERE p = '{RDF_TYPE}' UNION SELECT c.s, b.o FROM c JOIN base b ON b.p = '{_SUBCLASS}' AND b.s = c.o)
SELECT s, o FROM c"""


@query("rdfs_types_of_graph", _TYPES_SQL)
def rdfs_types_of_graph(spark, d):
    """All types of all nodes of the stated graph under its own class hierarchy."""
    t = table(spark, d, "triples").where(F.col("p").isin(RDF_TYPE, _SUBCLASS)).select("s", "p", "o")
    rule = [r for r in default_rules() if any(p[1] == _SUBCLASS for p in r.body)]
    return reasoner.closure(t, rule, fast=True).triples.where(F.col("p") == RDF_TYPE).select("s", "o")


@query("owl_symmetric", f"SELECT {_iri('region', 'n_regionkey')} AS s, '{pred('n_regionkey')}' AS p, {_iri('nation', 'n_nationkey')} AS o FROM nation")
def owl_symmetric(spark, d):
    return inferred(spark, graph(spark, d, "nation"), default_rules(), [(pred("n_regionkey"), RDF_TYPE, f"<{OWL}SymmetricProperty>")])


@query("owl_inverse", f"SELECT {_iri('customer', 'o_custkey')} AS s, '<urn:p/placed>' AS p, {_iri('orders', 'o_orderkey')} AS o FROM orders UNION ALL SELECT '{pred('o_custkey')}', '<{OWL}inverseOf>', '<urn:p/placed>'")
def owl_inverse(spark, d):
    return inferred(spark, graph(spark, d, "orders"), default_rules(), [("<urn:p/placed>", f"<{OWL}inverseOf>", pred("o_custkey"))])


_IN = "<urn:p/within>"


def _within(spark, d) -> DataFrame:
    t = graph(spark, d, "customer", "nation").where(F.col("p").isin(pred("c_nationkey"), pred("n_regionkey")))
    return t.select("s", F.lit(_IN).alias("p"), "o")


@query("owl_transitive_region", f"SELECT {_iri('customer', 'c_custkey')} AS s, '{_IN}' AS p, {_iri('region', 'n_regionkey')} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def owl_transitive_region(spark, d):
    return inferred(spark, _within(spark, d), default_rules(), [(_IN, RDF_TYPE, f"<{OWL}TransitiveProperty>")])


_TREE = "<urn:p/up>"


def _heap(spark, d) -> DataFrame:
    """Parts as a heap: part k is below part k div 2."""
    parts = table(spark, d, "part").where("p_partkey > 0")
    return parts.select(relational.subject("part", F.col("p_partkey")).alias("s"), F.lit(_TREE).alias("p"), relational.subject("part", F.floor(F.col("p_partkey") / 2)).alias("o"))


@query("owl_transitive_tree", f"WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT {_iri('part', 'a')} AS s, {_iri('part', 'b')} AS o FROM c")
def owl_transitive_tree(spark, d):
    one = [(_TREE, RDF_TYPE, f"<{OWL}TransitiveProperty>")]
    t = _heap(spark, d).unionByName(spark.createDataFrame(one, "s string, p string, o string"))
    rules = [r for r in default_rules() if len(r.body) == 3]
    return reasoner.closure(t, rules).triples.where(F.col("p") == _TREE).select("s", "o")


_COMBINED = [(_IN, RDF_TYPE, f"<{OWL}TransitiveProperty>"), ("<urn:p/holds>", f"<{OWL}inverseOf>", _IN), ("<urn:p/sibling>", RDF_TYPE, f"<{OWL}SymmetricProperty>")]


def _combined(spark, d) -> DataFrame:
    return _within(spark, d).unionByName(spark.createDataFrame(_COMBINED, "s string, p string, o string"))


COMBINED_RULES = [*default_rules(), *_rules("($a p:within $r), ($b p:within $r), ($a a t:nation), ($b a t:nation) st ($a is-not $b) -> ($a p:sibling $b) .")]
_COMBINED_SQL = f"""WITH w AS (SELECT {_iri('customer', 'c_custkey')} AS a, {_iri('nation', 'c_nationkey')} AS b FROM customer UNION ALL SELECT {_iri('nation', 'n_nationkey')}, {_iri('region', 'n_regionkey')} FROM nation
 UNION ALL SELECT {_iri('customer', 'c_custkey')}, {_iri('region', 'n_regionkey')} FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT '<urn:p/within>' AS p, count(*) AS n FROM w UNION ALL SELECT '<urn:p/holds>', count(*) FROM w
UNION ALL SELECT '<urn:p/sibling>', count(*) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
UNION ALL SELECT '<{OWL}inverseOf>', 2 UNION ALL SELECT '{RDF_TYPE}', 2 + count(*) FROM nation"""


@query("closure_combined", _COMBINED_SQL)
def closure_combined(spark, d):
    types = graph(spark, d, "nation").where(F.col("p") == RDF_TYPE)
    return reasoner.closure(_combined(spark, d).unionByName(types), COMBINED_RULES).triples.groupBy("p").agg(F.count("*").alias("n"))


_QUOTED = "'<< ' || {0} || ' ' || '{1}' || ' ' || {2} || ' >>'"


@query("provenance_single", f"SELECT {_QUOTED.format(_iri('region', 'n_regionkey'), '<urn:p/has>', _iri('nation', 'n_nationkey'))} AS s, '{INFERRED_FROM}' AS p, {_QUOTED.format(_iri('nation', 'n_nationkey'), pred('n_regionkey'), _iri('region', 'n_regionkey'))} AS o FROM nation")
def provenance_single(spark, d):
    done = reasoner.closure(graph(spark, d, "nation"), _rules("($n p:n_regionkey $r) -> ($r p:has $n) ."), provenance=True)
    return reasoner.provenance_triples(done.derivations)


@query("provenance_bag", f"SELECT head, string_agg(member, ' | ' ORDER BY member) AS members FROM (SELECT {_QUOTED.format(_iri('nation', 'a.n_nationkey'), '<urn:p/sibling>', _iri('nation', 'b.n_nationkey'))} AS head, unnest([{_QUOTED.format(_iri('nation', 'a.n_nationkey'), pred('n_regionkey'), _iri('region', 'a.n_regionkey'))}, {_QUOTED.format(_iri('nation', 'b.n_nationkey'), pred('n_regionkey'), _iri('region', 'b.n_regionkey'))}]) AS member FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) GROUP BY head")
def provenance_bag(spark, d):
    """Heads and the members of their bags, read back from the statements by patterns."""
    done = reasoner.closure(graph(spark, d, "nation"), SIBLING, provenance=True)
    told = stored(reasoner.provenance_triples(done.derivations))
    found = match(told, [(Var("head"), INFERRED_FROM, Var("bag")), (Var("bag"), RDF_TYPE, RDF_BAG), (Var("bag"), RDF_MEMBER, Var("member"))])
    return found.groupBy("head").agg(F.array_join(F.array_sort(F.collect_set("member")), " | ").alias("members"))


@query("circular_support_rejected", f"SELECT {_iri('region', 'n_regionkey')} AS s, {_iri('nation', 'n_nationkey')} AS o, 1 AS derivations FROM nation")
def circular_support_rejected(spark, d):
    """Deriving a fact back from its own consequence is no derivation of it."""
    one = spark.createDataFrame([(pred("n_regionkey"), RDF_TYPE, f"<{OWL}SymmetricProperty>")], "s string, p string, o string")
    links = graph(spark, d, "nation").where(F.col("p") == pred("n_regionkey"))
    done = reasoner.closure(links.unionByName(one), default_rules(), provenance=True)
    return done.derivations.groupBy("s", "o").agg(F.count("*").cast("int").alias("derivations"))


_LEFT = f"SELECT {_iri('nation', 'a.n_nationkey')} AS s, {_iri('nation', 'b.n_nationkey')} AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_nationkey % 5 <> 0 AND b.n_nationkey % 5 <> 0"


def _deleted(spark, d) -> DataFrame:
    return graph(spark, d, "nation").where((F.col("p") == pred("n_regionkey")) & (F.regexp_extract("s", r"(\d+)>", 1).cast("int") % 5 == 0))


@query("delete_recompute", _LEFT)
def delete_recompute(spark, d):
    done = reasoner.delete(graph(spark, d, "nation"), _deleted(spark, d), SIBLING)
    return done.triples.where(F.col("p") == "<urn:p/sibling>").select("s", "o")


@query("delete_incremental", _LEFT)
def delete_incremental(spark, d):
    base = graph(spark, d, "nation")
    closed = reasoner.closure(base, SIBLING).triples
    return reasoner.delete_incremental(base, closed, _deleted(spark, d), SIBLING).where(F.col("p") == "<urn:p/sibling>").select("s", "o")


@query("delete_ontology_retracts", f"SELECT p, count(*) AS n FROM (SELECT '{pred('n_regionkey')}' AS p FROM nation) GROUP BY p")
def delete_ontology_retracts(spark, d):
    one = spark.createDataFrame([(pred("n_regionkey"), RDF_TYPE, f"<{OWL}SymmetricProperty>")], "s string, p string, o string")
    links = graph(spark, d, "nation").where(F.col("p") == pred("n_regionkey"))
    return reasoner.delete(links.unionByName(one), one, default_rules()).triples.groupBy("p").agg(F.count("*").alias("n"))


@query("callback_rule", f"SELECT {_iri('nation', 'n_nationkey')} AS s, '\"' || upper(n_name) || '!\"' AS o FROM nation")
def callback_rule(spark, d):
    def shout(matches: DataFrame, full: DataFrame) -> DataFrame:
        text = F.upper(F.substring("name", F.lit(2), F.length("name") - 2))
        return matches.select(F.col("n").alias("s"), F.lit("<urn:p/shout>").alias("p"), F.concat(F.lit('"'), text, F.lit('!"')).alias("o"), F.col("matched").alias("premises"))

    done = reasoner.closure(graph(spark, d, "nation"), [], [reasoner.Callback((N, pred("n_name"), Var("name")), shout)])
    return done.triples.where(F.col("p") == "<urn:p/shout>").select("s", "o")


HAS = _rules("($l p:l_orderkey $o) -> ($o p:has $l), ($o p:holds $l) . ($o p:has $l), ($l p:l_suppkey $s) -> ($o p:from $s) .")
_LINES = f"SELECT DISTINCT {_iri('orders', 'l_orderkey')} AS s, '<urn:p/from>' AS p, {_iri('supplier', 'l_suppkey')} AS o FROM lineitem"


def _lines(spark, d) -> DataFrame:
    return graph(spark, d, "lineitem").where(F.col("p").isin(pred("l_orderkey"), pred("l_suppkey"))).distinct()


@query("delete_lines_incremental", f"{_LINES} WHERE l_linenumber <> 3")
def delete_lines_incremental(spark, d):
    """The order of every third line is deleted; an order's suppliers that other lines give stay."""
    base = stored(_lines(spark, d), "lines")
    gone = base.where((F.col("p") == pred("l_orderkey")) & F.col("s").endswith("/3>"))
    closed = reasoner.closure(base, HAS).triples
    return reasoner.delete_incremental(base, closed, gone, HAS).where(F.col("p") == "<urn:p/from>")


@query("delete_lines_recompute", f"{_LINES} WHERE l_linenumber <> 3")
def delete_lines_recompute(spark, d):
    base = _lines(spark, d)
    gone = base.where((F.col("p") == pred("l_orderkey")) & F.col("s").endswith("/3>"))
    return reasoner.delete(base, gone, HAS).triples.where(F.col("p") == "<urn:p/from>").select("s", "p", "o")


_KNOWS = "<http://xmlns.com/foaf/0.1/knows>"


@query("provenance_of_graph", f"SELECT DISTINCT '<< ' || o || ' <urn:p/known> ' || s || ' >>' AS s, '{INFERRED_FROM}' AS p, '<< ' || s || ' {_KNOWS} ' || o || ' >>' AS o FROM triples WHERE p = '{_KNOWS}' AND s IS NOT NULL AND o IS NOT NULL")
def provenance_of_graph(spark, d):
    """Why everybody is known, over the whole stated graph."""
    t = table(spark, d, "triples").select("s", "p", "o")
    done = reasoner.closure(t, _rules(f"($x {_KNOWS} $y) -> ($y p:known $x) ."), provenance=True)
    return reasoner.provenance_triples(done.derivations)


@query("callback_on_graph", f"SELECT DISTINCT s, '\"' || len(o) || '\"' AS o FROM triples WHERE p = '<http://xmlns.com/foaf/0.1/name>' AND s IS NOT NULL AND o IS NOT NULL")
def callback_on_graph(spark, d):
    """A callback over every name of the stated graph: the length of its key."""
    def measure(matches: DataFrame, full: DataFrame) -> DataFrame:
        return matches.select(F.col("n").alias("s"), F.lit("<urn:p/length>").alias("p"), F.concat(F.lit('"'), F.length("name"), F.lit('"')).alias("o"), F.col("matched").alias("premises"))

    done = reasoner.closure(table(spark, d, "triples").select("s", "p", "o"), [], [reasoner.Callback((N, "<http://xmlns.com/foaf/0.1/name>", Var("name")), measure)])
    return done.triples.where(F.col("p") == "<urn:p/length>").select("s", "o")


# -- changes and versions


def _log(spark, d) -> DataFrame:
    """Orders as a log of versioned insertions and deletions of their customers' statuses; a low priority deletes."""
    o = table(spark, d, "orders")
    s = F.concat(F.lit("<urn:t/customer/"), F.col("o_custkey"), F.lit(">"))
    status = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))
    return o.select(s.alias("s"), F.lit("<urn:p/status>").alias("p"), status.alias("o"), F.col("o_orderkey").alias("version"), (F.col("o_orderpriority") == "5-LOW").alias("deleted"))


_LOG_SQL = """WITH log AS (SELECT '<urn:t/customer/' || o_custkey || '>' AS s, '<urn:p/status>' AS p, '"' || o_orderstatus || '"' AS o, o_orderkey AS version, o_orderpriority = '5-LOW' AS deleted FROM orders),
m AS (SELECT *, CASE WHEN NOT deleted AND coalesce(lag(deleted) OVER w, true) THEN 1 ELSE 0 END AS b FROM log WINDOW w AS (PARTITION BY s, p, o ORDER BY version)),
i AS (SELECT *, sum(b) OVER (PARTITION BY s, p, o ORDER BY version) AS k FROM m),
v AS (SELECT s, p, o, min(CASE WHEN NOT deleted THEN version END) AS valid_from, max(CASE WHEN deleted THEN version END) AS valid_to FROM i GROUP BY s, p, o, k)"""


@query("versions_intervals", f"{_LOG_SQL} SELECT * FROM v")
def versions_intervals(spark, d):
    return versions.intervals(_log(spark, d))


@query("versions_as_of", f"{_LOG_SQL} SELECT s, p, o FROM v WHERE valid_from <= 5000 AND (valid_to IS NULL OR valid_to > 5000)")
def versions_as_of(spark, d):
    return versions.as_of(versions.intervals(_log(spark, d)), 5000)


@query("versions_current", f"{_LOG_SQL} SELECT s, p, o FROM v WHERE valid_to IS NULL")
def versions_current(spark, d):
    return versions.current(versions.intervals(_log(spark, d)))


@query("versions_tombstones", f"{_LOG_SQL} SELECT * FROM v WHERE valid_from IS NULL")
def versions_tombstones(spark, d):
    return versions.tombstones(versions.intervals(_log(spark, d)))


@query("insert_dedupe", "SELECT DISTINCT s, p, o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
def insert_dedupe(spark, d):
    t = table(spark, d, "triples")
    return TripleStore(t.where("version = 1")).insert(t).df


@query("delete_missing_noop", f"{GEO_SQL} SELECT * FROM t WHERE p <> '{pred('n_name')}'")
def delete_missing_noop(spark, d):
    store = TripleStore(graph(spark, d, *GEO), True)
    return store.delete(store.where(p=pred("n_name"))).delete(store.where(p=pred("n_name"))).df


@query("overlay_union", f"{_with('region', 'nation')} SELECT * FROM t")
def overlay_union(spark, d):
    base = TripleStore(graph(spark, d, "region"), True)
    with base.overlay() as overlay:
        overlay.insert(graph(spark, d, "nation", "region"))
    return overlay.committed.df


# -- files


@query("disk_round_trip", f"{GEO_SQL} SELECT * FROM t")
def disk_round_trip(spark, d):
    path = new_path(spark, "disk")
    TripleStore(graph(spark, d, *GEO), True).write(path)
    return TripleStore.read(spark, path).df


@query("turtle_round_trip", f"{GEO_SQL} SELECT * FROM t")
def turtle_round_trip(spark, d):
    path = new_path(spark, "turtle")
    serialise.write(graph(spark, d, *GEO), path, [("p", "urn:p/"), ("t", "urn:t/")])
    return turtle.read(spark, path).select("s", "p", "o")


@query("ntriples_round_trip", f"{GEO_SQL} SELECT * FROM t")
def ntriples_round_trip(spark, d):
    path = new_path(spark, "ntriples") + "/x.nt"
    graph(spark, d, *GEO).select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).coalesce(1).write.text(path)
    return turtle.ntriples(spark, path, named="x.nt")[0]
