"""Queries of text forms, orders, collections, callbacks and the command line, each beside its SQL."""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import cli
from ..functions import collections as C
from ..functions.terms import OWL, RDF_TYPE, RDFS, XSD, sort_key_udf
from ..operators.numbering import number_rows
from ..operators.store import TripleStore
from ..plans import reasoner
from ..plans.bgp import Statistics, Var, match, with_sort_keys
from ..plans.rules import Rule, default_rules
from ..runtime import new_path, spread, stored
from ..sources import serialise, turtle
from .graph import GEO, _iri, _order, _with, graph, pred, query, table

X, Y, N = Var("x"), Var("y"), Var("n")


def _document(spark, rows: DataFrame, label: str, *head: str) -> str:
    """A folder of Turtle documents, one a part file, of the statements in the column ``text``."""
    path = new_path(spark, label)

    def run(batches):
        first = True
        for b in batches:
            if first and len(b):
                first = False
                yield pd.DataFrame({"text": head}, dtype="object")
            yield b[["text"]]

    rows.select("text").mapInPandas(run, "text string").write.text(path)
    return path


def _read(spark, rows: DataFrame, *head: str) -> DataFrame:
    return turtle.read(spark, _document(spark, rows, "document", *head)).select("s", "p", "o")


# -- Turtle


@query("turtle_blank_nodes", "SELECT " + _iri("supplier", "s_suppkey") + """ AS x, '"' || s_name || '"' AS name, CAST(n_regionkey AS VARCHAR) AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def turtle_blank_nodes(spark, d):
    """Nested property lists in brackets: what hangs on two levels of blank nodes."""
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.format_string('<urn:t/supplier/%d> p:home [ p:name "%s" ; p:in [ p:region %d ], [] ] .', "s_suppkey", "s_name", "n_regionkey")
    t = stored(_read(spark, joined.select(text.alias("text")), "@prefix p: <urn:p/> ."), "triples")
    home = [(X, pred("home"), Var("b")), (Var("b"), pred("name"), Var("name")), (Var("b"), pred("in"), Var("c")), (Var("c"), pred("region"), Y)]
    return match(t, home).select("x", "name", "y")


_SEEN = _iri("orders", "o_orderkey") + " || ' <urn:p/o_custkey> ' || " + _iri("customer", "o_custkey")


@query("turtle_quoted", f"SELECT '<< ' || {_SEEN} || ' >>' AS s, '<urn:p/on>' AS p, '\"' || o_orderpriority || '\"@en' AS o FROM orders UNION SELECT {_iri('orders', 'o_orderkey')}, '<urn:p/o_custkey>', {_iri('customer', 'o_custkey')} FROM orders")
def turtle_quoted(spark, d):
    """Statements about quoted triples, which are also asserted."""
    text = F.format_string('<< <urn:t/orders/%d> p:o_custkey <urn:t/customer/%d> >> p:on "%s"@en .', "o_orderkey", "o_custkey", "o_orderpriority")
    return _read(spark, table(spark, d, "orders").select(text.alias("text")), "PREFIX p: <urn:p/>").distinct()


_KINDS = {  # Turtle text by name, and the canonical key as SQL
    "plain": ("'%s'", """'"' || p_name || '"'"""), "long": ('"""a "%s"\nb"""', """'"a \\"' || p_name || '\\"\\nb"'"""), "tag": ('"%s"@fr-be', """'"' || p_name || '"@fr-be'"""),
    "typed": (f'"%s"^^<{XSD}token>', f"""'"' || p_name || '"^^<{XSD}token>'"""), "string": (f'"%s"^^<{XSD}string>', """'"' || p_name || '"'"""), "escape": ('"\\u0041\\t%s"', """'"A\\t' || p_name || '"'"""),
}
_NUMBERS = {"integer": ("%d", "CAST(p_size AS VARCHAR)"), "decimal": ("-%d.50", "'-' || p_size || '.50'"), "double": ("%d.0E-3", "p_size || '.0E-3'")}
_PART = "SELECT {0} AS s, '<urn:p/{1}>' AS p, {2} AS o FROM part"


@query("turtle_literals", " UNION ALL ".join(_PART.format(_iri("part", "p_partkey"), k, sql) for k, (_, sql) in (_KINDS | _NUMBERS).items()) + " UNION ALL " + _PART.format(_iri("part", "p_partkey"), "flag", f"""'"' || (p_size > 20) || '"^^<{XSD}boolean>'"""))
def turtle_literals(spark, d):
    """Every form of literal: quotes of all kinds, language, datatype, escapes, the three kinds of numbers, booleans."""
    says = [F.concat(F.lit(f"p:{k} "), F.format_string(form, "p_name")) for k, (form, _) in _KINDS.items()]
    says += [F.concat(F.lit(f"p:{k} "), F.format_string(form, "p_size")) for k, (form, _) in _NUMBERS.items()]
    says.append(F.concat(F.lit("p:flag "), (F.col("p_size") > 20).cast("string")))
    text = F.concat(F.format_string("<urn:t/part/%d> ", "p_partkey"), F.concat_ws(" ; ", *says), F.lit(" ."))
    return _read(spark, spread(table(spark, d, "part")).select(text.alias("text")), "@prefix p: <urn:p/> .")


_DEEP = 11


@query("turtle_inline_blanks", "SELECT " + _iri("supplier", "s_suppkey") + f" || ' ' || repeat('p:in [ ', {_DEEP}) || 'p:name \"' || s_name || '\"' || repeat(' ]', {_DEEP}) || ' .' || chr(10) AS block FROM supplier")
def turtle_inline_blanks(spark, d):
    """Blank nodes that one triple refers to are written in place, however deep."""
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("<urn:t/supplier/"), F.col("s_suppkey"), F.lit(">")).alias("s"), F.col("s_suppkey").alias("k"), "s_name")
    name = lambda i: F.concat(F.lit("_:b/"), F.col("k"), F.lit("0"), F.lit(100) + i)
    links = nodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(_DEEP - 1))).alias("i"))
    chain = links.select(F.when(F.col("i") == 0, F.col("s")).otherwise(name(F.col("i") - 1)).alias("s"), F.lit(pred("in")).alias("p"), name(F.col("i")).alias("o"))
    ends = nodes.select(name(F.lit(_DEEP - 1)).alias("s"), F.lit(pred("name")).alias("p"), F.concat(F.lit('"'), F.col("s_name"), F.lit('"')).alias("o"))
    return serialise.blocks(chain.unionByName(ends), [("p", "urn:p/")]).select("block")


# -- orders

_KIND_SQL = r"""CASE WHEN x IS NULL THEN 0 WHEN x LIKE '<<%' THEN 1 WHEN x LIKE '\_:%' ESCAPE '\' THEN 2 WHEN x LIKE '<%' THEN 3 WHEN x LIKE '"%"' THEN 4 WHEN x LIKE '"%>' THEN 9 WHEN x LIKE '"%' THEN 5
 WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN 6 WHEN regexp_full_match(x, '[+-]?[0-9]*[.][0-9]+') THEN 7 ELSE 8 END"""
_VALUE_SQL = r"""CASE k WHEN 3 THEN x[2:-2] WHEN 4 THEN x[2:-2] WHEN 5 THEN regexp_extract(x, '^"(.*)"@', 1, 's') WHEN 9 THEN regexp_extract(x, '^"(.*)"\^\^<', 1, 's') WHEN 2 THEN regexp_extract(x, '^_:(.*)/', 1) END"""
_MORE_SQL = r"""CASE k WHEN 5 THEN regexp_extract(x, '@([A-Za-z0-9-]+)$', 1) WHEN 9 THEN regexp_extract(x, '\^\^<([^>]*)>$', 1) END"""
_NUMBER_SQL = r"""CASE k WHEN 2 THEN TRY_CAST(regexp_extract(x, '/([0-9]+)$', 1) AS DECIMAL(38,10)) WHEN 6 THEN TRY_CAST(x AS DECIMAL(38,10)) WHEN 7 THEN TRY_CAST(x AS DECIMAL(38,10)) END"""


def _keyed(source: str) -> str:
    """SQL of the parts that order the terms ``x`` of a table; quoted triples by their three (unquoted) components."""
    parts = f"k, {_VALUE_SQL} AS v, {_MORE_SQL} AS m, {_NUMBER_SQL} AS n, CASE WHEN k = 8 THEN TRY_CAST(x AS DOUBLE) END AS f"
    split = r"""regexp_extract(x, '^<< (\S+) (\S+) (.*) >>$', {0})"""
    inner = " ".join(f"LEFT JOIN one q{i} ON q{i}.x = {split.format(i)} AND t.x LIKE '<<%'".replace("(x,", "(t.x,") for i in (1, 2, 3))
    return f"""terms AS (SELECT DISTINCT x FROM {source}), every AS (SELECT x FROM terms UNION SELECT unnest([{', '.join(split.format(i) for i in (1, 2, 3))}]) FROM terms WHERE x LIKE '<<%'),
one AS (SELECT x, {parts} FROM (SELECT x, {_KIND_SQL} AS k FROM every)),
keyed AS (SELECT t.x, row_number() OVER (ORDER BY o.k, {', '.join(f'q{i}.{c}' for i in (1, 2, 3) for c in 'kvmnf')}, o.v, o.m, o.n, o.f, t.x) AS rank FROM terms t JOIN one o ON o.x = t.x {inner})"""


@query("sort_key_order", f"WITH {_keyed('(SELECT o AS x FROM triples WHERE o IS NOT NULL)')} SELECT x AS o, rank - 1 AS place FROM keyed")
def sort_key_order(spark, d):
    """The place of every object of the graph in the total order of all nine kinds of terms."""
    t = table(spark, d, "triples").select("o").dropna().distinct()
    return number_rows(t.withColumn("key", sort_key_udf(F.col("o"))), "key").df.select("o", F.col("pos").alias("place"))


@query("order_unbound", f"WITH {_keyed('(SELECT o AS x FROM triples WHERE o IS NOT NULL UNION SELECT s FROM triples WHERE s IS NOT NULL)')} SELECT r.s, r.o, row_number() OVER (ORDER BY a.rank NULLS FIRST, b.rank DESC NULLS LAST) - 1 AS place FROM (SELECT DISTINCT s, o FROM triples WHERE s IS NULL OR o IS NULL OR p = '{RDF_TYPE}') r LEFT JOIN keyed a ON a.x = r.o LEFT JOIN keyed b ON b.x = r.s")
def order_unbound(spark, d):
    """Rows with unbound terms, which are lowest in both directions of the order."""
    t = table(spark, d, "triples").where(F.col("s").isNull() | F.col("o").isNull() | (F.col("p") == RDF_TYPE)).select("s", "o").distinct()
    keyed, sorts = with_sort_keys(t, [("o", True), ("s", False)])
    return number_rows(keyed, *sorts).df.select("s", "o", F.col("pos").alias("place"))


_SCANS = [("spo", ""), ("spo", "spo"), ("sop", "o"), ("pso", "p"), ("pos", "s"), ("osp", "os"), ("ops", "")]


def _scan_sql(index: str, down: str) -> str:
    return f"SELECT '{index}-{down}' AS way, s, p, o, row_number() OVER (ORDER BY {', '.join(_order(c, c in down) for c in index)}) - 1 AS place FROM t"


@query("scan_ordered", f"{_with(*GEO, 'customer')} " + " UNION ALL ".join(_scan_sql(*w) for w in _SCANS))
def scan_ordered(spark, d):
    """Ordered scans of all six permutations, in several directions, with the place of each triple."""
    store = TripleStore(stored(graph(spark, d, *GEO, "customer"), "graph"), True)
    made = [store.ordinals(index, list(down)).select(F.lit(f"{index}-{down}").alias("way"), "s", "p", "o", F.col("ordinal").alias("place")) for index, down in _SCANS]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


@query("index_for_order", f"{_with(*GEO)} SELECT 's,p' AS asked, s, p, o, row_number() OVER (ORDER BY {_order('s')}, {_order('p')}, {_order('o')}) - 1 AS place FROM t WHERE p = '{pred('n_name')}' UNION ALL SELECT 'o,s', s, p, o, row_number() OVER (ORDER BY {_order('o', True)}, {_order('s')}) - 1 FROM t WHERE p = '{pred('s_nationkey')}'")
def index_for_order(spark, d):
    """Orders that a permutation of the places would serve: here a range-partitioned sort of what the constants leave."""
    t = graph(spark, d, *GEO)
    made = []
    for asked, p, order in (("s,p", pred("n_name"), [("s", True), ("p", True)]), ("o,s", pred("s_nationkey"), [("o", False), ("s", True)])):
        keyed, sorts = with_sort_keys(t.where(F.col("p") == p), order)
        made.append(number_rows(keyed, *sorts).df.select(F.lit(asked).alias("asked"), "s", "p", "o", F.col("pos").alias("place")))
    return made[0].unionByName(made[1])


@query("triples_visited", "SELECT count(*) AS visited FROM (SELECT 1 FROM orders UNION ALL SELECT 1 FROM customer)")
def triples_visited(spark, d):
    """How many triples the two patterns of a query read."""
    stats, t = Statistics(), graph(spark, d, "orders", "customer")
    patterns = [(X, pred("o_custkey"), Y), (Y, pred("c_nationkey"), N)]
    match([stats.watch(t.where(F.col("p") == p[1])) for p in patterns], patterns).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(stats.triples_visited,)], "visited bigint")


# -- collections

_ITEMS = "SELECT o_custkey AS k, list(DISTINCT o_orderkey % 97 ORDER BY o_orderkey % 97) AS xs FROM orders GROUP BY o_custkey"


@query("sorted_list", f"""SELECT k, array_to_string(xs, ' ') AS items, array_to_string(list_sort(list_distinct(list_append(xs, 50))), ' ') AS inserted, array_to_string(list_filter(xs, lambda x: x <> 7), ' ') AS deleted,
 CASE WHEN list_contains(xs, 30) THEN list_position(xs, 30) - 1 END AS at, len(list_filter(xs, lambda x: x < 30)) AS lower, len(list_filter(xs, lambda x: x <= 30)) AS upper, array_to_string(list_reverse_sort(xs), ' ') AS downward FROM ({_ITEMS})""")
def sorted_list(spark, d):
    """A sorted list for each customer: insertion, deletion, place, bisection, both directions."""
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.col("o_orderkey") % 97).alias("raw"))
    xs, text = C.sorted_list(F.col("raw")), lambda c: F.array_join(c.cast("array<string>"), " ")
    return rows.select(
        "k", text(xs).alias("items"), text(C.insert(xs, F.lit(50).cast("bigint"))).alias("inserted"), text(C.delete(xs, F.lit(7).cast("bigint"))).alias("deleted"), C.index(xs, F.lit(30).cast("bigint")).alias("at"),
        C.bisect_left(xs, F.lit(30)).alias("lower"), C.bisect_right(xs, F.lit(30)).alias("upper"), text(C.in_order(xs, True)).alias("downward"),
    )


_MAP = "SELECT s_nationkey AS k, s_suppkey % 31 AS i, max(s_suppkey) AS v FROM supplier GROUP BY ALL"
_JOINED = "string_agg(i || '=' || v, ' ' ORDER BY i)"


@query("sorted_mapping", f"""WITH m AS ({_MAP}), ks AS (SELECT DISTINCT k FROM m), more AS (SELECT k, i, v FROM m WHERE i <> 3 UNION ALL SELECT k, 3, -1 FROM ks)
SELECT k, (SELECT {_JOINED} FROM m WHERE m.k = ks.k) AS entries, (SELECT {_JOINED} FROM more m WHERE m.k = ks.k) AS put, coalesce((SELECT v FROM m WHERE m.k = ks.k AND i = 5), 0) AS got,
 coalesce((SELECT {_JOINED} FROM m WHERE m.k = ks.k AND i IN (1, 2, 5, 8)), '') AS many, coalesce((SELECT {_JOINED} FROM m WHERE m.k = ks.k AND i <> 5), '') AS removed FROM ks""")
def sorted_mapping(spark, d):
    """A sorted mapping for each nation: get or a default, several keys at once, put, remove."""
    pairs = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 31).alias("i")).agg(F.max("s_suppkey").alias("v"))
    rows = pairs.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    m, big = C.sorted_map(F.col("m")), lambda n: F.lit(n).cast("bigint")
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return rows.select(
        "k", text(m).alias("entries"), text(C.put(m, big(3), big(-1))).alias("put"), C.get_or(m, big(5), big(0)).alias("got"), text(C.get_many(m, F.array(*map(big, (1, 2, 5, 8))))).alias("many"), text(C.remove(m, big(5))).alias("removed")
    )


# -- rules


@query("closure_incremental_insert", f"SELECT {_iri('customer', 'o_custkey')} AS s, '<urn:p/placed>' AS p, {_iri('orders', 'o_orderkey')} AS o FROM orders")
def closure_incremental_insert(spark, d):
    """A closed store to which the other half of the orders and, later, the declaration are added."""
    t = graph(spark, d, "orders").where(F.col("p") == pred("o_custkey"))
    half = F.pmod(F.xxhash64("s"), F.lit(2)) == 0
    one = spark.createDataFrame([("<urn:p/placed>", f"<{OWL}inverseOf>", pred("o_custkey"))], "s string, p string, o string")
    first = reasoner.closure(t.where(half), default_rules()).triples
    second = reasoner.closure(one, default_rules(), base=first).triples
    third = reasoner.closure(t.where(~half), default_rules(), base=second).triples
    return third.where(F.col("p") == "<urn:p/placed>").select("s", "p", "o")


@query("rule_registered_by_callback", f"SELECT {_iri('supplier', 's_suppkey')} AS s, '<urn:p/' || lower(n_name) || '>' AS p, '\"yes\"' AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def rule_registered_by_callback(spark, d):
    """A callback on each nation's name makes a rule of its own for the nation's suppliers."""
    def register(n: str, name: str) -> list[Rule]:
        return [Rule(((X, pred("s_nationkey"), n),), ((X, f"<urn:p/{name[1:-1].lower()}>", '"yes"'),), (), f"of {n}")]

    t = graph(spark, d, "nation", "supplier")
    done = reasoner.closure(t, [], [reasoner.RuleCallback((N, pred("n_name"), Var("name")), register)])
    return done.triples.where("round > 0").select("s", "p", "o")


@query("rule_condition", f"SELECT {_iri('part', 'p_partkey')} AS s, '{RDF_TYPE}' AS p, '<urn:t/large>' AS o FROM part WHERE p_size > 40 AND p_brand LIKE 'Brand#1%'")
def rule_condition(spark, d):
    """A rule with constraints that the rule language has no words for."""
    conditions = (lambda v: v("size").cast("int") > 40, lambda v: v("brand").startswith('"Brand#1'))
    rule = Rule(((X, pred("p_size"), Var("size")), (X, pred("p_brand"), Var("brand"))), ((X, RDF_TYPE, "<urn:t/large>"),), (), "large", conditions)
    return reasoner.closure(graph(spark, d, "part"), [rule]).triples.where("round > 0").select("s", "p", "o")


@query("map_terms", "SELECT DISTINCT replace(s, 'kg.example', 'kg.test') AS s, replace(p, 'kg.example', 'kg.test') AS p, replace(o, 'kg.example', 'kg.test') AS o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
def map_terms(spark, d):
    return TripleStore(table(spark, d, "triples")).map_terms(lambda c: F.replace(c, F.lit("kg.example"), F.lit("kg.test"))).df


# -- command line

_CAT = f"""SELECT '# Triples ' || (SELECT count(*) FROM nation) || chr(10) AS text UNION ALL SELECT '@prefix p: <urn:p/> .' || chr(10) || chr(10)
UNION ALL SELECT {_iri('nation', 'n_nationkey')} || ' p:n_name "' || n_name || '" .' || chr(10) FROM nation"""


def _names(spark, d, *head: str) -> str:
    text = F.format_string('<urn:t/nation/%d> p:n_name "%s" .', "n_nationkey", "n_name")
    return _document(spark, table(spark, d, "nation").select(text.alias("text")), "names.ttl", *head) + "/*"


@query("cli_cat", _CAT)
def cli_cat(spark, d):
    """What ``cat`` prints and writes: the count, the prefixes, the blocks."""
    return cli.run(spark, "cat", [], {}, data=[_names(spark, d, "@prefix p: <urn:p/> .")]).text()


@query("cli_namespaces", "SELECT * FROM (VALUES ('p', 'urn:p/'), ('q', 'urn:q/')) v(prefix, iri)")
def cli_namespaces(spark, d):
    """Of two definitions of a prefix the first counts: that of the command line here."""
    done = cli.run(spark, "cat", [], {"q": "urn:q/"}, data=[_names(spark, d, "@prefix p: <urn:p/> .", "@prefix q: <urn:other/> .")])
    return spark.createDataFrame(list(done.namespaces.items()), "prefix string, iri string")


@query("cli_reason", f"SELECT {_iri('nation', 'n_nationkey')} AS s, '<urn:p/label>' AS p, '\"' || n_name || '\"' AS o FROM nation UNION ALL SELECT {_iri('nation', 'n_nationkey')}, '<urn:p/n_name>', '\"' || n_name || '\"' FROM nation UNION ALL SELECT '<urn:p/n_name>', '<{RDFS}subpropertyOf>', '<urn:p/label>'")
def cli_reason(spark, d):
    """``reason`` with the default rules and a declaration in the document; statements about derivations left out."""
    head = ("@prefix p: <urn:p/> .", f"p:n_name <{RDFS}subpropertyOf> p:label .")
    return cli.run(spark, "reason", [], {}, data=[_names(spark, d, *head)], provenance=False).triples


@query("cli_log", "SELECT * FROM (VALUES ('parsing'), ('reasoning')) v(step)")
def cli_log(spark, d):
    """The steps whose times are logged."""
    said: list[str] = []
    handler = logging.Handler()
    handler.emit = lambda record: said.append(record.getMessage().split(" took ")[0])  # type: ignore[method-assign]
    level = cli.logger.level
    cli.logger.addHandler(handler)
    cli.logger.setLevel(logging.INFO)
    try:
        cli.run(spark, "reason", [], {}, data=[_names(spark, d, "@prefix p: <urn:p/> .")])
    finally:
        cli.logger.removeHandler(handler)
        cli.logger.setLevel(level)
    return spark.createDataFrame([(s,) for s in said], "step string")


@query("dot_lines", f"""{_with('nation')}, n AS (SELECT s AS x FROM t UNION SELECT o FROM t)
SELECT 0 AS part, unnest(['# ' || (SELECT count(*) FROM t), 'digraph G {{', '    rankdir = "TB"', '    newrank = true', '    K = 1.5', '    node [shape=box]']) AS line
UNION ALL SELECT 1, 'n' || sha256(x) || ' [label="' || replace(x, '"', '\\"') || '"]' FROM n UNION ALL SELECT 2, 'n' || sha256(s) || ' -> n' || sha256(o) || ' [label="' || p || '"]' FROM t UNION ALL SELECT 3, '}}'""")
def dot_lines(spark, d):
    return serialise.dot(graph(spark, d, "nation"))
