import pytest
from conftest import F2, rows, term

from tripleloom.operators.store import TripleStore
from tripleloom.plans.bgp import Var, execute, join_order, match, ordered

S, P, O, PERSON, NAME = Var("s"), Var("p"), Var("o"), Var("person"), Var("name")
IS_PERSON, HAS_NAME = (PERSON, term("a"), term("foaf:Person")), (PERSON, term("foaf:name"), NAME)


@pytest.fixture(scope="module")
def graph(spark):
    return TripleStore.of(spark, F2).df


def test_full_scan_with_mixed_order(graph):
    solutions, stats = execute(graph, [(S, P, O)], [("s", False), ("p", True)])
    got = [(r.s.rsplit("/")[-1][:-1], r.p.rsplit("/")[-1].rsplit("#")[-1][:-1]) for r in solutions.collect()]
    assert got == [
        *[("w3", x) for x in ("type", "name")], *[("eric-miller", x) for x in ("type", "knows", "mbox", "name", "title", "worksFor")], *[("dave-smith", x) for x in ("type", "knows", "name")],
    ]
    assert stats.triples_visited == 11


def test_join_and_descending(graph):
    names = ['"Dave Smith"', '"Eric Miller"']
    assert [r["name"] for r in execute(graph, [IS_PERSON, HAS_NAME])[0].collect()] == names
    assert [r["name"] for r in execute(graph, [IS_PERSON, HAS_NAME], [("name", False)])[0].collect()] == names[::-1]


def test_unknown_order_variable(graph):
    with pytest.raises(ValueError):
        ordered(match(graph, [HAS_NAME]), [("nothing", True)])


def test_no_pattern_is_one_empty_solution(graph):
    assert match(graph, []).collect() == [()]


def test_ground_patterns(graph):
    assert match(graph, [F2[0]]).count() == 1
    assert match(graph, [F2[0], HAS_NAME]).count() == 3
    assert match(graph, [(F2[0][2], F2[0][1], F2[0][0]), HAS_NAME]).count() == 0
    assert match(graph, [F2[0], F2[1]]).count() == 1


def test_semi_join_when_all_is_bound(graph):
    x, y = Var("x"), Var("y")
    both = match(graph, [(x, term("foaf:knows"), y), (y, term("foaf:knows"), x)])
    assert both.count() == 2


def test_repeated_variable(spark):
    df = spark.createDataFrame([("<a>", "<p>", "<a>"), ("<a>", "<p>", "<b>"), ("<p>", "<p>", "<p>")], "s string, p string, o string")
    assert rows(match(df, [(S, "<p>", S)])) == [("<a>",), ("<p>",)]
    assert rows(match(df, [(S, S, S)])) == [("<p>",)]


def test_predicate_variable_and_literal(graph):
    assert rows(match(graph, [(S, P, '"Dr"')]).select("s", "p")) == [(term("ex:eric-miller"), term("foaf:title"))]


def test_cartesian_product_only_where_the_query_has_one(graph):
    assert match(graph, [IS_PERSON, (S, term("foaf:title"), O)]).count() == 2
    assert join_order([(S, P, O), (Var("x"), "<p>", "<o>"), (S, "<p>", "<o>")]) == [1, 2, 0]
    assert join_order([(S, "<p>", O), (O, "<q>", Var("z")), (Var("z"), "<r>", "<c>")]) == [2, 1, 0]


def test_bindings(spark, graph):
    eric = term("ex:eric-miller")
    assert rows(match(graph, [HAS_NAME], {"person": eric}).select("person", "name")) == [(eric, '"Eric Miller"')]
    assert match(graph, [HAS_NAME], {"name": '"Nobody"'}).count() == 0
    given = spark.createDataFrame([(eric, 1), ("<none>", 2)], "person string, extra int")
    assert rows(match(graph, [HAS_NAME], given).select("person", "name", "extra")) == [(eric, '"Eric Miller"', 1)]


def test_lineage(graph):
    row = match(graph, [IS_PERSON, HAS_NAME], lineage="why").where("name = '\"Dave Smith\"'").collect()[0]
    assert {tuple(t) for t in row["why"]} == {F2[0], F2[1]}
    same = match(graph, [HAS_NAME, (PERSON, term("foaf:name"), Var("again"))], lineage="why").where("name = again").collect()
    assert all(len(r["why"]) == 1 for r in same)


def test_empty_graph(spark):
    df = spark.createDataFrame([], "s string, p string, o string")
    assert match(df, [IS_PERSON, HAS_NAME]).count() == 0
