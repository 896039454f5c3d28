import random

import pytest
from conftest import rows

from tripleloom.operators import hierarchy


def brute(links):
    parents = {}
    for c, p in links:
        if c is not None and p is not None:
            parents[c] = min(p, parents.get(c, p))
    nodes = {x for c, p in links if c is not None and p is not None for x in (c, p)}
    out = {}
    for n in nodes:
        path = [n]
        while path[-1] in parents and parents[path[-1]] not in path:
            path.append(parents[path[-1]])
        out[n] = ("", -1, None) if path[-1] in parents else (path[-1], len(path) - 1, path[::-1])
    return out


def forest(seed, n, roots=3, chain=0.3, cycles=True):
    r = random.Random(seed)
    links = []
    for i in range(roots, n):
        links.append((f"n{i}", f"n{i - 1}" if r.random() < chain else "n0" if r.random() < 0.4 else f"n{r.randrange(i)}"))
    if cycles:
        links += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x1"), ("z", "y"), ("self", "self"), ("under", "self")]
    return links + links[: n // 5] + [(None, "n0"), ("n1", None)]


def check(spark, links, **kw):
    df = spark.createDataFrame(links, "child string, parent string")
    made = hierarchy.hierarchy(df, **kw).persist()
    want = brute(links)
    assert rows(made.select("node", "root", "depth")) == sorted(((n, r, d) for n, (r, d, _) in want.items()), key=repr)
    below = {}
    for n, (_, _, path) in want.items():
        for a in (path or [])[:-1]:
            below[a] = below.get(a, 0) + 1
    assert {r.node: r.descendants for r in made.collect()} == {n: below.get(n, 0) if p else None for n, (_, _, p) in want.items()}
    return made, want


@pytest.mark.parametrize("limits", [{}, {"local_links": 20, "local_arcs": 40}, {"local_links": 0, "local_arcs": 0}])
def test_forest_with_cycles(spark, limits):
    made, want = check(spark, forest(1, 150), **limits)
    for chunk in (3, 1000):
        assert {r.node: r.path for r in hierarchy.paths(made, chunk).collect()} == {n: p for n, (_, _, p) in want.items() if p}
    pairs = {(p[i], n, len(p) - 1 - i) for n, (_, _, p) in want.items() if p for i in range(len(p) - 1)}
    assert set(rows(hierarchy.descendants(made))) == pairs


def test_long_chains_are_doubled(spark):
    """Chains shrink by one node a round when peeled, so doubling takes over."""
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [(f"l{i:02}", f"l{(i + 1) % 20:02}") for i in range(20)]
    check(spark, links, local_links=5, local_arcs=30)


def test_several_parents_and_tiny_inputs(spark):
    check(spark, [("a", "c"), ("a", "b"), ("b", "d")])
    check(spark, [("a", "a")])
    check(spark, [("a", "b")])
    empty = hierarchy.hierarchy(spark.createDataFrame([], "child string, parent string"))
    assert empty.count() == 0
    assert hierarchy.paths(empty).count() == 0
    extra = spark.createDataFrame([("a", "b", 1, 2)], "child string, parent string, id int, depth int")
    assert rows(hierarchy.hierarchy(extra).select("node", "depth")) == [("a", 1), ("b", 0)]


def test_more_trees_than_one_task_takes(spark):
    """Many small trees: their heads and tails never count towards the rest of one task."""
    check(spark, [(f"c{i:03}", f"r{i:03}") for i in range(60)] + [("a", "b"), ("b", "c"), ("c", "d")], local_links=4, local_arcs=4)


def test_parallel_way_on_the_tables(spark):
    """Without the finishing steps by one task, over the stated hierarchies of the test data."""
    from tripleloom.queries import problems

    links = problems.parent_links(spark, "/root/testdata/sf0.001")
    parallel = hierarchy.hierarchy(links, 0, 0).select("node", "root", "depth")
    assert rows(parallel) == rows(problems.p2_found(spark, "/root/testdata/sf0.001"))
