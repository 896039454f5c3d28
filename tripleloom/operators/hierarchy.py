"""Parent-child links to full hierarchies: Euler tours ranked in parallel.

1. Nodes get dense numbers in term order; a node has one parent (of several stated ones the smallest;
   the others stay nodes).
2. Leaves are peeled: what is left when nothing can be peeled are exactly the nodes on cycles.  Rounds shrink the links
   geometrically; where they shrink slowly (long chains), pointer doubling resolves the rest; the last ``LOCAL_LINKS``
   links are peeled by one task.
3. Cycle nodes lose their parent link, so all links form a forest, whose Euler tours are lists of two arcs a node.
4. Lists are ranked by contraction: in each round the arcs whose hash is a local minimum are spliced out (about a third,
   never two neighbours), until at most ``LOCAL_ARCS`` inner arcs remain, which one task ranks; then the removed arcs are
   ranked in reverse order of rounds.  Work is linear in the number of arcs, rounds are logarithmic.
5. The ranks of a node's two arcs are its entry and exit; from them come depth, root, number of descendants, ancestor
   tests, and by a sweep in tour order the paths.

The finishing steps by one task save rounds only; with 0 for both bounds there are none, and the result is the same.

Defined cases: links with a NULL end do not count; repeated links count once; a node that is its own parent is a cycle;
nodes on or below a cycle have root ``''`` and depth -1; without links there are no nodes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .numbering import number_rows

#: Most links that one task peels, and most inner arcs that one task ranks (32 bytes an arc).
LOCAL_LINKS = 50_000
LOCAL_ARCS = 50_000
#: Nodes in tour order whose paths one group makes.
PATH_CHUNK = 20_000
#: A peeling round that removes less than this share of the links ends peeling in favour of pointer doubling.
SLOW_PEEL = 0.05


def numbered_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, node) of all nodes in term order, and (child, parent) ids with one parent a child."""
    links = stored(links.select("child", "parent").dropna().distinct(), "links")
    one = links.groupBy("child").agg(F.min("parent").alias("parent"))
    names = links.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    nodes = number_rows(names, "node").df.select(F.col("pos").alias("id"), "node")
    ids = one.join(nodes.select(F.col("id").alias("child_id"), F.col("node").alias("child")), "child")
    ids = ids.join(nodes.select(F.col("id").alias("parent_id"), F.col("node").alias("parent")), "parent")
    return nodes, stored(ids.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent")), "forest")


def _peel_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Children on cycles among the links of one task."""
    held = list(batches)
    if not held:
        return
    links = pd.concat(held, ignore_index=True)
    while len(links):
        stays = links["child"].isin(links["parent"].unique())
        if stays.all():
            break
        links = links[stays]
    yield links[["child"]]


def cycle_nodes(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(child): the nodes on cycles of a graph in which each child has one parent."""
    left = links.count()
    while left > local:
        links = stored(links.join(links.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent"), "peeled")
        before, left = left, links.count()
        if left == before:
            return links.select("child")
        if left > local and left > (1 - SLOW_PEEL) * before:
            return _image_of_doubling(links)
    # the schema's column order fixes what the task sees; at most `local` rows
    return links.select("child", "parent").repartition(1).mapInPandas(_peel_all, "child bigint")


def _image_of_doubling(links: DataFrame) -> DataFrame:
    """The nodes that remain in the image of parent^(2^k) once doubling k removes no node from the image: the cycles."""
    jumps, before = links, -1
    while True:
        image = jumps.select(F.col("parent").alias("child")).distinct()
        size = image.count()
        if size == before:
            # a permutation of the image; nodes at the top of a chain have no jump left
            return image
        before = size
        far = jumps.select(F.col("child").alias("parent"), F.col("parent").alias("far"))
        jumps = stored(jumps.join(far, "parent").select("child", F.col("far").alias("parent")), "jumps")


def euler_arcs(links: DataFrame) -> DataFrame:
    """(id, nxt, prv, n, d): arc 2v goes down to node v, arc 2v+1 leaves it; lists begin and end at roots.

    Next and previous siblings come from exact row numbers over (parent, child), not from a window by parent.
    """
    numbered = number_rows(links, "parent", "child").df.select("pos", "parent", "child")
    none = F.lit(None).cast("bigint")
    mine = numbered.select("pos", "parent", "child", none.alias("np"), none.alias("nc"), none.alias("pp"), none.alias("pc"))
    after = numbered.select((F.col("pos") - 1).alias("pos"), none.alias("parent"), none.alias("child"), F.col("parent").alias("np"), F.col("child").alias("nc"), none.alias("pp"), none.alias("pc"))
    before = numbered.select((F.col("pos") + 1).alias("pos"), none.alias("parent"), none.alias("child"), none.alias("np"), none.alias("nc"), F.col("parent").alias("pp"), F.col("child").alias("pc"))
    kin = mine.unionByName(after).unionByName(before).groupBy("pos").agg(*[F.max(c).alias(c) for c in ("parent", "child", "np", "nc", "pp", "pc")]).where("child IS NOT NULL")
    kin = kin.select(F.col("child").alias("v"), "parent", F.when(F.col("np") == F.col("parent"), F.col("nc")).alias("younger"), F.when(F.col("pp") == F.col("parent"), F.col("pc")).alias("older"))
    offspring = links.groupBy(F.col("parent").alias("v")).agg(F.min("child").alias("eldest"), F.max("child").alias("youngest"))
    node = kin.join(offspring, "v", "full")
    down, up = F.col("v") * 2, F.col("v") * 2 + 1
    next_down = F.coalesce(F.col("eldest") * 2, up)
    prev_down = F.coalesce(F.col("older") * 2 + 1, F.col("parent") * 2)
    next_up = F.coalesce(F.col("younger") * 2, F.col("parent") * 2 + 1)
    prev_up = F.coalesce(F.col("youngest") * 2 + 1, down)
    arc = lambda i, n, p, d: F.struct(i.alias("id"), n.alias("nxt"), p.alias("prv"), F.lit(1).cast("bigint").alias("n"), F.lit(d).cast("bigint").alias("d"))
    return node.select(F.inline(F.array(arc(down, next_down, prev_down, 1), arc(up, next_up, prev_up, -1))))


def _rank_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffix sums of the inner parts of lists in one task, by pointer jumping over arrays; ``nxt`` is what follows a part."""
    held = list(batches)
    if not held:
        return
    arcs = pd.concat(held, ignore_index=True)
    ids = arcs["id"].to_numpy(np.int64)
    order = np.argsort(ids)
    ids, size = ids[order], len(ids)
    n, d, nxt = (np.append(arcs[c].to_numpy(np.int64)[order], 0) for c in ("n", "d", "nxt"))
    at = np.searchsorted(ids, nxt[:size])
    at = np.append(np.where((at < size) & (ids[np.minimum(at, size - 1)] == nxt[:size]), at, size), size)
    while (at[:size] != size).any():
        nxt = np.where(at == size, nxt, nxt[at])
        n, d, at = n + n[at], d + d[at], at[at]
    yield pd.DataFrame({"id": ids, "nxt": nxt[:size], "n": n[:size], "d": d[:size]})


def rank_lists(arcs: DataFrame, local: int = LOCAL_ARCS) -> DataFrame:
    """(id, n, d, tail): for each list element the sums of ``n`` and ``d`` from it to its list's end, and the last id.

    Elements between two others are spliced out round by round until at most ``local`` of them remain (0: none), whatever
    the number of lists; heads and tails are never moved to one task.
    """
    level, rounds = stored(arcs, "arcs"), []
    inner = F.col("prv").isNotNull() & F.col("nxt").isNotNull()
    left = level.where(inner).count()
    while left > local:
        seed = len(rounds)
        luck = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)), F.col(c))  # noqa: B023, E731
        low = F.coalesce(inner & (luck("id") < luck("prv")) & (luck("id") < luck("nxt")), F.lit(False))
        out = level.where(low)
        rounds.append(out.select("id", "nxt", "n", "d"))
        none = F.lit(None).cast("bigint")
        stay = level.where(~low).select("id", "nxt", "prv", "n", "d", none.alias("new_nxt"), none.alias("new_prv"))
        ahead = out.select(F.col("nxt").alias("id"), none.alias("nxt"), none.alias("prv"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("d"), none.alias("new_nxt"), F.col("prv").alias("new_prv"))
        behind = out.select(F.col("prv").alias("id"), none.alias("nxt"), none.alias("prv"), "n", "d", F.col("nxt").alias("new_nxt"), none.alias("new_prv"))
        merged = stay.unionByName(ahead).unionByName(behind).groupBy("id").agg(
            F.coalesce(F.max("new_nxt"), F.max("nxt")).alias("nxt"), F.coalesce(F.max("new_prv"), F.max("prv")).alias("prv"), F.sum("n").alias("n"), F.sum("d").alias("d")
        )
        level = stored(merged, "level")
        left = level.where(inner).count()
    tails = level.where("nxt IS NULL").select("id", "n", "d", F.col("id").alias("tail"))
    ends = tails.select(F.col("id").alias("nxt"), F.col("n").alias("rest_n"), F.col("d").alias("rest_d"), "tail")
    if left:  # at most `local` rows
        parts = level.where(inner).select("id", "nxt", "n", "d").repartition(1).mapInPandas(_rank_all, "id bigint, nxt bigint, n bigint, d bigint")
        ranked = stored(tails.unionByName(_behind(parts, ends)), "ranked")
        ends = ranked.select(F.col("id").alias("nxt"), F.col("n").alias("rest_n"), F.col("d").alias("rest_d"), "tail")
    else:
        ranked = tails
    ranked = ranked.unionByName(_behind(level.where("prv IS NULL AND nxt IS NOT NULL"), ends))
    for out in reversed(rounds):
        ranked = stored(ranked, "ranked")
        ranked = ranked.unionByName(_behind(out, ranked.select(F.col("id").alias("nxt"), F.col("n").alias("rest_n"), F.col("d").alias("rest_d"), "tail")))
    return ranked


def _behind(elements: DataFrame, known: DataFrame) -> DataFrame:
    """Ranks of elements from those of what follows them."""
    return elements.join(known, "nxt").select("id", (F.col("n") + F.col("rest_n")).alias("n"), (F.col("d") + F.col("rest_d")).alias("d"), "tail")


def _tour(links: DataFrame, local_links: int, local_arcs: int) -> tuple[DataFrame, DataFrame]:
    """Names of the nodes, and by node id: root id, depth, first and last number in the tour, whether it is on a cycle's tree.

    Numbers fall along the tour: the descendants of v are the nodes with ``leave`` < number of v's arcs < ``enter``.
    """
    nodes, forest = numbered_forest(links)
    loops = stored(cycle_nodes(forest, local_links).select("child").distinct(), "loops")
    trees = stored(forest.join(loops, "child", "left_anti").select("child", "parent"), "trees")
    # cycle nodes without other children, and parents that were stated but not chosen
    lone = nodes.select("id").join(trees.select(F.explode(F.array("child", "parent")).alias("id")).distinct(), "id", "left_anti")
    ranked = rank_lists(euler_arcs(trees), local_arcs)
    is_up = F.col("id") % 2 == 1
    spans = ranked.groupBy(F.shiftright("id", 1).alias("id")).agg(
        F.max(F.when(~is_up, F.col("n"))).alias("enter"), F.max(F.when(is_up, F.col("n"))).alias("leave"), (-F.max(F.when(~is_up, F.col("d")))).alias("depth"), F.shiftright(F.max("tail"), 1).alias("root")
    )
    spans = spans.unionByName(lone.select("id", F.lit(2).cast("bigint").alias("enter"), F.lit(1).cast("bigint").alias("leave"), F.lit(0).cast("bigint").alias("depth"), F.col("id").alias("root")))
    spans = spans.join(loops.select(F.col("child").alias("root"), F.lit(True).alias("cyclic")), "root", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    return nodes, spans


def hierarchy(links: DataFrame, local_links: int = LOCAL_LINKS, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(node, root, depth, enter, leave, descendants) for each node of ``links`` (child, parent)."""
    nodes, spans = _tour(links, local_links, local_arcs)
    named = spans.join(nodes, "id").join(nodes.select(F.col("id").alias("root"), F.col("node").alias("root_node")), "root")
    span = lambda c: F.when(~F.col("cyclic"), F.col(c))
    return named.select(
        "node", F.when(F.col("cyclic"), "").otherwise(F.col("root_node")).alias("root"), F.when(F.col("cyclic"), -1).otherwise(F.col("depth")).cast("int").alias("depth"),
        span("enter").alias("enter"), span("leave").alias("leave"), F.when(~F.col("cyclic"), F.shiftright(F.col("enter") - F.col("leave"), 1)).alias("descendants"),
    )


def _sweep(open_nodes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Paths of consecutive nodes in tour order; ``open_nodes`` are the ancestors of the first."""
    if not len(rows):
        return pd.DataFrame({"node": [], "path": []})
    stack = list(open_nodes.sort_values("level")["above"])
    paths = []
    rows = rows.sort_values("pos")
    for node, depth in zip(rows["node"], rows["depth"]):
        del stack[depth:]
        stack.append(node)
        paths.append(list(stack))
    return pd.DataFrame({"node": rows["node"], "path": paths})


def paths(tree: DataFrame, chunk: int = PATH_CHUNK) -> DataFrame:
    """(node, path): the terms from the root to the node, for the nodes of ``hierarchy`` that have a root.

    Nodes are numbered in tour order and cut into chunks of ``chunk`` numbers.  A chunk is swept with a stack whose start
    are the ancestors of its first node; those are the nodes whose span covers the chunk's start, found from the numbers.
    """
    ordered = number_rows(tree.where("depth >= 0").select("node", "root", "depth", "enter", "descendants"), "root", F.desc("enter")).df
    of = lambda c: F.floor(c / chunk)
    first, last = of(F.col("pos")), of(F.col("pos") + F.col("descendants"))
    crossing = ordered.where(first < last).select(F.col("node").alias("above"), F.col("depth").alias("level"), F.explode(F.sequence(first + 1, last)).alias("chunk"))
    return ordered.withColumn("chunk", first).groupBy("chunk").cogroup(crossing.groupBy("chunk")).applyInPandas(lambda rows, stack: _sweep(stack, rows), "node string, path array<string>")


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): every pair of a node and a node below it; the size is the sum of depths."""
    pair = F.posexplode(F.reverse(F.slice("path", 1, F.size("path") - 1)))
    return paths(tree).select(F.col("node").alias("descendant"), pair.alias("distance", "ancestor")).select("ancestor", "descendant", (F.col("distance") + 1).alias("distance"))
