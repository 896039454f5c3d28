r"""Triples to Turtle-star text, and to Graphviz DOT.

Each subject is one block of text, made in parallel: objects sorted within predicates, ``a`` first, blocks in the order
of terms with quoted subjects last.  A blank node that one triple refers to is written in place as ``[ … ]``, innermost
first, one round a level of nesting; those on cycles keep labels.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import TextIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.terms import BLANK, IRI, QUOTED, RDF_TYPE, TYPED, kind_of, sort_key_udf, split_quoted
from ..runtime import stored

_SAFE_LOCAL = re.compile(r"(?:[A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?)?")


def render(key: str, namespaces: Sequence[tuple[str, str]]) -> str:
    """Turtle text of a term; the first namespace in the given order that fits is used."""
    kind = kind_of(key)
    if kind == IRI:
        value = key[1:-1]
        for prefix, start in namespaces:
            if value.startswith(start) and _SAFE_LOCAL.fullmatch(value[len(start) :]):
                return f"{prefix}:{value[len(start) :]}"
        return key
    if kind == QUOTED:
        return f"<< {' '.join(render(t, namespaces) for t in split_quoted(key))} >>"
    if kind == BLANK:
        return "_:" + re.sub(r"[^A-Za-z0-9]", lambda m: f"_{ord(m[0]):x}_", key[2:])
    if kind == TYPED:
        at = key.rindex('"^^')
        return key[: at + 3] + render(key[at + 3 :], namespaces)
    return key


def _render_udf(namespaces: Sequence[tuple[str, str]]):
    @F.pandas_udf(StringType())
    def run(keys: pd.Series) -> pd.Series:
        return keys.map({k: render(k, namespaces) for k in keys.dropna().unique()})

    return run


def _lists(rows: DataFrame) -> DataFrame:
    """(s, text): the predicate-object list of each subject of (s, p, p_text, o, o_text)."""
    keyed = rows.select("s", "p", "p_text", sort_key_udf(F.col("p")).alias("p_key"), sort_key_udf(F.col("o")).alias("o_key"), "o_text")
    objects = keyed.groupBy("s", "p", "p_text", "p_key").agg(F.array_sort(F.collect_list(F.struct("o_key", "o_text"))).alias("os"))
    pair = F.concat(F.col("p_text"), F.lit(" "), F.array_join(F.transform("os", lambda x: x["o_text"]), ", "))
    first = (F.col("p") != RDF_TYPE).cast("int")
    pairs = objects.select("s", F.struct(first.alias("rank"), "p_key", pair.alias("pair")).alias("x"))
    return pairs.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["pair"]), " ;\n    ").alias("text"))


def blocks(triples: DataFrame, namespaces: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(s, quoted, sort_key, block): one block of text for each subject that is not written in place."""
    show = _render_udf(tuple(namespaces))
    rows = triples.select("s", "p", "o").dropna().distinct()
    verb = F.when(F.col("p") == RDF_TYPE, "a").otherwise(show("p"))
    rows = stored(rows.select("s", "p", "o", verb.alias("p_text"), show("o").alias("o_text")), "statements")
    is_blank: Column = F.col("o").startswith("_:")
    quoted = rows.select(F.explode(F.array("s", "o")).alias("key")).where("key LIKE '<<%'").select(F.explode(F.regexp_extract_all("key", F.lit(r"(_:\S+)"), 1)).alias("o")).distinct()
    once = rows.where(is_blank).groupBy("o").agg(F.count("*").alias("n")).where("n = 1").select("o").join(quoted, "o", "left_anti")
    open_ = stored(once, "once")
    while not open_.isEmpty():
        waits = rows.join(open_, "o", "left_semi").select("s").distinct()  # has an object that is not written yet
        ready = open_.select(F.col("o").alias("s")).join(waits, "s", "left_anti")
        if ready.isEmpty():
            break
        texts = ready.join(_lists(rows.join(ready, "s", "left_semi")), "s", "left")
        texts = stored(texts.select(F.col("s").alias("o"), F.coalesce(F.concat(F.lit("[ "), F.col("text"), F.lit(" ]")), F.lit("[]")).alias("inner")), "inner")
        rows = rows.join(texts.select(F.col("o").alias("s")), "s", "left_anti").join(texts, "o", "left")
        rows = stored(rows.select("s", "p", "o", "p_text", F.coalesce("inner", "o_text").alias("o_text")), "statements")
        open_ = stored(open_.join(texts.select("o"), "o", "left_anti"), "once")
    made = _lists(rows)
    return made.select("s", F.col("s").startswith("<<").alias("quoted"), sort_key_udf(F.col("s")).alias("sort_key"), F.concat(show("s"), F.lit(" "), F.col("text"), F.lit(" .\n")).alias("block"))


def header(namespaces: Sequence[tuple[str, str]]) -> str:
    return "".join(f"@prefix {p}: <{i}> .\n" for p, i in namespaces) + ("\n" if namespaces else "")


def serialise(triples: DataFrame, out: TextIO, namespaces: Sequence[tuple[str, str]] = ()) -> None:
    """One document; blocks are made in parallel and streamed through the driver in order."""
    out.write(header(namespaces))
    for row in blocks(triples, namespaces).orderBy("quoted", "sort_key").select("block").toLocalIterator():
        out.write(row["block"] + "\n")


def write(triples: DataFrame, path: str, namespaces: Sequence[tuple[str, str]] = ()) -> None:
    """Ordered part files of text; each is a document with the prefixes of ``namespaces``."""
    text = blocks(triples, namespaces).orderBy("quoted", "sort_key").select("block")
    head = header(namespaces)

    def run(batches):
        first = True
        for b in batches:
            if first and len(b):
                b = pd.DataFrame({"value": [head.rstrip("\n"), *b["block"]]}) if head else b.rename(columns={"block": "value"})
                first = False
            else:
                b = b.rename(columns={"block": "value"})
            yield b

    text.mapInPandas(run, "value string").write.text(path)


def dot(triples: DataFrame) -> DataFrame:
    """(part, line): Graphviz text; nodes are named by hashes of their terms, so no numbering is needed."""
    rows = triples.select("s", "p", "o").dropna().distinct()
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    name = lambda c: F.concat(F.lit("n"), F.sha2(F.col(c), 256))
    spark = rows.sparkSession
    nodes = rows.select(F.explode(F.array("s", "o")).alias("n")).distinct().select(F.lit(1).alias("part"), F.concat(name("n"), F.lit(" [label="), quote(F.col("n")), F.lit("]")).alias("line"))
    edges = rows.select(F.lit(2).alias("part"), F.concat(name("s"), F.lit(" -> "), name("o"), F.lit(" [label="), quote(F.col("p")), F.lit("]")).alias("line"))
    # The graph's attributes.
    head = ["digraph G {", '    rankdir = "TB"', "    newrank = true", "    K = 1.5", "    node [shape=box]"]
    count = rows.agg(F.lit(0).alias("part"), F.concat(F.lit("# "), F.count("*")).alias("line"))
    frame = spark.createDataFrame([*[(0, line) for line in head], (3, "}")], "part int, line string")
    return count.unionByName(frame).unionByName(nodes).unionByName(edges)
