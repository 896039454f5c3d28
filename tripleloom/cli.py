"""Command line: merge files (``cat``) or reason over them (``reason``) and write Turtle-star.

    python -m tripleloom.cli reason rules.mtt base.ttl -
"""

from __future__ import annotations

import argparse
import contextlib
import logging
import sys
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.reasoner import closure, provenance_triples
from .plans.rules import default_rules, parse
from .sources import serialise, turtle

logger = logging.getLogger("tripleloom")


def merge_namespaces(known: dict[str, str], new: dict[str, str]) -> None:
    """Add namespaces; of two definitions of a prefix the first is kept, with a warning."""
    for prefix, iri in new.items():
        if known.setdefault(prefix, iri) != iri:
            logger.warning("ignoring %s: <%s>; using <%s>", prefix, iri, known[prefix])


@contextlib.contextmanager
def timed(what: str):
    began = time.time()
    try:
        yield
    finally:
        logger.info("%s took %.3f seconds", what, time.time() - began)


@contextlib.contextmanager
def opened(name: str):
    """The named file, or standard output for ``-``."""
    if name == "-":
        yield sys.stdout
    else:
        with open(name, "w", encoding="utf-8") as f:
            yield f


@dataclass
class Result:
    """What a command made: the triples, and the namespaces to write them with."""

    triples: DataFrame
    namespaces: dict[str, str]

    def counted(self) -> str:
        return f"# Triples {self.triples.count()}"

    def text(self) -> DataFrame:
        """(text): what is printed, the document's prefixes, and a block for each subject."""
        names = list(self.namespaces.items())
        spark = self.triples.sparkSession
        head = spark.createDataFrame([(self.counted() + "\n",), (serialise.header(names),)], "text string")
        return head.unionByName(serialise.blocks(self.triples, names).select(F.col("block").alias("text")))


def sort_files(names: Sequence[str], with_rules: bool) -> tuple[list[str], list[str]]:
    """Data files and rule files among ``names``, in any order; a file of another kind ends the program."""
    data = [n for n in names if n.endswith(("ttl", "nt"))]
    rules = [n for n in names if n.endswith("mtt") and with_rules]
    for name in names:
        if name not in data and name not in rules:
            raise SystemExit(f"unknown file {name}")
    return data, rules


def run(spark: SparkSession, command: str, names: Sequence[str], namespaces: dict[str, str], data: Sequence[str] = (), provenance: bool = True) -> Result:
    """``cat`` or ``reason`` over the named files, and over ``data`` (paths or globs of Turtle documents)."""
    namespaces = dict(namespaces)
    with timed("parsing"):
        found, rule_files = sort_files(names, command == "reason")
        found, rules = [*found, *data], []
        for name in rule_files:
            with open(name, encoding="utf-8") as f:
                rules += parse(f.read(), f"{name}#")
        if found:
            for r in turtle.prefixes(spark, *found).orderBy("filename").collect():  # the documents' headers
                merge_namespaces(namespaces, {r["prefix"]: r["iri"]})
        triples = turtle.read(spark, *found).select("s", "p", "o").distinct() if found else spark.createDataFrame([], "s string, p string, o string")
    if command == "reason":
        with timed("reasoning"):
            done = closure(triples, [*default_rules(), *rules], provenance=provenance)
            triples = done.triples.select("s", "p", "o")
            if provenance:
                triples = triples.unionByName(provenance_triples(done.derivations)).distinct()
    return Result(triples, namespaces)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tripleloom")
    parser.add_argument("-l", "--log-file")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("cat", "reason"):
        command = commands.add_parser(name)
        command.add_argument("-n", "--namespace", nargs=2, action="append", default=[], metavar=("PREFIX", "IRI"))
        command.add_argument("filenames", nargs="*")
        command.add_argument("output")
        if name == "reason":
            command.add_argument("--no-provenance", action="store_true", help="write no statements about derivations")
    args = parser.parse_args(argv)
    if args.log_file:
        logging.basicConfig(filename=args.log_file, level=logging.DEBUG, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("tripleloom").getOrCreate()
    done = run(spark, args.command, args.filenames, dict(args.namespace), provenance=args.command == "reason" and not args.no_provenance)
    with timed("serialisation"), opened(args.output) as out:
        print(done.counted())
        serialise.serialise(done.triples, out, list(done.namespaces.items()))


if __name__ == "__main__":
    main()
