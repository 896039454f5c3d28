r"""Turtle-star and N-Triples-star documents to triples of canonical keys.

Turtle keeps state over a whole document (prefixes, base, blank nodes), so one document is parsed by one task;
documents are parsed in parallel.  A document is never held as a whole: its lines come in order, sorted by Spark, and
its triples leave as they are found; what grows is one number for each label of a blank node.
N-Triples files are read by lines (``ntriples``), in parallel within a file.

Blank nodes get keys ``_:scope/n`` in order of appearance; the scope is the document.  A quoted triple is also asserted.
``true`` and ``false`` are typed literals, ``( … )`` is an rdf list, ``"x"^^xsd:string`` is ``"x"``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import escape, unescape
from ..functions.terms import RDF, RDF_TYPE, XSD, XSD_STRING
from ..runtime import partitions, small_table

#: A parser holds at most so many tokens, of so many characters of text (and the token that goes beyond them).
TOKENS, CHARACTERS = 50_000, 1 << 20


class TurtleError(ValueError):
    pass


_NAME_CHAR = r"\w·\u0300-\u036f\u203f\u2040\-"
_LOCAL = rf"(?:[{_NAME_CHAR}:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'\"()*+,;=/?\#@%])"
_TOKEN = re.compile(
    rf"""[ \t\f\r\n]+|\#[^\n\r]*
    |(?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
    |(?P<open><<)|(?P<close>>>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b)|(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<typed>\^\^)
    |(?P<blank>_:[\w](?:[{_NAME_CHAR}.]*[{_NAME_CHAR}])?)
    |(?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)
    |(?P<name>(?:[^\W\d_](?:[{_NAME_CHAR}.]*[{_NAME_CHAR}])?)?:(?:{_LOCAL}(?:(?:{_LOCAL}|\.)*{_LOCAL})?)?)
    |(?P<word>[A-Za-z]+)|(?P<punct>[.;,\[\]()])""",
    re.X | re.S,
)


class Document:
    """A document whose text comes in pieces that end with lines.

    ``steps`` parses it; ``triples`` (in order of appearance, repeats kept) and ``prefixes`` are those found so far.
    """

    def __init__(self, pieces: Iterable[str], scope: str = "doc", base: str = ""):
        self.pieces = iter(pieces)
        self.text = next(self.pieces, "")
        self.place, self.line = int(self.text.startswith("\ufeff")), 1
        self.tokens: list[tuple[str, str]] = []
        self.at, self.fills, self.scope, self.base, self.minted = 0, 0, scope, base, 0
        self.prefixes: dict[str, str] = {}
        self.labels: dict[str, str] = {}
        self.triples: list[tuple[str, str, str]] = []

    def steps(self) -> Iterator[None]:
        """Parses to the end; at each step the triples found so far may be taken away."""
        while self._peek()[0] != "end":
            yield from self._statement()

    def parts(self) -> Iterator[list[tuple[str, str, str]]]:
        """The triples, in parts of about as many as the held tokens give."""
        fills = 0
        for _ in self.steps():
            if self.fills > fills:
                fills = self.fills
                yield self.triples
                self.triples = []
        yield self.triples

    def _fill(self) -> bool:
        """Holds the next tokens instead of those used up; false at the end."""
        text, i, tokens, most = self.text, self.place, [], self.place + CHARACTERS
        while not tokens or len(tokens) < TOKENS and i < most:
            if i >= len(text):
                self.line += text.count("\n")
                text, i, most = next(self.pieces, None), 0, most - i
                if text is None:
                    text = ""
                    break
                continue
            m = _TOKEN.match(text, i)
            if (not m or m.end() == i + 2) and self._goes_on(text, i, m):
                if more := self._more(len(text) - i):
                    self.line += text.count("\n", 0, i)
                    text, i, most = text[i:] + more, 0, most - i
                    continue
            if not m:
                raise TurtleError(f"line {self.line + text.count(chr(10), 0, i)}: unexpected {text[i : i + 30]!r}")
            if m.lastgroup:
                tokens.append((m.lastgroup, m[0]))
            i = m.end()
        self.text, self.place, self.tokens, self.at, self.fills = text, i, tokens, 0, self.fills + 1
        return bool(tokens)

    @staticmethod
    def _goes_on(text: str, i: int, m: re.Match | None) -> bool:
        """Whether a string begins here that may end in a later piece: a long one, or one with an escaped line end."""
        return text.startswith(('"""', "'''"), i) or not m and text[i] in "\"'" and text.endswith("\\\n")

    def _more(self, size: int) -> str:
        """Pieces of ``size`` characters at least, if there are as many."""
        found = []
        while size > 0 and (piece := next(self.pieces, None)) is not None:
            found.append(piece)
            size -= len(piece)
        return "".join(found)

    def _peek(self) -> tuple[str, str]:
        while self.at >= len(self.tokens):
            if not self._fill():
                return "end", ""
        return self.tokens[self.at]

    def _next(self) -> tuple[str, str]:
        token = self._peek()
        self.at += 1
        return token

    def _take(self, text: str) -> None:
        token = self._next()
        if token != ("punct", text):
            raise TurtleError(f"expected {text!r}, got {token[1]!r}")

    def _is(self, text: str) -> bool:
        return self._peek() == ("punct", text)

    def _mint(self) -> str:
        self.minted += 1
        return f"_:{self.scope}/{self.minted - 1}"

    def _statement(self) -> Iterator[None]:
        kind, text = self._peek()
        word = text.lower()
        if kind == "directive" or kind == "word" and word in ("prefix", "base"):
            self.at += 1
            if word.endswith("prefix"):
                name = self._next()
                if name[0] != "name" or not name[1].endswith(":"):
                    raise TurtleError(f"bad prefix {name[1]!r}")
                self.prefixes[name[1][:-1]] = self._iri(self._next())[1:-1]
            else:
                self.base = self._iri(self._next())[1:-1]
            if kind == "directive":
                self._take(".")
            return
        if self._is("["):
            subject, filled = self._brackets()
            if not (filled and self._is(".")):
                yield from self._properties(subject)
        else:
            yield from self._properties(self._term(0))
        self._take(".")

    def _properties(self, subject: str) -> Iterator[None]:
        while True:
            kind, text = self._peek()
            if (kind, text) == ("word", "a"):
                self.at += 1
                predicate = RDF_TYPE
            elif kind in ("iri", "name"):
                predicate = self._iri(self._next())
            else:
                raise TurtleError(f"expected a predicate, got {text!r}")
            self.triples.append((subject, predicate, self._term(2)))
            yield
            while self._is(","):
                self.at += 1
                self.triples.append((subject, predicate, self._term(2)))
                yield
            if not self._is(";"):
                return
            while self._is(";"):
                self.at += 1
            if self._is(".") or self._is("]"):
                return

    def _brackets(self) -> tuple[str, bool]:
        """A node of ``[]`` or ``[ p o ; … ]``, and whether it has properties."""
        self._take("[")
        node, filled = self._mint(), not self._is("]")
        if filled:
            for _ in self._properties(node):
                pass
        self._take("]")
        return node, filled

    def _iri(self, token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "iri":
            value = unescape(text[1:-1])
            if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value):
                value = urljoin(self.base, value)
            return f"<{value}>"
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        raise TurtleError(f"expected an IRI, got {text!r}")

    def _term(self, place: int) -> str:
        kind, text = self._peek()
        if kind in ("iri", "name"):
            return self._iri(self._next())
        if (kind, text) == ("punct", "["):
            return self._brackets()[0]
        self.at += 1
        if kind == "blank":
            if text not in self.labels:
                self.labels[text] = self._mint()
            return self.labels[text]
        if kind == "open":
            s, p, o = self._term(0), self._iri(self._next()), self._term(2)
            if self._next()[0] != "close":
                raise TurtleError("quoted triple not closed")
            self.triples.append((s, p, o))
            return f"<< {s} {p} {o} >>"
        if (kind, text) == ("punct", "("):
            items = []
            while not self._is(")"):
                items.append(self._term(2))
            self._take(")")
            nodes = [self._mint() for _ in items]
            for k, (node, item) in enumerate(zip(nodes, items)):
                self.triples.append((node, f"<{RDF}first>", item))
                self.triples.append((node, f"<{RDF}rest>", nodes[k + 1] if k + 1 < len(nodes) else f"<{RDF}nil>"))
            return nodes[0] if nodes else f"<{RDF}nil>"
        if place == 2:
            if kind in ("string", "long"):
                quotes = 3 if kind == "long" else 1
                body = f'"{escape(unescape(text[quotes:-quotes]))}"'
                after = self._peek()
                if after[0] == "tag":
                    return body + self._next()[1]
                if after[0] == "typed":
                    self.at += 1
                    datatype = self._iri(self._next())
                    return body if datatype == XSD_STRING else f"{body}^^{datatype}"
                return body
            if kind in ("integer", "decimal", "double"):
                return text
            if kind == "word" and text in ("true", "false"):
                return f'"{text}"^^<{XSD}boolean>'
        raise TurtleError(f"expected a term, got {text!r}")


def parse(text: str, scope: str = "doc", base: str = "") -> Document:
    document = Document([text], scope, base)
    for _ in document.steps():
        pass
    return document


def _lines(spark: SparkSession, paths: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(file, value): the lines of files by number, all of a file in order in one partition; and the files' names.

    A file that several paths name is read for each of them.
    """
    text = spark.read.option("lineSep", "\n").text
    rounds: list[tuple[list[str], set[str]]] = [([], set())]  # paths without a file in common, and their files
    for path in paths:
        own = set(text(path).inputFiles())
        for r in rounds:
            if not r[1] & own:
                r[0].append(path)
                r[1].update(own)
                break
        else:
            rounds.append(([path], own))
    made, names = [], []
    for each, own in rounds:
        files = sorted(own)
        numbers = small_table(spark, {"path": files, "number": list(range(len(names), len(names) + len(files)))}, {"path": pa.string(), "number": pa.int32()})
        lines = text(each).select("value", F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        known = F.coalesce("number", F.raise_error(F.concat(F.lit("unlisted file "), "path")).cast("int"))
        made.append(lines.join(F.broadcast(numbers), "path", "left").select(known.alias("file"), "block", "line", "value"))
        names += [f.rpartition("/")[2] for f in files]
    tasks = max(1, min(len(names), partitions(spark)))
    placed = reduce(DataFrame.unionByName, made).repartitionById(tasks, F.col("file") % tasks).sortWithinPartitions("file", "block", "line")
    return placed.select("file", "value"), names


def _documents(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[str, Document]]:
    """(filename, document) of the lines of files that follow each other."""

    def pieces() -> Iterator[tuple[int, str]]:
        for b in batches:
            files, values = b.column("file").to_numpy(), b.column("value").to_pylist()
            ends = [*(np.flatnonzero(np.diff(files)) + 1), len(files)] if len(files) else []
            for start, end in zip([0, *ends], ends):
                yield int(files[start]), "\n".join(values[start:end]) + "\n"

    for file, own in groupby(pieces(), lambda x: x[0]):
        yield names[file], Document((text for _, text in own), names[file])


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(filename, s, p, o) of Turtle files; a file's blank nodes have its name as scope."""
    lines, names = _lines(spark, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, document in _documents(batches, names):
            for part in document.parts():
                columns = zip(*part) if part else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([name] * len(part), *columns)], ["filename", "s", "p", "o"])

    return lines.mapInArrow(run, "filename string, s string, p string, o string")


def prefixes(spark: SparkSession, *paths: str) -> DataFrame:
    """(filename, prefix, iri): the prefixes that each Turtle file declares."""
    lines, names = _lines(spark, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, document in _documents(batches, names):
            for _ in document.parts():
                pass
            found = document.prefixes
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([name] * len(found), found.keys(), found.values())], ["filename", "prefix", "iri"])

    return lines.mapInArrow(run, "filename string, prefix string, iri string")


def ntriples(spark: SparkSession, *paths: str, named: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(s, p, o) and rejects (filename, line, reason) of N-Triples-star files, read by lines.

    ``named`` stands for the file names, of part files of one document for example.
    """
    from . import lines

    text = spark.read.text(list(paths)).select(F.col("value").alias("line"), (F.lit(named) if named else F.col("_metadata.file_name")).alias("filename"), F.monotonically_increasing_id().alias("line_id"))
    found = lines.judge_lines(text.withColumn("line_no", F.col("line_id")))
    triples = found.where("reason IS NULL").select(*[_scoped(c) for c in ("s", "p", "o")])
    return triples, found.where("reason IS NOT NULL").select("filename", "line", "reason")


def _scoped(place: str):
    """Labels of blank nodes with their file as scope, also inside quoted triples."""
    label = F.regexp_replace(F.col(place), r"(^|<< | )_:", F.concat(F.lit("$1_:"), F.col("filename"), F.lit("/")))
    return F.when(F.col(place).startswith("_:") | F.col(place).startswith("<<"), label).otherwise(F.col(place)).alias(place)
