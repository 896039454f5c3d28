import io
import textwrap

import pytest
from conftest import rows

from tripleloom import cli
from tripleloom.plans.reasoner import closure
from tripleloom.plans.rules import default_rules, parse as parse_rules
from tripleloom.sources import serialise, turtle
from tripleloom.sources.turtle import TurtleError, parse

FOAF = "http://xmlns.com/foaf/0.1/"
XSD = "http://www.w3.org/2001/XMLSchema#"


def got(text, **kw):
    return parse(text, **kw).triples


def test_lists_prefixes_and_a():
    doc = parse('@prefix : <http://e/> . PREFIX f: <http://f/>\n# no\n:s a f:T ; f:p :o1, :o2 ;; f:q "x" . @prefix : <http://g/> . :s f:p :ó .')
    assert doc.triples == [
        ("<http://e/s>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://f/T>"), ("<http://e/s>", "<http://f/p>", "<http://e/o1>"), ("<http://e/s>", "<http://f/p>", "<http://e/o2>"),
        ("<http://e/s>", "<http://f/q>", '"x"'), ("<http://g/s>", "<http://f/p>", "<http://g/ó>"),
    ]
    assert doc.prefixes == {"": "http://g/", "f": "http://f/"}


def test_literals():
    text = f"""<s> <p> "1964"^^<{XSD}gYear>, "x"^^<{XSD}string>, 'That Seventies "Show"', '''multi
line''', "Cette"@fr-be, \"\"\"a "quoted" b\"\"\", "caf\\u00E9\\n", 2, 4.002602, 1.663E-4, -5, true, false, "" ."""
    assert [t[2] for t in got(text)] == [
        f'"1964"^^<{XSD}gYear>', '"x"', '"That Seventies \\"Show\\""', '"multi\\nline"', '"Cette"@fr-be', '"a \\"quoted\\" b"', '"café\\n"', "2", "4.002602", "1.663E-4", "-5",
        f'"true"^^<{XSD}boolean>', f'"false"^^<{XSD}boolean>', '""',
    ]


def test_blank_nodes():
    assert got(f'[] <{FOAF}knows> [ <{FOAF}name> "Bob" ] .') == [("_:doc/1", f"<{FOAF}name>", '"Bob"'), ("_:doc/0", f"<{FOAF}knows>", "_:doc/1")]
    assert got('_:a <p> _:b . _:b <p> _:a . [ <p> "x" ] .') == [("_:doc/0", "<p>", "_:doc/1"), ("_:doc/1", "<p>", "_:doc/0"), ("_:doc/2", "<p>", '"x"')]


def test_collections_and_base():
    triples = got("@base <http://e/x/> . <s> <p> (1 <o>), () .")
    assert len(triples) == 6 and triples[-1][2].endswith("nil>") and ("<http://e/x/s>" == triples[-1][0])
    assert got("<s> <p> <o> .", base="http://b/")[0] == ("<http://b/s>", "<http://b/p>", "<http://b/o>")


def test_quoted_triples():
    doc = got("@prefix : <http://e/> . :bob :name \"Bob\" . <<:bob :age 23>> :by <c> ; :src << <<:a :b :c>> :d \"e >>\" >> .")
    assert ("<http://e/bob>", "<http://e/age>", "23") in doc
    assert doc[2] == ("<< <http://e/bob> <http://e/age> 23 >>", "<http://e/by>", "<c>")
    assert doc[-1][2] == '<< << <http://e/a> <http://e/b> <http://e/c> >> <http://e/d> "e >>" >>'


@pytest.mark.parametrize("text", ["<s> <p> .", "<s> <p> <o>", "x:s <p> <o> .", '"s" <p> <o> .', "<s> <p> <o> ; ; , .", "<< <s> <p> <o> <q> <o> .", "<s> 5 <o> .", "<s> <p> [ .", "<s <p> <o> ."])
def test_bad_documents(text):
    with pytest.raises(TurtleError):
        parse(text)


def test_golden_text(spark):
    doc = parse('@prefix : <http://example.org/> . @prefix foaf: <http://xmlns.com/foaf/0.1/> . @prefix dct: <http://purl.org/dc/elements/1.1/> .\n:bob foaf:name "Bob" . <<:bob foaf:age 23>> dct:creator <http://example.com/crawlers#c1> ; dct:source <http://example.net/homepage-listing.html> .')
    out = io.StringIO()
    serialise.serialise(spark.createDataFrame(doc.triples, "s string, p string, o string"), out, list(doc.prefixes.items()))
    assert out.getvalue() == textwrap.dedent(
        """\
        @prefix : <http://example.org/> .
        @prefix foaf: <http://xmlns.com/foaf/0.1/> .
        @prefix dct: <http://purl.org/dc/elements/1.1/> .

        :bob foaf:age 23 ;
            foaf:name "Bob" .

        << :bob foaf:age 23 >> dct:creator <http://example.com/crawlers#c1> ;
            dct:source <http://example.net/homepage-listing.html> .

        """
    )


def shape(triples):
    """Triples with blank nodes named by what is said of them; enough for trees."""
    def name(t, depth=4):
        if not t.startswith("_:"):
            return t
        return "[" + ",".join(sorted(f"{p} {name(o, depth - 1)}" for s, p, o in triples if s == t)) + "]" if depth else "[]"

    return sorted((name(s), p, name(o)) for s, p, o in triples)


def test_round_trip(spark):
    text = """@prefix e: <http://e/> . e:me a e:Person ; e:spouse [ e:name "L\\n\\"q\\"" ; e:child [ e:name "x"@en ], [] ] ; e:n 1.50, 1e3, "y"^^e:t ; e:shared _:s .
    e:you e:shared _:s . _:s e:name "shared" . _:l e:next _:m . _:m e:next _:l . << e:me e:age 5 >> e:by _:q . <http://e/odd path> e:p <http://e/a/b> ."""
    text = text.replace("<http://e/odd path>", "<http://e/odd;path>")
    first = parse(text).triples
    out = io.StringIO()
    serialise.serialise(spark.createDataFrame(first, "s string, p string, o string"), out, [("e", "http://e/")])
    assert shape(set(parse(out.getvalue()).triples)) == shape(set(first))
    assert '[ e:child [ e:name "x"@en ], []' in out.getvalue() or "[ e:child [], [ e:name" in out.getvalue()
    again = io.StringIO()
    serialise.serialise(spark.createDataFrame([], "s string, p string, o string"), again)
    assert again.getvalue() == ""


def test_dot(spark):
    lines = [r["line"] for r in serialise.dot(spark.createDataFrame([("<a>", "<p>", '"x"')], "s string, p string, o string")).orderBy("part").collect()]
    assert sorted(lines[:6]) == sorted(["# 1", "digraph G {", '    rankdir = "TB"', "    newrank = true", "    K = 1.5", "    node [shape=box]"])
    assert lines[-1] == "}" and len(lines) == 10 and '\\"x\\"' in "".join(lines)


def test_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix e: <http://e/> . e:s e:p [ e:q 1 ] .")
    (tmp_path / "b.ttl").write_text("@prefix e: <http://f/> . e:s e:p [] .")
    assert rows(turtle.read(spark, str(tmp_path)).select("s", "o")) == [("<http://e/s>", "_:a.ttl/0"), ("<http://f/s>", "_:b.ttl/0"), ("_:a.ttl/0", "1")]
    (tmp_path / "c.nt").write_text('<s> <p> "a\\u00E9" .\n<s> <p> .\n# c\n_:x <p> << _:x <p> <o> >> .\n')
    good, bad = turtle.ntriples(spark, str(tmp_path / "c.nt"))
    assert rows(good) == [("<s>", "<p>", '"aé"'), ("_:c.nt/x", "<p>", "<< _:c.nt/x <p> <o> >>")]
    assert rows(bad) == [("c.nt", "<s> <p> .", "columns")]


PIECES = """@prefix e: <http://e/> . # "no
e:a e:p \"\"\"x "y"

z\"\"\", '''''', "" ; e:q [ e:r 1
] .

e:b e:p _:l . @prefix e: <http://f/> .
_:l e:p "1\\
2" , _:m . <<
e:c e:p _:m >> e:q ( "3"@en
4 ) .
"""


def test_documents_in_pieces(monkeypatch):
    """Any cut at line ends gives the same triples; a string may go on in later pieces."""
    whole, lines = parse(PIECES), PIECES.splitlines(keepends=True)
    assert len(whole.triples) == 14 and whole.prefixes == {"e": "http://f/"}
    for tokens, characters in ((turtle.TOKENS, turtle.CHARACTERS), (2, 1)):
        monkeypatch.setattr(turtle, "TOKENS", tokens)
        monkeypatch.setattr(turtle, "CHARACTERS", characters)
        for size in range(1, len(lines) + 1):
            doc = turtle.Document("".join(lines[i : i + size]) for i in range(0, len(lines), size))
            assert [t for part in doc.parts() for t in part] == whole.triples and doc.prefixes == whole.prefixes
    with pytest.raises(TurtleError, match="line 3: unexpected"):
        list(turtle.Document(["<s> <p>\n", "# c\n", '"o .\n', "<s> <p> <o> .\n"]).parts())
    assert sum(turtle.Document(["\n# c\n"] * 9 + ["<s> <p> 1 ."]).parts(), []) == [("<s>", "<p>", "1")]


def test_documents_of_any_size(monkeypatch):
    """Triples leave before the rest is read, also those of one long statement; little is held."""
    monkeypatch.setattr(turtle, "TOKENS", 100)
    for start, line in (("", "<s> <p> <o{0}>, {0} .\n"), ("<s> <p> <o>\n", ", <o{0}>; <p> {0}\n")):
        taken = 0

        def pieces():
            nonlocal taken
            yield start
            for taken in range(10_000):
                yield line.format(taken)
            yield "" if line.endswith(".\n") else "."

        found = 0
        for part in turtle.Document(pieces()).parts():
            found += len(part)
            assert len(part) <= 100 and 2 * taken - found <= 200
        assert found == 20_000 + bool(start)


def test_files_are_not_read_as_a_whole(spark, tmp_path):
    """Rows come before the end is read, which is shown by an error there."""
    (tmp_path / "a.ttl").write_text("".join(f"<s> <p> {i} .\n" for i in range(40_000)) + "<s> <p> .\n")
    made = turtle.read(spark, str(tmp_path)).select("s", "p", "o")
    assert [tuple(r) for r in made.take(1)] == [("<s>", "<p>", "0")]
    with pytest.raises(Exception, match="TurtleError"):
        made.collect()


def test_files_named_twice(spark, tmp_path):
    """Each reading of a file gives the same blank nodes."""
    (tmp_path / "a.ttl").write_text("<s> <p> [ <q> 1 ] .\n")
    (tmp_path / "b.ttl").write_text("<s> <p> 3 .\n")
    made = turtle.read(spark, str(tmp_path), f"{tmp_path}/b.ttl", f"{tmp_path}/a*").select("filename", "s", "o")
    assert rows(made) == 2 * [("a.ttl", "<s>", "_:a.ttl/0")] + 2 * [("a.ttl", "_:a.ttl/0", "1")] + 2 * [("b.ttl", "<s>", "3")]


def test_files_in_several_splits(spark, tmp_path):
    """A file is read by many tasks and parsed by one, its lines in order; names may need quoting in a URI."""
    rest = "".join(f'e:s{i} e:p _:b{i % 7}, """{i}\n# " \r\n""" .\n' + f"@prefix e: <http://e{i}/> .\n" * (i % 50 == 0) for i in range(400))
    texts = {"a b.ttl": "\ufeff@prefix e: <http://e/> .\n" + rest, "ü%20#.ttl": "PREFIX e: <http://f/>\n" + rest[:-1], "none.ttl": "", "one.ttl": "<s> <p> 1 ."}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        made, heads = turtle.read(spark, str(tmp_path)).collect(), turtle.prefixes(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    quoted = {name: name.replace("%", "%25").replace(" ", "%20").replace("#", "%23") for name in texts}  # as Spark names files
    want = {quoted[name]: parse(text, quoted[name]) for name, text in texts.items()}
    for name, doc in want.items():
        assert [tuple(r)[1:] for r in made if r["filename"] == name] == doc.triples
        assert {r["prefix"]: r["iri"] for r in heads if r["filename"] == name} == doc.prefixes
    assert {r["filename"] for r in made} == {n for n in want if want[n].triples}


SIMPLE = """
@prefix s: <https://schema.org/> . @prefix e: <https://example.org/> .
e:ann s:name "Ann" . e:bob s:name "Bob" .
e:cat s:name "Cat" ; s:parent e:ann, e:bob . e:dan s:name "Dan" ; s:parent e:ann, e:bob .
"""
SIBLING = "@prefix s: <https://schema.org/> .\n($a s:parent $p), ($b s:parent $p) st ($a is-not $b) → ($a s:sibling $b) ."


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "base.ttl").write_text(SIMPLE)
    (tmp_path / "rules.mtt").write_text(SIBLING)
    out = tmp_path / "out.ttl"
    cli.main(["reason", "--no-provenance", str(tmp_path / "base.ttl"), str(tmp_path / "rules.mtt"), str(out)])
    assert "# Triples 10" in capsys.readouterr().out
    text = out.read_text()
    assert "e:cat s:name \"Cat\" ;\n    s:parent e:ann, e:bob ;\n    s:sibling e:dan .\n" in text
    cli.main(["cat", "-n", "e", "http://other/", str(out), "-"])
    printed = capsys.readouterr().out
    assert "@prefix e: <http://other/> ." in printed and "<https://example.org/cat>" in printed
    with pytest.raises(SystemExit):
        cli.main(["cat", "x.csv", "-"])


def test_family_of_our_own(spark):
    """Domain, range, symmetry, an inverse and a rule with an inequality over three generations."""
    facts = """
    @prefix s: <http://s/> . @prefix e: <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
    e:ida s:has e:jon, e:kim . e:jon s:has e:lea, e:max, e:nia . e:kim s:mate e:ole . e:ida s:named "Ida" .
    s:has owl:inverseOf s:of . s:mate a owl:SymmetricProperty . s:mate rdfs:domain s:Human . s:has rdfs:range s:Human . s:peer a owl:SymmetricProperty .
    """
    rule = parse_rules("($a <http://s/of> $p), ($b <http://s/of> $p) st ($a is-not $b) -> ($a <http://s/peer> $b) .")
    done = closure(spark.createDataFrame(parse(facts).triples, "s string, p string, o string"), [*default_rules(), *rule])
    by = {r["p"].rpartition("/")[2].rpartition("#")[2][:-1]: r["count"] for r in done.triples.groupBy("p").count().collect()}
    # five children: 5 links each way; peers 2 + 6; mates both ways; humans: 5 children and the two mates, one of them a child
    assert by == {"has": 5, "of": 5, "peer": 8, "mate": 2, "named": 1, "type": 2 + 6, "inverseOf": 2, "domain": 1, "range": 1}
