import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from line_scanner import judge

from tripleloom.sources.lines import REASONS, index_lines, judge_batch, rejects, valid_triples, valid_typed

XSD = "http://www.w3.org/2001/XMLSchema#"
CASES = [
    ('<a> <b> "c" .', None), ('<a>\t<b>  "c"@en-GB.  # ok .', None), ("_:x a p:y.", None), ("<a> <b> -1.5e3 .\r", None), ('<< <a> <b> "x >>" >> <c> << _:x <p> << <a> <b> 1 >> >> .', None),
    ('<a> <b> "say \\"no\\" # < >"^^<t> .', None), ("<a><b><c>.", None), ("<a> <b> <c> . # see \"notes", None), ('<a> <b> "caf\\u00E9" .', None), ("<a#x> <b> 42 .", None),
    ('<a> <b> "c .', "quoting"), ("<a <b> <c> .", "quoting"), ("<a> b> <c> .", "quoting"), ('<a> <b> "the "old" gate" .', "quoting"), ("<< <a> <b> <c> <d> <e> .", "quoting"), ("<a> <b> <c> >> .", "quoting"),
    ('<a> <b> "c\\" .', "quoting"), ("<a> <b> <c", "quoting"), ('<a> <b> "c"d .', "quoting"), ('<a> <b> <c> . "x', "quoting"),
    ("<a> <b> .", "columns"), ("<a> <b> <c> <d> .", "columns"), ("<a> <b> <c>", "columns"), (".", "columns"), ("<a> <b> <c> . <d> <e> <f> .", "columns"), ("<< <a> <b> >> <c> <d> .", "columns"), ("<a> <b> <c> # x .", "columns"),
    ("<a> <b> <c> ..", "columns"), ("<< <a> <b> <c> . >> <d> <e> .", "columns"), ("@prefix x <http://x> .", "value"),
    ('"a" <b> <c> .', "value"), ("<a> _:b <c> .", "value"), ("<a> <b> 12x .", "value"), ("<a> <b c> <d> .", "value"), ('<a> <b> "x"@12 .', "value"), ('<a> <b> "x"@ .', "value"), ('<a> <b> "x\\q" .', "value"),
    (f'<a> <b> "1.5"^^<{XSD}integer> .', "value"), (f'<a> <b> "2023-02-29"^^<{XSD}date> .', "value"), ("<a> <b> a .", "value"), ("5 <b> <c> .", "value"), ("<a> << <a> <b> <c> >> <c> .", "value"), ("<a> <b> true .", "value"),
]


def by_index(lines, name="x.nt", prefixes=None):
    """(reason, triple) of each line, as the index has it."""
    codes, rows_, keys = judge_batch(pa.array(lines, pa.string()), pa.array([name] * len(lines), pa.string()), [prefixes or {}] * len(lines))
    found = dict(zip(rows_.tolist(), zip(*keys)))
    return [(REASONS[c] or None, found.get(i)) for i, c in enumerate(codes)]


@pytest.mark.parametrize("line,reason", CASES)
def test_reasons(line, reason):
    got, triple = judge(line, "x.nt")
    assert got == reason and (triple is None) == (reason is not None)
    assert by_index([line]) == [(got, triple)]


def test_index_and_scanner_agree_on_all_cases_at_once():
    lines = [line for line, _ in CASES] + ["", None, "# x", "@prefix p: <http://x/> .", "  \t\r"]
    assert by_index(lines) == [judge(line, "x.nt") for line in lines]
    assert by_index(lines, "x.rdf") == [judge(line, "x.rdf") for line in lines] and by_index(lines, None) == [judge(line, None) for line in lines]
    assert by_index([], "x.nt") == []
    names = {"p": "http://p/", "": "http://e/"}
    odd = ['p:a\\,b :c "x" .', "<< p:s p:p << :a :b :c >> >> a p:T .", "p:s a q:T .", 'p:s p:p "\\u0041\\n"@en .']
    assert by_index(odd, prefixes=names) == [judge(line, "x.nt", names) for line in odd]


def test_lines_that_are_neither():
    for line in ("", "  \t\r", None, "# x", "\t# \"x", "@prefix p: <http://x/> .", "PREFIX p: <http://x/>", "@base <http://x/> ."):
        assert judge(line, "x.ttl") == (None, None)
    assert judge("<a> <b> <c> .", "x.nt~") == ("file", None)
    assert judge("@prefix p: <http://x/> .", "x.rdf") == ("file", None)
    assert judge("# x", None) == (None, None) and judge("x", None) == ("file", None)


def test_typed():
    good = {"integer": ["+5", "-0"], "decimal": ["1", ".5", "1.", "-1.5"], "boolean": ["true", "0"], "date": ["2024-02-29", "2000-01-01Z", "-0044-03-15", "12024-02-29+05:00"], "gYear": ["1964", "-0044", "2000Z"]}
    bad = {"integer": ["1,2", ""], "decimal": ["1e1", "."], "boolean": ["True", "2"], "date": ["2023-02-29", "04/05/1990", "2024-2-9"], "gYear": ["19x4", "64"]}
    for table, want in ((good, True), (bad, False)):
        for kind, texts in table.items():
            assert all(valid_typed(t, XSD + kind) is want for t in texts), kind
    assert valid_typed("anything", XSD + "dateTime")


PARTS = ["<a>", "<b>", "p:x", "_:l", '"s"', '"', "\\", "<", ">", "<<", ">>", ".", " ", "\t", "#", "@en", "^^", "a", "5", "é", "\r", "\\u00e9", "^^<", "@", ":", "_:", "²", "e5", "-", "%41", f'"5"^^<{XSD}integer>', ' "x" ', " . ", "<a> <b> <c> ."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=25))
def test_index_is_the_scanner(lines):
    """Every reason, and every valid triple, is that of the plain scanner."""
    assert by_index(lines, prefixes={"p": "http://p/"}) == [judge(line, "x.nt", {"p": "http://p/"}) for line in lines]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=20))
def test_what_the_index_accepts_is_valid(lines):
    """Soundness: no line is accepted that the exact scanner rejects, and the terms are the same."""
    accepted, terms = index_lines(pa.array(lines, pa.string()))
    for k, i in enumerate(accepted):
        reason, triple = judge(lines[i], "x.nt")
        assert reason is None and triple is not None, lines[i]
        assert terms[0][k].as_py() == triple[0] and terms[2][k].as_py().split('"^^')[0].strip('"') == triple[2].split('"^^')[0].strip('"')


def test_index_accepts_plain_lines():
    lines = [line for line, reason in CASES if reason is None and "<<" not in line and "><" not in line and "\\u" not in line]
    assert len(index_lines(pa.array(lines))[0]) == len(lines)


def test_tables(spark):
    data = [
        (1, "a.ttl", 1, "@prefix p: <http://p/> ."), (2, "a.ttl", 2, 'p:s a p:T . # "'), (3, "a.ttl", 3, '<x> q:y "s"^^<http://www.w3.org/2001/XMLSchema#string> .'), (4, "b.nt", 1, "p:s <p> <o> ."),
        (5, "b.nt", 2, "<s> <p> ."), (6, "c.NT", 1, "<s> <p> <o> ."), (7, "c.NT", 2, ""), (8, None, 1, "<s> <p> <o> ."), (9, "b.nt", 3, None), (10, "a.ttl", 9, "<< p:a p:b p:c >> <p> _:n ."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data], "line_id bigint, filename string, line_no int, line string, reason string")
    assert rows(rejects(df)) == sorted([(5, "columns"), (6, "file"), (8, "file")], key=repr)
    assert rows(valid_triples(df)) == sorted([
        (2, "<http://p/s>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://p/T>"), (3, "<x>", "q:y", '"s"'), (4, "p:s", "<p>", "<o>"), (10, "<< <http://p/a> <http://p/b> <http://p/c> >>", "<p>", "_:n"),
    ], key=repr)
    empty = df.where("line_id < 0")
    assert rejects(empty).count() == 0 and valid_triples(empty).count() == 0


def test_very_long_lines():
    long = "<a> <b> \"" + "x" * 300_000 + "\" ."
    assert len(index_lines(pa.array([long, "<a> <b> <c> ."]))[0]) == 2
    assert by_index([long[:-3], long, "<a> " * 50_000 + ".", "<<" * 40_000 + ">>" * 40_000]) == [("quoting", None), judge(long, "x.nt"), ("columns", None), ("columns", None)]


def test_index_is_the_scanner_on_the_tables():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/file_lines.parquet")
    lines, names = table["line"].to_pylist(), table["filename"].to_pylist()
    codes, rows_, keys = judge_batch(pa.array(lines, pa.string()), pa.array(names, pa.string()), [{}] * len(lines))
    found = dict(zip(rows_.tolist(), zip(*keys)))
    assert [(REASONS[c] or None, found.get(i)) for i, c in enumerate(codes)] == [judge(line, name) for line, name in zip(lines, names)]
    assert len(set(codes.tolist())) == 5
