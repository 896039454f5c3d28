import random
import sys
from decimal import Decimal

from hypothesis import given
from hypothesis import strategies as st

from tripleloom.functions.literals import canonical, escape, unescape
from tripleloom.functions.terms import kind, kind_of, literal_text, plain_string, sort_key, split_quoted

ORDERED = [
    None, "<< <a> <b> 1 >>", "<< <a> <b> 2 >>", "<< <a> <c> 1 >>", "_:f/2", "_:f/10", "<a>", "<a/b>", "<b>", '""', '"a"', '"b"', '"é"', '"a"@de', '"a"@en', '"b"@de',
    "-10", "-9", "0", "5", "+7", "12345678901234567890", "-1.5", "0.5", "2.0", "-1e3", "-1e-3", "1e-3", "1.5E3", '"a"^^<x>', '"a"^^<y>', '"b"^^<x>',
]


def test_total_order():
    shuffled = ORDERED[:]
    random.Random(1).shuffle(shuffled)
    assert sorted(shuffled, key=lambda k: sort_key(k) or b"") == ORDERED


def test_text_that_is_no_term_comes_last():
    odd = ["<< <a> <b> >>", "<< <a>\t <b> \t>>", "<< <a> <b <c> >>", "<<", "<<>>", "abc", '"open', "<open", '"x">', "1.2.3", ""]
    assert all(sort_key(k) >= b"\x03" for k in odd)
    assert sorted(["zzz", "abc", '"a"^^<x>'], key=sort_key) == ['"a"^^<x>', "abc", "zzz"]
    assert sort_key("0." + "1" * 60) < sort_key("0.2")


def test_numbers_of_any_length_order_by_value():
    r = random.Random(3)
    integers = [str(r.choice([1, -1]) * r.randrange(10 ** r.randint(1, 200))) for _ in range(200)] + [str(10**60 - 1), str(10**60), str(10**61), str(-(10**61)), str(1 - 10**60), "9" * 5000, "-" + "9" * 5000]
    sys.set_int_max_str_digits(0)
    assert [int(k) for k in sorted(integers, key=sort_key)] == sorted(map(int, integers))
    decimals = [f"{x}.{'0' * r.randint(0, 60)}{r.randrange(10 ** r.randint(1, 90))}" for x in integers[:100]] + ["-0.0", "0.0", "-0.1", "0.1", ".5"]
    assert [Decimal(k) for k in sorted(decimals, key=sort_key)] == sorted(map(Decimal, decimals))
    blanks = ["_:f/2", "_:f/10", "_:f/" + "9" * 30, "_:f/1" + "0" * 30, "_:f/x"]
    assert sorted(reversed(blanks), key=sort_key) == blanks


@given(st.lists(st.integers()))
def test_integers_order_by_value(values):
    assert sorted(map(str, values), key=sort_key) == list(map(str, sorted(values)))


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False)))
def test_doubles_order_by_value(values):
    keys = [f"{v:e}" for v in values]
    assert [float(k) for k in sorted(keys, key=sort_key)] == sorted(float(k) for k in keys)


@given(st.text(alphabet=st.characters(codec="utf-8")), st.text(alphabet=st.characters(codec="utf-8")))
def test_strings_order_by_code_points(a, b):
    assert (sort_key(f"<{a}>") < sort_key(f"<{b}>")) == (a < b)


@given(st.text(alphabet=st.characters(codec="utf-8")))
def test_escapes_round_trip(text):
    assert unescape(escape(text)) == text
    assert canonical(escape(text)) == escape(text)


def test_escapes():
    assert canonical("caf\\u00E9 \\'x\\' \\\\") == "café 'x' \\\\"
    assert unescape("\\q \\uD800") == "\\q \\uD800"


def test_split_quoted():
    inner = '<< <a> <b> "x >> \\" y"@en >>'
    assert split_quoted(f"<< {inner} <p> _:f/1 >>") == (inner, "<p>", "_:f/1")


def test_kinds_in_the_jvm(spark):
    keys = [k for k in ORDERED if k is not None]
    got = spark.createDataFrame([(k,) for k in [*keys, None]], "k string")
    for row in got.select("k", kind(got.k).alias("kind")).collect():
        assert row["kind"] == kind_of(row["k"])


def test_literal_text(spark):
    df = spark.createDataFrame([('"a \\"b\\""@en',), ('"x"^^<d>',), ("5",), ("<i>",), ("_:a/1",), (None,), ('"x"^^<http://www.w3.org/2001/XMLSchema#string>',)], "k string")
    assert [r[0] for r in df.select(literal_text(df.k)).collect()] == ['a "b"', "x", "5", None, None, None, "x"]
    assert df.select(plain_string(df.k)).collect()[-1][0] == '"x"'
