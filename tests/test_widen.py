import datetime
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tripleloom.operators.widen import Attribute, cells, parsed, pivot_blocks

X = "http://www.w3.org/2001/XMLSchema#"


def values(spark, kind, *keys):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, o string")
    return [r["v"] for r in df.select("i", parsed(F.col("o"), kind)["val"].alias("v")).orderBy("i").collect()]


def test_parsing(spark):
    assert values(spark, "string", '" a "', '""', '"  "', '"a\\"b"@en', "5", "<i>", "_:b/1", None) == ["a", None, None, 'a"b', "5", None, None, None]
    assert values(spark, "int", "5", '"+007"', '" -0 "', '"1.0"', '""', '"-12"^^<x>', '"' + "9" * 50 + '"') == ["5", "7", "0", None, None, "-12", "9" * 50]
    assert values(spark, "decimal", "208E-2", '"1.005"', "5", '"+1.58"', '"1."', '".5"', '"1,5"', '"1e400"') == ["2.08", "1.01", "5.00", "1.58", None, None, None, None]
    assert values(spark, "date", '"2024-02-29"', '"2023-02-29"', '"2024-02-29T10:00"', '"2024-02-29Z"', '"24-02-29"', '"0000-01-01"') == ["2024-02-29", None, "2024-02-29", None, None, None]
    assert values(spark, "boolean", '"TRUE"', "1", '"0"', '"yes"') == ["true", "true", "false", None]
    assert values(spark, "year", '"1999"', "2006", '"-1933"', '"99"') == ["1999", "2006", None, None]
    assert values(spark, "iri", "<mailto:a>", '"<a>"', "<< <a> <b> <c> >>") == ["mailto:a", None, None]


ATTRIBUTES = [Attribute("<n1>", "name", "string"), Attribute("<n2>", "name", "string"), Attribute("<a>", "age", "int"), Attribute("<h>", "height", "decimal"), Attribute("<b>", "born", "date"), Attribute("<t>", "active", "boolean")]


def test_smallest_valid_value_and_blocks(spark):
    data = [
        ("<x>", "<n1>", '"b"'), ("<x>", "<n2>", '"a"'), ("<x>", "<a>", "10"), ("<x>", "<a>", "9"), ("<x>", "<a>", '"-3"'), ("<x>", "<a>", '"-20"'), ("<x>", "<a>", '"old"'), ("<x>", "<h>", "1.5"), ("<x>", "<h>", "1E1"),
        ("<x>", "<t>", '"true"'), ("<x>", "<t>", "0"), ("<y>", "<b>", '"1990-01-02T00"'), ("<y>", "<b>", '"bad"'), ("<z>", "<n1>", '"no entity"'), ("<w>", "<n1>", None), (None, "<n1>", '"x"'),
    ]
    triples = spark.createDataFrame(data * 2, "s string, p string, o string").withColumn("name", F.lit("clash"))
    people = spark.createDataFrame([("<x>",), ("<x>",), ("<y>",), ("<w>",), (None,)], "s string")
    want = [("<w>", None, None, None, None, None), ("<x>", "a", Decimal(-20), Decimal("1.50"), None, False), ("<y>", None, None, None, datetime.date(1990, 1, 2), None)]
    for block in (1, 2, 64):
        assert rows(pivot_blocks(triples, people, ATTRIBUTES, block)) == want
    made = cells(pivot_blocks(triples, people, ATTRIBUTES, 2, typed=False), ["name", "age", "height", "born", "active"])
    assert rows(made) == [("<x>", "active", "false"), ("<x>", "age", "-20"), ("<x>", "height", "1.50"), ("<x>", "name", "a"), ("<y>", "born", "1990-01-02")]


def test_blocks_join_without_further_shuffles(spark):
    triples = spark.createDataFrame([("<x>", "<n1>", '"b"')], "s string, p string, o string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pivot_blocks(triples, triples.select("s"), ATTRIBUTES, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning(s#") == 4  # the entities and each of three blocks once


def test_empty(spark):
    empty = spark.createDataFrame([], "s string, p string, o string")
    assert pivot_blocks(empty, empty.select("s"), ATTRIBUTES).count() == 0


def exact(text):
    """Rounded half up to two places, by Python's decimals."""
    with localcontext() as c:
        c.prec, c.Emin, c.Emax = 2000, -10**9, 10**9
        made = Decimal(text).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        return f"{made if made else abs(made):f}"


def test_decimals_are_exact_at_any_size(spark):
    r = random.Random(0)
    texts = ["1e28", "-1e28", "12345678901234567890123456789.125", "1" + "0" * 400, "9" * 40 + ".995", "-" + "9" * 40 + ".995", "1.00499999999999", "-1.00499999999999", "0.00499999999999999", "0.995", "-0.001", "-0.005", "0e999", "1e-400", "5e-3", "4e-3", "1e308", "0.5e-2", "99.999e0", "1E-99999999999999999999", "0e99999999999999999999", "00012.5e1"]
    texts += ["".join([r.choice(["", "-", "+"]), *r.choices("0159", k=r.randint(1, 40)), *(["."] + r.choices("0459", k=r.randint(1, 14)) if r.random() < 0.7 else []), f"e{r.randint(-45, 45)}" if r.random() < 0.5 else ""]) for _ in range(300)]
    want = [exact(t) if len(t) < 22 or "e" not in t.lower() or abs(int(t.lower().split("e")[1])) < 10**9 else "0.00" for t in texts]
    assert values(spark, "decimal", *[f'"{t}"' for t in texts]) == want
    assert values(spark, "decimal", '"1e309"', '"1e99999999999999999999"', '"1e9223372036854775807"') == [None] * 3


def test_decimals_are_ordered_by_value(spark):
    groups = [["1e30", "9e29", "1e31"], ["-1e30", "5", "-1e29"], ["1.00499999999999", "1.005"], ["-2", "-10", "-1.5"], ["0.1", "-0.001", "100"]]
    data = [(f"<x{i}>", "<h>", f'"{t}"') for i, g in enumerate(groups) for t in g]
    df = spark.createDataFrame(data, "s string, p string, o string")
    made = pivot_blocks(df, df.select("s"), [Attribute("<h>", "height", "decimal")], typed=False)
    assert rows(made) == [(f"<x{i}>", exact(min(g, key=Decimal))) for i, g in enumerate(groups)]


def test_wide_table_keeps_what_its_types_cannot_hold(spark):
    df = spark.createDataFrame([("<x>", "<a>", "9" * 39), ("<x>", "<h>", "1e40"), ("<y>", "<a>", "7"), ("<y>", "<n1>", '"n"')], "s string, p string, o string")
    made = pivot_blocks(df, df.select("s"), ATTRIBUTES, beyond="beyond_types").select("s", "age", "height", "name", "beyond_types")
    assert rows(made) == [("<x>", None, None, None, {"age": "9" * 39, "height": "1" + "0" * 40 + ".00"}), ("<y>", Decimal(7), None, "n", {})]


def test_types_of_one_column_must_agree(spark):
    df = spark.createDataFrame([("<x>", "<a>", "1")], "s string, p string, o string")
    with pytest.raises(ValueError, match="'age'"):
        pivot_blocks(df, df.select("s"), [Attribute("<a>", "age", "int"), Attribute("<b>", "age", "string")])
    with pytest.raises(ValueError, match="unknown type"):
        pivot_blocks(df, df.select("s"), [Attribute("<a>", "age", "float")])
    assert rows(pivot_blocks(df, df.select("s"), [])) == [("<x>",)]


def test_a_predicate_of_several_blocks_and_one_scan(spark, tmp_path):
    spark.createDataFrame([("<x>", "<a>", "1"), ("<x>", "<b>", "2"), ("<y>", "<c>", "3")], "s string, p string, o string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    made = pivot_blocks(df, df.select("s"), [Attribute("<a>", "one", "int"), Attribute("<b>", "two", "int"), Attribute("<a>", "three", "string")], block=1)
    assert rows(made) == [("<x>", 1, 2, "1"), ("<y>", None, None, None)]
    read = [f for f in made.inputFiles() if f"{tmp_path}/t/" in f]
    assert len(read) == len(set(df.inputFiles()))  # the blocks are read from their own folders
