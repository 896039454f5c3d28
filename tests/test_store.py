import pytest
from pyspark.sql import functions as F

from conftest import F1, rows, term, triples

from tripleloom.operators import versions
from tripleloom.operators.numbering import number_rows
from tripleloom.operators.store import INDICES, TripleStore

DAVE, ERIC = term("ex:dave-smith"), term("ex:eric-miller")


@pytest.fixture(scope="module")
def people(spark):
    return TripleStore.of(spark, [*F1, F1[0]])


def test_count_and_membership(spark, people):
    assert people.count() == 8
    assert people.contains(*F1[3])
    assert not people.contains(F1[0][2], F1[0][1], F1[0][0])
    assert rows(people.members(spark.createDataFrame([F1[1], ("x", "y", "z")], "s string, p string, o string"))) == [F1[1]]


def test_spo_order_and_ordinals(people):
    order = [tuple(r) for r in people.scan().collect()]
    assert [(t[0], t[1].rsplit("/")[-1].rsplit("#")[-1].rstrip(">")) for t in order] == [
        (DAVE, "type"), (DAVE, "knows"), (DAVE, "name"), (ERIC, "type"), (ERIC, "knows"), (ERIC, "mbox"), (ERIC, "name"), (ERIC, "title"),
    ]
    assert people.ordinal(*F1[1]) == 2
    assert people.ordinal("<x>", "<y>", "<z>") is None
    assert [tuple(r)[:3] for r in people.ordinals().orderBy("ordinal").collect()] == order
    assert [tuple(r) for r in people.scan("spo", "spo").collect()] == order[::-1]


def test_terms(people):
    found = [r["term"] for r in people.terms().orderBy("sort_key").collect()]
    assert found == [DAVE, ERIC, term("a"), *[term(f"foaf:{x}") for x in ("Person", "knows", "mbox", "name", "title")], "<mailto:e.miller123(at)example>", '"Dave Smith"', '"Dr"', '"Eric Miller"']


def test_counts(people):
    assert rows(people.lead_counts("s")) == sorted([(DAVE, 3), (ERIC, 5)])
    assert {r[0]: r[1] for r in people.lead_counts("p").collect()} == {term("a"): 2, **{term(f"foaf:{k}"): n for k, n in (("knows", 2), ("mbox", 1), ("name", 2), ("title", 1))}}


def test_six_views(people):
    for index in INDICES:
        place = {"s": 0, "p": 1, "o": 2}
        want = {}
        for t in F1:
            want.setdefault((t[place[index[0]]], t[place[index[1]]]), set()).add(t[place[index[2]]])
        got = {(r[index[0]], r[index[1]]): r[index[2]] for r in people.view(index).collect()}
        assert {k: set(v) for k, v in got.items()} == want
        assert all(len(v) == len(set(v)) for v in got.values())


def test_insert_and_delete(spark, people):
    more = spark.createDataFrame([F1[0], ("<x>", "<y>", None), ("<x>", "<y>", "<z>"), ("<x>", "<y>", "<z>")], "s string, p string, o string")
    assert rows(people.new_triples(more)) == [("<x>", "<y>", "<z>")]
    assert people.insert(more).count() == 9
    assert people.delete(spark.createDataFrame(F1[6:] + [("<n>", "<n>", "<n>")], "s string, p string, o string")).count() == 6
    assert TripleStore.empty(spark).insert(more).count() == 2
    assert TripleStore.empty(spark).ordinals().count() == 0


def test_overlay(spark):
    base = TripleStore.of(spark, F1[:2])
    with base.overlay() as overlay:
        overlay.insert(spark.createDataFrame(F1[1:], "s string, p string, o string"))
        assert overlay.df.count() == 8
        assert base.count() == 2
    assert overlay.committed.count() == 8
    with pytest.raises(RuntimeError), base.overlay() as failed:
        failed.insert(spark.createDataFrame(F1, "s string, p string, o string"))
        raise RuntimeError
    assert failed.committed.count() == 2


def test_disk_round_trip(spark, people, tmp_path):
    people.write(str(tmp_path / "store"))
    back = TripleStore.read(spark, str(tmp_path / "store"))
    assert rows(back.df) == rows(people.df)
    plan = back.where(p=term("foaf:name"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_versions(spark):
    log = [(*t, v, False) for v, t in enumerate(F1)] + [(*F1[6], 8, True), (*F1[7], 9, True), (*F1[0], 5, False), ("<d>", "<k>", "<x>", 8, True), ("<n>", "<n>", None, 1, False)]
    made = versions.intervals(spark.createDataFrame(log, "s string, p string, o string, version int, deleted boolean"))
    found = {tuple(r)[:3]: tuple(r)[3:] for r in made.collect()}
    assert found[F1[6]] == (6, 8) and found[F1[7]] == (7, 9) and found[F1[0]] == (0, None)
    assert found[("<d>", "<k>", "<x>")] == (None, 8)
    assert versions.current(made).count() == 6
    assert versions.as_of(made, 7).count() == 8
    assert versions.as_of(made, 8).count() == 7
    assert rows(versions.tombstones(made)) == [("<d>", "<k>", "<x>", None, 8)]


def test_versions_reopen_and_move_ends(spark):
    log = [("s", "p", "o", v, d) for v, d in ((1, False), (3, True), (5, True), (7, False), (8, False), (8, True))]
    made = versions.intervals(spark.createDataFrame(log, "s string, p string, o string, version int, deleted boolean"))
    # in version 8 the deletion comes first, so the insertion opens a third period
    assert rows(made.select("valid_from", "valid_to")) == [(1, 5), (7, 8), (8, None)]


def test_numbering_of_one_hot_key(spark):
    df = spark.range(1000).selectExpr("cast(id % 7 = 0 as int) as k", "id as v", "'x' as pos")
    done = number_rows(df, "k", "v", parts=5)
    assert done.rows == 1000 and done.starts[0] == 0
    got = [tuple(r) for r in done.df.orderBy("pos").select("k", "v", "pos").collect()]
    assert got == [(k, v, i) for i, (k, v) in enumerate(sorted((int(v % 7 == 0), v) for v in range(1000)))]


def test_lookup_of_many_keys(spark, people):
    keys = spark.createDataFrame([(term("foaf:mbox"),), (term("foaf:title"),), ("<none>",)], "k string")
    assert people.lookup("p", keys).count() == 2


def test_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([("<a>", "<b>", "<c>", 1), ("<a>", "<b>", "<c>", 2)], "s string, p string, o string, version int")
    assert rows(TripleStore(df).df) == triples("<a> <b> <c>")


def test_map_terms(spark):
    store = TripleStore.of(spark, [("<a>", "<b>", "<c>"), ("<A>", "<b>", "<c>")])
    assert rows(store.map_terms(lambda c: F.upper(c)).df) == [("<A>", "<B>", "<C>")]
