import random

import pytest
from conftest import rows

from tripleloom.operators import history
from tripleloom.operators.vectors import Conflict

SNAPSHOTS = "row_id bigint, graph_name string, version int, s string, p string, o string, loaded_at timestamp"
LOG = "graph_name string, version int, complete boolean, taken_at timestamp"
from datetime import datetime, timedelta  # noqa: E402

START = datetime(2024, 1, 1)


def brute(snapshots, log):
    """Periods by walking over the versions of each graph."""
    complete = {}
    for g, v, c, _ in log:
        if c and g is not None and v is not None:
            complete.setdefault(g, set()).add(v)
    seen = {}
    for _, g, v, s, p, o, _ in snapshots:
        if None not in (g, v, s, p, o):
            o = o[: -len("^^<http://www.w3.org/2001/XMLSchema#string>")] if o.endswith('"^^<http://www.w3.org/2001/XMLSchema#string>') else o
            seen.setdefault((g, s, p, o), set()).add(v)
    out = []
    for (g, s, p, o), versions in seen.items():
        begun = None
        for v in sorted(versions | complete.get(g, set())):
            if v in versions:
                begun = v if begun is None else begun
            elif begun is not None:
                out.append((s, p, o, begun, v))
                begun = None
        if begun is not None:
            out.append((s, p, o, begun, -1))
    return sorted(out, key=repr)


def sample(seed, n=400):
    r = random.Random(seed)
    log = [(g, v, r.random() < 0.7, START + timedelta(days=v)) for g in ("a", "b") for v in range(1, 10) if r.random() < 0.8]
    found = []
    for i in range(n):
        g, v = r.choice("aab"), r.randint(1, 9)
        late = timedelta(days=r.choice([0, 0, 0, 3, 9]))
        o = r.choice(['"x"', '"x"^^<http://www.w3.org/2001/XMLSchema#string>', '"y"', "5", None])
        found.append((i, g, v, f"<{g}{r.randint(0, 4)}>", r.choice(["<p>", "<q>", None] if r.random() < 0.1 else ["<p>", "<q>"]), o, None if r.random() < 0.05 else START + timedelta(days=v) + late))
    return found, log


@pytest.mark.parametrize("seed", [1, 2])
def test_history_is_that_of_brute_force(spark, seed):
    found, log = sample(seed)
    rows_df, log_df = spark.createDataFrame(found, SNAPSHOTS), spark.createDataFrame(log, LOG)
    assert rows(history.history(rows_df, log_df).drop("graph_name")) == brute(found, log)
    assert rows(history.build_chains(rows_df, log_df).drop("graph_name")) == brute(found, log)


def test_store_applies_batches_in_any_order_and_twice(spark, tmp_path):
    found, log = sample(3)
    log_df = spark.createDataFrame(log, LOG)
    store = history.ChainStore(spark, f"file://{tmp_path}/chains", buckets=4)
    assert store.read() is None
    random.Random(0).shuffle(found)
    for part in (found[:250], found[250:], found[100:150]):
        store.apply(spark.createDataFrame(part, SNAPSHOTS), log_df)
    assert rows(store.read().select("s", "p", "o", "valid_from", "valid_to")) == brute(found, log)
    store.apply(spark.createDataFrame([], SNAPSHOTS), log_df)
    assert rows(history.ChainStore(spark, f"file://{tmp_path}/chains").read().select("s", "p", "o", "valid_from", "valid_to")) == brute(found, log)


def test_empty_and_extra_columns(spark):
    log = spark.createDataFrame([], LOG)
    assert history.history(spark.createDataFrame([], SNAPSHOTS), log).count() == 0
    one = spark.createDataFrame([(1, "g", 2, "<s>", "<p>", "<o>", START, 7, "x"), (2, None, 2, "<s>", "<p>", "<o>", START, 7, "x")], SNAPSHOTS + ", taken int, seen string")
    assert rows(history.history(one, log)) == [("g", "<s>", "<p>", "<o>", 2, -1)]


def test_as_of(spark):
    df = spark.createDataFrame([("<a>", 1, 3), ("<b>", 2, -1)], "s string, valid_from int, valid_to int")
    assert [r.s for r in history.as_of(df, 3).collect()] == ["<b>"]
    assert history.as_of(df, 2).count() == 2


def kept(store):
    return rows(store.read().select("s", "p", "o", "valid_from", "valid_to"))


def test_store_ends_periods_as_the_log_grows(spark, tmp_path):
    found = [(i, "ab"[i % 2], 1, f"<s{i}>", "<p>", "<o>", START) for i in range(20)]
    store = history.ChainStore(spark, f"file://{tmp_path}/chains", buckets=64)
    log = []

    def apply(shown, *entries):
        log.extend(entries)
        store.apply(spark.createDataFrame(shown, SNAPSHOTS), spark.createDataFrame(log, LOG))
        done.extend(shown)
        assert kept(store) == brute(done, log)

    done = []
    apply(found, ("a", 1, True, START), ("b", 1, True, START))
    apply([(20, "a", 2, "<s0>", "<p>", "<o>", START)], ("a", 2, True, START))  # small: ends nine others of a, none of b
    assert sum(r[-1] == 2 for r in kept(store)) == 9
    apply([], ("b", 2, False, START))
    apply([], ("b", 3, True, START))  # empty: ends all of b
    assert sum(r[-1] == 3 for r in kept(store)) == 10
    log.remove(("b", 2, False, START))
    apply([], ("b", 2, True, START))  # a correction of the log without rows
    assert sum(r[-1] == 2 for r in kept(store)) == 19
    log.remove(("b", 2, True, START))
    apply([(21, "b", 2, "<s1>", "<p>", "<o>", START)])


def test_store_does_not_depend_on_batches_and_buckets(spark, tmp_path):
    found, log = sample(4, 120)
    for buckets in (1, 64):
        store = history.ChainStore(spark, f"file://{tmp_path}/{buckets}", buckets)
        for v in (3, 6, 9):
            part, known = [r for r in found if v - 3 < r[2] <= v], [e for e in log if e[1] <= v]
            store.apply(spark.createDataFrame(part, SNAPSHOTS), spark.createDataFrame(known, LOG))
        assert kept(store) == brute(found, log)


def test_stream_reads_the_log_anew(spark, tmp_path):
    from tripleloom.streaming.incremental import stream_history

    for v, shown in ((1, ["<x>", "<y>"]), (2, ["<x>"])):
        spark.createDataFrame([(1, "g", v, s, "<p>", "<o>", START) for s in shown], SNAPSHOTS).coalesce(1).write.parquet(f"{tmp_path}/in/part={v}")
    logs = iter([[("g", 1, True, START)], [("g", 1, True, START), ("g", 2, True, START)]])
    store = history.ChainStore(spark, f"file://{tmp_path}/chains")
    source = spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream_history(source, lambda: spark.createDataFrame(next(logs), LOG), store, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r[-1] for r in kept(store)) == [-1, 2]


def test_p1_found_corrects_a_store(spark, tmp_path, monkeypatch):
    from tripleloom.queries import problems

    found, log = sample(5)
    spark.createDataFrame(found, SNAPSHOTS).write.parquet(f"{tmp_path}/graph_snapshots.parquet")
    spark.createDataFrame(log, LOG).write.parquet(f"{tmp_path}/snapshot_log.parquet")
    batches, apply = [], history.ChainStore.apply
    monkeypatch.setattr(history.ChainStore, "apply", lambda self, rows, log: (batches.append(rows.count()), apply(self, rows, log)))
    assert rows(problems.p1_found(spark, str(tmp_path))) == brute(found, log)
    assert len(batches) == 2 and min(batches) > 0 and sum(batches) == len(found)


def test_late_sightings_read_and_write_only_their_chains(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, True, START), ("a", 2, True, START)], LOG)
    store = history.ChainStore(spark, f"file://{tmp_path}/chains", buckets=4)
    store.apply(spark.createDataFrame([(i, "a", 1, f"<s{i}>", "<p>", "<o>", START) for i in range(40)], SNAPSHOTS), log)
    before = store.state()
    store.apply(spark.createDataFrame([(99, "a", 2, "<s1>", "<p>", "<o>", START)], SNAPSHOTS), log)
    after = store.state()
    changed = [b for b in after["rows"] if after["rows"][b] != before["rows"].get(b)]
    assert len(changed) == 1 and all(d in after["rows"][b] for b, dirs in before["rows"].items() for d in dirs)
    [made] = [d for d in after["rows"][changed[0]] if d not in before["rows"][changed[0]]]
    assert rows(spark.read.schema(history.CHAINS).parquet(f"{store.path}/{made}")) == [("a", "<s1>", "<p>", "<o>", 1, -1)]
    assert {r[0]: r[-1] for r in kept(store)} == {f"<s{i}>": -1 if i == 1 else 2 for i in range(40)}


def test_two_writers_of_one_version(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, True, START)], LOG)
    store = history.ChainStore(spark, f"file://{tmp_path}/chains", buckets=2)
    one = spark.createDataFrame([(1, "a", 1, "<s>", "<p>", "<o>", START)], SNAPSHOTS)
    two = spark.createDataFrame([(2, "a", 1, "<t>", "<p>", "<o>", START)], SNAPSHOTS)
    first, calls = store.state, []

    def state():
        found = first()
        if not calls:
            calls.append(1)
            history.ChainStore(spark, f"file://{tmp_path}/chains", buckets=2).apply(two, log)  # the other writer is faster
        return found

    store.state = state
    store.apply(one, log)
    assert [r[0] for r in kept(history.ChainStore(spark, f"file://{tmp_path}/chains"))] == ["<s>", "<t>"]
    with pytest.raises(Conflict):
        store.versions.publish({"version": 1})


def test_compaction_and_vacuum(spark, tmp_path):
    found, log = sample(6, 200)
    log_df = spark.createDataFrame(log, LOG)
    store = history.ChainStore(spark, f"file://{tmp_path}/chains", buckets=3)
    for k in range(5):
        store.apply(spark.createDataFrame(found[k::5], SNAPSHOTS), log_df)
    assert kept(store) == brute(found, log)
    store.change(lambda state, tag: store.compact(state, tag, range(3)) is None)
    assert all(len(d) == 1 for d in store.state()["rows"].values()) and store.state()["bits"] == {}
    assert kept(store) == brute(found, log)
    for version in store.versions._all()[:-1]:
        (tmp_path / f"chains/manifest-{version}.json").unlink()
    assert store.vacuum() > 0 and kept(store) == brute(found, log)


def test_corrected_empty(spark, tmp_path):
    store = history.ChainStore(spark, f"file://{tmp_path}/chains")
    assert history.corrected(store, spark.createDataFrame([], SNAPSHOTS), spark.createDataFrame([], LOG)).count() == 0
