import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tripleloom.operators.changes import DeltaVectorTable, bit_is_set

FEED = "change_id bigint, s string, p string, o string, old_o string, status int, valid_from bigint, seq int, extra string"


def brute(feed):
    """Apply the changes one after another."""
    store = {}
    known = {c[1:8] for c in feed if c[5] in (0, 1) and None not in (c[1], c[2], c[6])}
    for s, p, o, old, status, _, _ in sorted(known, key=lambda c: (c[5], -1 if c[6] is None else c[6], c[4] == 0, repr(c))):
        have = store.setdefault((s, p), set())
        if status == 0:
            have.discard(old)
            if o is not None:
                have.add(o)
        elif o is None:
            have.clear()
        else:
            have.discard(o)
    return sorted((s, p, o) for (s, p), have in store.items() for o in have)


def feed(seed, n=600):
    r = random.Random(seed)
    made, used = [], {}
    for i in range(n):
        s, p = f"<s{r.randint(0, 5)}>", r.choice(["<p>", "<q>"])
        v = r.randint(1, 30)
        used[(s, p, v)] = seq = used.get((s, p, v), -1) + 1
        status = r.choice([0, 0, 0, 1, 1, 2])
        old = f'"{r.randint(0, 6)}"' if status == 0 and r.random() < 0.3 else None
        o = None if r.random() < 0.1 else f'"{r.randint(0, 6)}"'
        made.append((i, s if r.random() > 0.02 else None, p, o, old, status, None if r.random() < 0.03 else v, seq, "x"))
    made += [(n + k, *r.choice(made)[1:]) for k in range(n // 4)]
    r.shuffle(made)
    return made


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 3)])
def test_state_is_that_of_brute_force(spark, tmp_path, seed, batches):
    made = feed(seed)
    store = DeltaVectorTable(spark, f"file://{tmp_path}/t")
    assert store.read().count() == 0
    for k in range(batches):
        store.apply(spark.createDataFrame(made[k::batches], FEED))
    assert rows(store.read()) == brute(made)
    store.apply(spark.createDataFrame(made[:100], FEED))  # delivered again
    assert rows(DeltaVectorTable(spark, f"file://{tmp_path}/t").read()) == brute(made)


def test_files_are_not_rewritten(spark, tmp_path):
    store = DeltaVectorTable(spark, f"file://{tmp_path}/t")
    store.apply(spark.createDataFrame([(1, "<s>", "<p>", '"a"', None, 0, 1, 0, ""), (2, "<s>", "<p>", '"b"', None, 0, 1, 1, "")], FEED))
    before = sorted(f.name for f in (tmp_path / "t/rows").rglob("*.parquet"))
    store.apply(spark.createDataFrame([(3, "<s>", "<p>", None, None, 1, 5, 0, ""), (4, "<s>", "<p>", '"c"', None, 0, 6, 0, "")], FEED))
    assert rows(store.read()) == [("<s>", "<p>", '"c"')]
    assert set(before) <= {f.name for f in (tmp_path / "t/rows").rglob("*.parquet")}
    store.apply(spark.createDataFrame([(5, "<s>", "<p>", '"z"', None, 0, 4, 0, "")], FEED))  # older than the end of all
    assert rows(store.read()) == [("<s>", "<p>", '"c"')]


def test_empty_feed(spark, tmp_path):
    store = DeltaVectorTable(spark, f"file://{tmp_path}/t")
    store.apply(spark.createDataFrame([], FEED))
    assert store.read().count() == 0


def test_bits(spark):
    df = spark.range(20).where("id % 3 = 0").select(F.bitmap_construct_agg("id").alias("b"))
    got = [r.id for r in spark.range(20).join(df).where(bit_is_set(F.col("b"), F.col("id"))).orderBy("id").collect()]
    assert got == list(range(0, 20, 3))


def test_one_change_touches_one_bucket(spark, tmp_path):
    store = DeltaVectorTable(spark, f"file://{tmp_path}/t", buckets=8)
    store.apply(spark.createDataFrame([(i, f"<s{i}>", "<p>", '"a"', None, 0, 1, 0, "") for i in range(60)], FEED))
    before = store.state()
    store.apply(spark.createDataFrame([(99, "<s5>", "<p>", '"b"', '"a"', 0, 2, 0, "")], FEED))
    after = store.state()
    changed = {b for kind in ("rows", "index", "bits", "tombs") for b in after[kind] if after[kind][b] != before[kind].get(b)}
    assert len(changed) == 1 and len(before["rows"]) == 8
    assert ("<s5>", "<p>", '"b"') in rows(store.read()) and len(rows(store.read())) == 60
    assert not list((tmp_path / "t/steps").glob("*"))


def test_many_small_batches_are_compacted(spark, tmp_path, monkeypatch):
    from tripleloom.operators import changes, vectors

    monkeypatch.setattr(vectors, "COMPACT_AFTER", 2)
    monkeypatch.setattr(changes, "COMPACT_AFTER", 2)
    made = feed(7, 200)
    store = DeltaVectorTable(spark, f"file://{tmp_path}/t", buckets=2)
    for k in range(6):
        store.apply(spark.createDataFrame(made[k::6], FEED))
        assert all(len(d) <= 3 for kind in ("rows", "tombs") for d in store.state()[kind].values())
    assert rows(store.read()) == brute(made)
