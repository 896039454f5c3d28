import random

import pandas as pd
import pyarrow as pa
import pytest
from conftest import rows

from pyspark.sql import functions as F

from tripleloom.operators.numbering import number_rows
from tripleloom.operators.skew import chunk_states, fold_by_key, longest_pauses, top_subjects


def brute(triples):
    found = {}
    for s, p, o in triples:
        if None not in (s, p, o):
            found.setdefault(p, {}).setdefault(s, set()).add(o)
    out = []
    for p, by in found.items():
        most = max(map(len, by.values()))
        out.append((p, min(s for s, os in by.items() if len(os) == most), most))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_top_subjects(spark, chunk):
    r = random.Random(4)
    data = [(f"s{r.randint(0, 40)}", "hot" if r.random() < 0.7 else f"p{r.randint(0, 30)}", f"o{r.randint(0, 60)}") for _ in range(3000)]
    data += data[:500] + [("s", None, "o"), (None, "hot", "o"), ("s", "p1", None), ("é", "ties", "1"), ("z", "ties", "1")] + [("big", "hot", f"b{i}") for i in range(90)]
    df = spark.createDataFrame([(*t, 1) for t in data], "s string, p string, o string, n int")
    assert rows(top_subjects(df, chunk)) == brute(data)


def test_empty(spark):
    assert top_subjects(spark.createDataFrame([], "s string, p string, o string")).count() == 0


def test_fold_by_key(spark):
    """The longest run of equal signs for each key: states have a head, a tail and the best between."""
    r = random.Random(5)
    data = [("hot" if r.random() < 0.8 else "cold", i, r.random() < 0.8) for i in range(2000)]

    def segment(part):
        v, best, run, head = list(part["up"]), 0, 0, None
        for x in v:
            run = run + 1 if x else 0
            best = max(best, run)
        head = next((i for i, x in enumerate(v) if not x), len(v))
        return {"head": head, "tail": run, "best": best, "size": len(v)}

    def merge(key, states):
        best = run = 0
        for _, x in states.iterrows():
            best = max(best, run + x["head"], x["best"])
            run = run + x["size"] if x["head"] == x["size"] else x["tail"]
        return pd.DataFrame([(key[0], best)], columns=["k", "best"])

    df = spark.createDataFrame(data, "k string, t int, up boolean")
    got = fold_by_key(df, "k", ["t"], segment, merge, "head bigint, tail bigint, best bigint, size bigint", "k string, best bigint", chunk_rows=50)
    want = {}
    for k in ("hot", "cold"):
        text = "".join("1" if up else "0" for key, _, up in data if key == k)
        want[k] = max(map(len, text.split("0")))
    assert dict(rows(got)) == want


def test_longest_pauses(spark):
    import datetime

    r = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    data = [("hot" if r.random() < 0.8 else f"p{r.randint(0, 5)}", start + datetime.timedelta(microseconds=r.randrange(10**9))) for _ in range(1500)]
    data += [("one", start), (None, start), ("hot", None), ("ties", start), ("ties", start)]
    want = {}
    for p in {p for p, t in data if p and t}:
        at = sorted(t for q, t in data if q == p and t)
        want[p] = max([(b - a) // datetime.timedelta(microseconds=1) for a, b in zip(at, at[1:])], default=0)
    df = spark.createDataFrame([(*x, 1, 2) for x in data], "p string, loaded_at timestamp, pos int, chunk int")
    for chunk in (1, 64, 10_000):
        assert dict(rows(longest_pauses(df, chunk))) == want
    assert longest_pauses(df.where("false")).count() == 0


def test_no_task_has_more_than_its_share(spark):
    """One key with nearly all rows: the rows of the tasks differ by less than two chunks' worth of spreading."""
    numbered = number_rows(spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("v")), "k", "v")
    sizes = chunk_states(numbered, "k", ["v"], lambda b, starts: pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([len(starts)])], names=["n", "keys"]), "n bigint, keys bigint", 100)
    assert [tuple(r) for r in sizes.collect()] == [(100, 1)] * 40
