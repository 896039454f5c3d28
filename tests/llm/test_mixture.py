import os
import random

import pytest

from tripleloom.llm import mixture, tokenise

pytestmark = pytest.mark.skipif(not os.path.exists(tokenise.VOCABULARY), reason="no vocabulary file")
DOCUMENTS = "doc_id bigint, text string, source string, tokens int, place string"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, seed=1):
    r = random.Random(seed)
    rows = [(i, "word " * r.randint(1, 60), r.choices(["big", "mid", "small", None, "other"], [60, 30, 6, 2, 2])[0], 0, "x") for i in range(700)]
    rows += [(1000, "", "big", 0, "x"), (1001, None, "small", 0, "x")]
    return spark.createDataFrame(rows, DOCUMENTS)


def shares(spark, chosen):
    sums, most = {}, {}
    for r in chosen.collect():
        sums[r.source] = sums.get(r.source, 0) + r.tokens * r.repeats
        most[r.source] = max(most.get(r.source, 0), r.repeats)
    return sums, most


@pytest.mark.parametrize("most_sums", [1 << 13, 1 << 5])
def test_targets_are_met(spark, monkeypatch, most_sums):
    monkeypatch.setattr(mixture, "MOST_SUMS", most_sums)
    docs = corpus(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)], TARGETS)
    chosen, found = mixture.select(docs, targets)
    sums, most = shares(spark, chosen)
    total = sum(sums.values())
    for t in found:
        assert abs(sums[t.source] - t.budget) <= 31, t  # half of the longest document
        assert abs(sums[t.source] / total - t.share) < 0.02
        assert most[t.source] <= t.repeats
    sizes = {t.source: t.size for t in found}
    # the source that limits the mixture is used to the full
    assert min(t.repeats * sizes[t.source] / t.share for t in found) == pytest.approx(sum(t.budget for t in found))
    got = [(r.source, r.target_share, r.tokens) for r in mixture.shares(docs, targets).orderBy("source").collect()]
    assert got == [(s, x, sums[s]) for s, x in (("big", 0.5), ("mid", 0.3), ("small", 0.2))]


def test_smaller_mixtures_are_nested(spark):
    docs = corpus(spark, 2)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 1)], TARGETS)
    ids = [{r.doc_id for r in mixture.select(docs, targets, total)[0].collect()} for total in (1000, 3000, 6000)]
    assert ids[0] < ids[1] < ids[2]


def test_brute_force_thresholds(spark):
    docs = corpus(spark, 3)
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3)], TARGETS)
    chosen, found = mixture.select(docs, targets, 2500)
    sizes = mixture.sized(docs, found, tokenise.VOCABULARY).collect()
    for t in found:
        mine = sorted((r.place, r.tokens, r.doc_id) for r in sizes if r.source == t.source)
        rest = t.budget - t.whole * t.size
        best, at, total = None, set(), 0
        for k in range(len(mine) + 1):
            gap = abs(total - rest)
            if best is None or gap < best:
                best, at = gap, {d for _, _, d in mine[:k]}
            total += mine[k][1] if k < len(mine) else 0
        assert {r.doc_id for r in chosen.collect() if r.source == t.source and r.repeats > t.whole} == at


def test_defined_cases(spark):
    docs = corpus(spark)
    odd = spark.createDataFrame([("nowhere", 0.5, 2), ("mid", 0.5, 1), ("big", None, 1), ("small", 0.1, None), (None, 0.3, 1), ("mid", 0.2, 9)], TARGETS)
    chosen, found = mixture.select(docs, odd)
    assert {r.source for r in chosen.collect()} == {"mid"} and [t.source for t in found] == ["mid", "nowhere", "small"]
    assert {r.source: r.actual_share for r in mixture.shares(docs, odd).collect()} == {"mid": 1.0, "nowhere": 0.0, "small": 0.0}
    none = spark.createDataFrame([], TARGETS)
    assert mixture.select(docs, none)[0].count() == 0 and mixture.shares(docs, none).count() == 0
    assert mixture.select(docs.where("doc_id < 0"), odd)[0].count() == 0
    assert mixture.select(docs, odd, 10**9)[0].where("repeats > 1").count() == 0
