"""Mixing sources to target weights by hash-threshold histograms.

Sizes are tokens.  A source with budget b and size n gives every document ``b // n`` times, and once more those whose
hash is at most a threshold.  The threshold is found from token sums by source and hash bucket: the bucket in which the
budget runs out is split into finer buckets, again and again, so only its documents are read again, nothing is sorted,
and a smaller budget always selects a subset of a larger one's documents.

The largest mixture that meets all targets exactly (to one document) is made, unless ``total`` names another size; a
source then gives at most ``max_repeats`` times its size.

Defined cases: documents with NULL or unlisted source, and those without tokens, are not selected; a source without
tokens has the actual share 0 and the others' targets keep their proportions; targets with NULL source or a share that
is NULL or not positive are left out, a NULL or negative ``max_repeats`` is 0; repeated targets' first (by share)
counts; without targets or documents the selection is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import small_table, stored
from . import tokenise

SEED = 20_011
HASH_BITS = 63
#: Sums held by the driver at once: sources times buckets.
MOST_SUMS = 1 << 13


@dataclass
class Budget:
    source: str
    share: float
    repeats: int
    size: int = 0
    budget: float = 0.0
    whole: int = 0
    threshold: int = -1


def sized(documents: DataFrame, targets: list[Budget], path: str) -> DataFrame:
    """(doc_id, source, tokens, place) of the documents that can be selected."""
    listed = documents.where(F.col("source").isin([t.source for t in targets]))
    counted = tokenise.count(listed.select("doc_id", "source", "text"), ["doc_id", "source"], path=path).where("tokens > 0")
    return stored(counted.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 1)), "sized")


def read_targets(targets: DataFrame) -> list[Budget]:
    """The wanted mixture; as many rows as there are sources with a target."""
    rows = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).collect()
    return sorted((Budget(r["source"], r["t"]["target_share"], max(0, r["t"]["max_repeats"] or 0)) for r in rows), key=lambda b: b.source)


def find_thresholds(sizes: DataFrame, targets: list[Budget], total: float | None = None) -> None:
    """Fill in size, budget, whole passes and threshold of each target."""
    spark = sizes.sparkSession
    by = {t.source: t for t in targets}
    for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect():  # one row a target
        by[r["source"]].size = r["n"]
    there = [t for t in targets if t.size and t.repeats]
    if not there:
        return
    weight = sum(t.share for t in there)
    largest = min(t.repeats * t.size * weight / t.share for t in there)
    for t in there:
        t.budget = min(t.repeats * t.size, t.share / weight * (largest if total is None else total))
        t.whole = min(t.repeats, int(t.budget // t.size))
    # what is open: source, rest of the budget, bucket so far (its high bits) and how many bits it has
    rest = {t.source: t.budget - t.whole * t.size for t in there if t.whole < t.repeats and t.budget > t.whole * t.size}
    bucket, bits = dict.fromkeys(rest, 0), 0
    step = max(2, MOST_SUMS.bit_length() - 1 - max(1, len(rest)).bit_length())
    while rest and bits < HASH_BITS:
        more = min(step, HASH_BITS - bits)
        names = list(rest)
        open_ = small_table(spark, {"source": names, "high": [bucket[n] for n in names]}, {"source": pa.string(), "high": pa.int64()})
        inside = sizes.join(F.broadcast(open_), "source")
        if bits:
            inside = inside.where(F.shiftright("place", HASH_BITS - bits) == F.col("high"))
        sums = inside.groupBy("source", F.shiftright("place", HASH_BITS - bits - more).alias("low")).agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"))
        found: dict[str, list] = {n: [] for n in names}
        for r in sums.collect():  # at most MOST_SUMS rows
            found[r["source"]].append((r["low"], r["n"], r["docs"]))
        bits += more
        for n in names:
            last = (bucket[n] << more) - 1  # nothing of this bucket yet
            for low, size, docs in sorted(found[n]):
                if size <= rest[n]:
                    rest[n] -= size
                    last = low
                    continue
                if docs == 1 or bits == HASH_BITS:  # nothing to refine: in, if that is nearer
                    if size - rest[n] < rest[n]:
                        last = low
                    by[n].threshold = ((last + 1) << (HASH_BITS - bits)) - 1
                    del rest[n]
                else:
                    bucket[n] = low
                break
            else:  # all of it is in
                by[n].threshold = ((last + 1) << (HASH_BITS - bits)) - 1
                del rest[n]


def select(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = tokenise.VOCABULARY) -> tuple[DataFrame, list[Budget]]:
    """(doc_id, source, tokens, repeats) of the selected documents, and the budgets that were found."""
    wanted = read_targets(targets)
    sizes = sized(documents, wanted, path)
    find_thresholds(sizes, wanted, total)
    rule = small_table(
        documents.sparkSession, {"source": [t.source for t in wanted], "whole": [t.whole for t in wanted], "threshold": [t.threshold for t in wanted]},
        {"source": pa.string(), "whole": pa.int32(), "threshold": pa.int64()},
    )
    repeats = F.col("whole") + (F.col("place") <= F.col("threshold")).cast("int")
    return sizes.join(F.broadcast(rule), "source").select("doc_id", "source", "tokens", repeats.alias("repeats")).where("repeats > 0"), wanted


def shares(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = tokenise.VOCABULARY) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats) of each target."""
    chosen, wanted = select(documents, targets, total, path)
    sums = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    listed = small_table(documents.sparkSession, {"source": [t.source for t in wanted], "target_share": [t.share for t in wanted]}, {"source": pa.string(), "target_share": pa.float64()})
    made = listed.join(sums, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    everything = F.sum("tokens").over(Window.partitionBy())  # over one row a target
    return made.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), everything), F.lit(0.0)).alias("actual_share"), "tokens", "documents", "most_repeats")
