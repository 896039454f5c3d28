"""Current state from a feed of inserts, updates and deletes, kept with delete vectors.

Row images are appended to files and never rewritten.  What a batch ends or supersedes (images of the same triple, or of
its subject and predicate if all objects end) is located through the index from key to file and position, of which only
the batch's buckets are opened, and the positions' bits are set in the files' bitmaps.  Readers filter positions by the
bitmaps.  Ends are kept as tombstones in the same buckets, because begins may arrive after them.

Order is (``valid_from``, ``seq``); inside one change the end of ``old_o`` precedes the begin of ``o``.  A feed may
arrive in any split and order and with any repetition, and gives the same state.

Defined cases: rows with status UNKNOWN (or any other than 0 and 1), or with NULL ``valid_from``, ``s`` or ``p`` are
left out; a NULL ``seq`` precedes all numbers; INSERTED with NULL ``o`` begins nothing (its ``old_o`` still ends);
DELETED ignores ``old_o``; of different changes with one (``s``, ``p``, ``valid_from``, ``seq``) inserts come last.
Extra columns are ignored; an empty feed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, drop_path
from .vectors import COMPACT_AFTER, HASH, VectorTable, bit_is_set, hashed

__all__ = ["DELETED", "INSERTED", "DeltaVectorTable", "bit_is_set", "events"]

# The status codes of the feed.
INSERTED, DELETED = 0, 1

KEY, PAIR = ["s", "p", "o"], ["s", "p"]
GROUP = ["g1", "g2"]
ORDER = "struct<v:bigint,q:bigint,sub:int>"
STEP = f"s string, p string, o string, begins {ORDER}, ends {ORDER}, k1 bigint, k2 bigint, g1 bigint, g2 bigint"
TOMB = f"k1 bigint, k2 bigint, g1 bigint, g2 bigint, whole boolean, ends {ORDER}"


def _order(sub: int) -> Column:
    return F.struct(F.col("valid_from").cast("bigint").alias("v"), F.coalesce(F.col("seq"), F.lit(-(2**31))).cast("bigint").alias("q"), F.lit(sub).alias("sub"))


def events(feed: DataFrame) -> DataFrame:
    """(s, p, o, begins, ends): the last order in which each triple begins and ends in a batch; ``o`` NULL: all objects end.

    One aggregate with map-side combining, so neither repeated changes nor a hot triple reach the shuffle as rows.
    """
    known = feed.where(F.col("status").isin(INSERTED, DELETED) & F.col("valid_from").isNotNull() & F.col("s").isNotNull() & F.col("p").isNotNull())
    nothing = F.lit(None).cast(ORDER)
    inserted = F.col("status") == INSERTED
    ended = F.struct(F.when(inserted, F.col("old_o")).otherwise(F.col("o")).alias("o"), nothing.alias("begin"), _order(0).alias("end"))
    begun = F.struct(F.col("o").alias("o"), _order(1).alias("begin"), nothing.alias("end"))
    steps = F.array_compact(F.array(F.when(inserted & F.col("o").isNotNull(), begun), F.when(~inserted | F.col("old_o").isNotNull(), ended)))
    return known.select("s", "p", F.inline(steps)).groupBy(*KEY).agg(F.max("begin").cast(ORDER).alias("begins"), F.max("end").cast(ORDER).alias("ends"))


class DeltaVectorTable(VectorTable):
    """A table of triples at ``path``: images with their begin, tombstones, bitmaps; in buckets of subject and predicate."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        super().__init__(spark, path, f"s string, p string, o string, begins {ORDER}", KEY, PAIR, ["begins"], PAIR, buckets)

    def state(self) -> dict:
        return {"tombs": {}, **super().state()}

    def read(self) -> DataFrame:
        """The triples that are in the table now."""
        rows = self.live(self.state())
        return self.spark.createDataFrame([], "s string, p string, o string") if rows is None else rows.select(*KEY)

    def apply(self, feed: DataFrame) -> None:
        """Apply one batch of the feed; publishing the state is the commit."""
        self.change(lambda state, tag: self._apply(feed, state, tag))

    def _apply(self, feed: DataFrame, state: dict, tag: str) -> bool:
        steps = f"{self.path}/steps/{tag}"
        events(feed).select(*KEY, "begins", "ends", *hashed(KEY), *hashed(PAIR, GROUP)).write.parquet(steps)
        batch = self.spark.read.schema(STEP).parquet(steps)
        hit = [r.bucket for r in batch.select(self.bucket()).distinct().collect()]  # at most `buckets` rows
        if not hit:
            drop_path(self.spark, steps)
            return False

        # tombstones: those of the batch are added to those of its buckets
        ends = batch.where("ends IS NOT NULL").select(*HASH, *GROUP, F.col("o").isNull().alias("whole"), "ends", self.bucket())
        self.add(state, "tombs", f"tombs/{tag}", self.write(ends, f"tombs/{tag}"))
        tombs = self.load(state, "tombs", TOMB, hit)

        # images of the batch's keys, located by the index
        index = self.index(state, hit)
        fresh = batch.where("begins IS NOT NULL").select(*KEY, *HASH, *GROUP, "begins")
        found = None
        if index is not None:
            changed = batch.where("o IS NOT NULL").select(*HASH, F.col("begins").alias("new_begins"), "ends")
            found = index.join(broadcast_if_small(changed), HASH)
            found.write.mode("overwrite").parquet(f"{steps}-found")
            found = self.spark.read.parquet(f"{steps}-found")
            later = found.where("begins >= new_begins").select(*HASH).distinct()  # there already, or begun again later
            fresh = fresh.join(broadcast_if_small(later), HASH, "left_anti")
        if tombs is not None:  # a begin that an end follows, whichever arrived first
            ended = tombs.where("NOT whole").groupBy(*HASH).agg(F.max("ends").alias("ends"))
            fresh = fresh.join(broadcast_if_small(ended), HASH, "left").where("ends IS NULL OR ends < begins").drop("ends")
            whole = tombs.where("whole").groupBy(*GROUP).agg(F.max("ends").alias("ends"))
            fresh = fresh.join(broadcast_if_small(whole), GROUP, "left").where("ends IS NULL OR ends < begins").drop("ends")
        if index is not None:
            over = F.greatest(F.col("new_begins"), F.col("ends"))
            gone = found.where(over > F.col("begins")).select("bucket", "file", "place")
            wiped = batch.where("o IS NULL AND ends IS NOT NULL").select(*GROUP, "ends")
            gone = gone.unionByName(index.join(broadcast_if_small(wiped), GROUP).where("ends > begins").select("bucket", "file", "place"))
            self.mark(state, gone, tag)
        self.append(state, fresh, tag)
        self._merge_tombs(state, tag)
        self.compact(state, tag)
        drop_path(self.spark, steps)
        drop_path(self.spark, f"{steps}-found")
        return True

    def _merge_tombs(self, state: dict, tag: str) -> None:
        many = [b for b, dirs in state["tombs"].items() if len(dirs) > COMPACT_AFTER]
        if many:
            merged = self.load(state, "tombs", TOMB, many).groupBy(*HASH, *GROUP, "whole").agg(F.max("ends").alias("ends"))
            merged = merged.withColumn("bucket", F.pmod("g1", F.lit(self.buckets)).cast("int"))  # g1 is the hash that chose the bucket
            self.write(merged, f"tombs/{tag}-compact")
            for b in many:
                state["tombs"][b] = [f"tombs/{tag}-compact/bucket={b}"]
