"""History of changing facts: validity periods built from periodic snapshots and kept by affected-chain rebuild.

A *chain* is the ordered list of periods of one triple of one graph.  ``build_chains`` and ``history`` make all chains
in one pass.  ``ChainStore`` keeps raw sightings and chains in the shared folder, in hash buckets: late or corrected
sightings rebuild only the chains they affect, from those triples' raw sightings, and replace them atomically.
``corrected`` loads the sightings in time into a store and the late ones on top.

Defined cases: rows with a NULL graph, version, subject, predicate or object show nothing.  Repeated rows count once.
A graph without log rows has no complete snapshot, so its periods never end.  ``"x"^^xsd:string`` and ``"x"`` are one
term.  Extra columns are ignored.  An empty snapshot table has no chains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import plain_string
from ..runtime import broadcast_if_small, drop_path
from .vectors import HASH, VectorTable, hashed

KEY = ["graph_name", "s", "p", "o"]
OPEN = -1
RAW = "graph_name string, s string, p string, o string, seen array<int>"
CHAINS = "graph_name string, s string, p string, o string, valid_from int, valid_to int"
PROOFS = "graph_name string, proofs array<int>"


def sightings(rows: DataFrame) -> DataFrame:
    """One row per triple with the sorted versions that show it; pre-aggregated before the shuffle, so a triple that
    is repeated without end is no heavier than its number of versions."""
    shown = rows.select("graph_name", "s", "p", plain_string(F.col("o")).alias("o"), F.col("version").cast("int").alias("version")).dropna()
    return shown.groupBy(*KEY).agg(F.array_sort(F.collect_set("version")).alias("seen"))


def complete_versions(log: DataFrame) -> DataFrame:
    """One row per graph: its complete snapshots in order."""
    return log.where("complete AND graph_name IS NOT NULL AND version IS NOT NULL").groupBy("graph_name").agg(F.array_sort(F.collect_set(F.col("version").cast("int"))).alias("proofs"))


def chains(seen: DataFrame, log: DataFrame) -> DataFrame:
    """Periods of the triples of ``sightings``: (graph_name, s, p, o, valid_from, valid_to)."""
    proofs = broadcast_if_small(complete_versions(log))
    marked = seen.join(proofs, "graph_name", "left").withColumn("proofs", F.coalesce("proofs", F.array().cast("array<int>")))
    marked = marked.select(*KEY, F.transform("seen", lambda v: F.struct(v.alias("v"), F.get(F.filter("proofs", lambda c: c > v), F.lit(0)).alias("gone"))).alias("marks"))

    def begins(x, i):
        return (i == 0) | F.coalesce(F.get("marks", i - 1)["gone"] < x["v"], F.lit(False))

    def ends(x, i):
        return (i == F.size("marks") - 1) | F.coalesce(x["gone"] < F.get("marks", i + 1)["v"], F.lit(False))

    periods = F.zip_with(F.filter("marks", begins), F.filter("marks", ends), lambda a, b: F.struct(a["v"].alias("valid_from"), F.coalesce(b["gone"], F.lit(OPEN)).alias("valid_to")))
    return marked.select(*KEY, F.inline(periods))


def build_chains(rows: DataFrame, log: DataFrame) -> DataFrame:
    return chains(sightings(rows), log)


def with_late(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows with ``late``: whether they were loaded after a later snapshot of their graph had been taken."""
    taken = log.where("taken_at IS NOT NULL AND version IS NOT NULL").groupBy("graph_name").agg(F.collect_set(F.struct("version", "taken_at")).alias("taken"))
    marked = rows.join(broadcast_if_small(taken), "graph_name", "left")
    late = F.exists("taken", lambda t: (t["version"] > F.col("version")) & (t["taken_at"] <= F.col("loaded_at")))
    return marked.withColumn("late", F.coalesce(late, F.lit(False))).drop("taken")


def rebuild_affected(both: DataFrame, log: DataFrame) -> DataFrame:
    """All chains of (graph_name, s, p, o, seen, changed) after the sightings ``changed`` arrived on top of ``seen``.

    Chains without a change stay as they are; a touched chain is rebuilt as a whole from its triple's raw sightings.
    Both branches read one shuffle.
    """
    touched = F.size(F.coalesce("changed", F.array())) > 0
    kept = chains(both.where(~touched).select(*KEY, "seen"), log)
    raw = F.array_sort(F.array_distinct(F.concat(F.coalesce("seen", F.array().cast("array<int>")), F.col("changed"))))
    return kept.unionByName(chains(both.where(touched).select(*KEY, raw.alias("seen")), log))


def history(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Chains of all rows in one pass: both kinds of sightings of a triple are gathered by one aggregate, and late ones
    only choose the branch; no earlier chains are kept or replaced (see ``corrected``)."""
    marked = with_late(rows.select("graph_name", "version", "s", "p", "o", "loaded_at"), log)
    shown = marked.select("graph_name", "s", "p", plain_string(F.col("o")).alias("o"), F.col("version").cast("int").alias("version"), "late").dropna()
    of = lambda late: F.array_sort(F.collect_set(F.when(F.col("late") == late, F.col("version"))))
    return rebuild_affected(shown.groupBy(*KEY).agg(of(False).alias("seen"), of(True).alias("changed")), log)


def as_of(periods: DataFrame, version: int) -> DataFrame:
    return periods.where((F.col("valid_from") <= version) & ((F.col("valid_to") == OPEN) | (F.col("valid_to") > version)))


class ChainStore(VectorTable):
    """Raw sightings, proofs and chains at ``path``, in hash buckets of the triple.

    ``apply`` takes a batch of sightings and the whole log as known then.  Touched are the triples that the batch shows
    and, as a period ends by absence, those with an open period in graphs with new complete snapshots (all of a graph's
    if its complete snapshots changed otherwise).  They are located in the index of chains, their raw sightings are
    fetched, all their periods are rebuilt and appended, and their old periods are marked in delete vectors; no other
    chain is read or written.  Publishing the state is the commit: a reader sees all of a batch or nothing of it, and a
    batch that is applied again changes nothing.  A log that changed without sightings is applied with an empty batch.
    """

    def __init__(self, spark, path: str, buckets: int = 8):
        super().__init__(spark, path, CHAINS, KEY, KEY, ["graph_name", "valid_to"], (), buckets)

    def state(self) -> dict:
        return {"raw": {}, "proofs": None, **super().state()}

    def _moved(self, state: dict, proofs: DataFrame) -> DataFrame:
        """(graph_name, all_): graphs whose complete snapshots changed, and whether not only by later ones."""
        if state["proofs"] is None:
            return proofs.select("graph_name", F.lit(True).alias("all_"))
        old = self.spark.read.schema(PROOFS).parquet(f"{self.path}/{state['proofs']}").withColumnRenamed("proofs", "before")
        both = old.join(proofs, "graph_name", "full").where(~F.col("before").eqNullSafe(F.col("proofs")))
        size = F.coalesce(F.size("before"), F.lit(0))
        later = F.col("proofs").isNotNull() & (F.slice("proofs", F.lit(1), size) == F.coalesce("before", F.array().cast("array<int>")))
        return both.select("graph_name", (~later | F.col("before").isNull()).alias("all_"))

    def apply(self, rows: DataFrame, log: DataFrame) -> None:
        self.change(lambda state, tag: self._apply(rows, log, state, tag))

    def _apply(self, rows: DataFrame, log: DataFrame, state: dict, tag: str) -> bool:
        shown = self.write(sightings(rows).withColumn("bucket", self.bucket()), f"raw/{tag}")
        proof_dir = f"proofs/{tag}"
        complete_versions(log).write.mode("overwrite").parquet(f"{self.path}/{proof_dir}")
        proofs = self.spark.read.schema(PROOFS).parquet(f"{self.path}/{proof_dir}")
        log = proofs.select("graph_name", F.explode("proofs").alias("version"), F.lit(True).alias("complete"))  # the log as written, should it grow meanwhile
        moved = self._moved(state, proofs)
        index = self.index(state)
        new = {"raw": {}}
        self.add(new, "raw", f"raw/{tag}", shown)
        batch = self.load(new, "raw", RAW)
        if index is None:  # the first sightings: all chains are new
            if batch is None and state["proofs"] is None and proofs.isEmpty():
                return False
            if batch is not None:
                self.append(state, chains(batch, log), tag)
        else:
            touched = [index.join(broadcast_if_small(moved), "graph_name").where("all_ OR valid_to = -1").select(*HASH, "bucket")]
            if batch is not None:
                touched.append(batch.select(*hashed(KEY), self.bucket()))
            located = f"{self.path}/steps/{tag}"
            reduce(DataFrame.unionByName, touched).distinct().write.mode("overwrite").parquet(located)
            keys = self.spark.read.schema("k1 bigint, k2 bigint, bucket int").parquet(located)
            hit = [r.bucket for r in keys.select("bucket").distinct().collect()]  # at most `buckets` rows
            if not hit and new["raw"] == {} and moved.isEmpty():
                drop_path(self.spark, located)
                return False
            if hit:
                few = broadcast_if_small(keys.select(*HASH))
                self.mark(state, self.index(state, hit).join(few, HASH, "left_semi").select("bucket", "file", "place"), tag) if self.paths(state, "index", hit) else None
                raw = self.load(state, "raw", RAW, hit)
                raw = None if raw is None else raw.select("*", *hashed(KEY)).join(few, HASH, "left_semi").select(*KEY, "seen")
                raw = batch if raw is None else raw if batch is None else raw.unionByName(batch)
                # raw sightings of several batches are one list
                merged = raw.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"))
                self.append(state, chains(merged, log), tag)
            drop_path(self.spark, located)
        self.add(state, "raw", f"raw/{tag}", shown)
        state["proofs"] = proof_dir
        self.compact(state, tag)
        return True

    def read(self) -> DataFrame | None:
        return self.live(self.state())


def corrected(store: ChainStore, rows: DataFrame, log: DataFrame) -> DataFrame:
    """Chains of all rows from ``store``: those in time are loaded, then the late ones correct the chains they affect."""
    marked = with_late(rows.select("graph_name", "version", "s", "p", "o", "loaded_at"), log)
    store.apply(marked.where("NOT late"), log)
    store.apply(marked.where("late"), log)
    read = store.read()
    return store.spark.createDataFrame([], CHAINS) if read is None else read
