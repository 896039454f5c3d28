"""Continuous versions: closure of a stream of triples, state and history of streams of changes.

Every sink is a ``foreachBatch`` whose effect does not change when a batch is delivered again, so with a checkpointed
source the result is that of exactly one delivery.  There are no watermarks: any old fact may take part in a derivation,
and changes carry their own order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.changes import DeltaVectorTable
from ..operators.history import ChainStore
from ..plans.reasoner import closure
from ..plans.rules import Rule


class ClosedTable:
    """A closed set of triples at ``path``: each batch appends what it adds to the closure."""

    def __init__(self, spark: SparkSession, path: str, rules: Sequence[Rule]):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def read(self, before: int | None = None) -> DataFrame:
        """All triples, or those of the batches before a batch."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "s string, p string, o string")
        kept = self.spark.read.schema("s string, p string, o string, batch bigint").parquet(self.path)
        return (kept if before is None else kept.where(f"batch < {before}")).select("s", "p", "o")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch; the batch's own folder is replaced when it is delivered again."""
        before = self.read(batch_id)
        made = closure(batch, self.rules, base=before).triples.select("s", "p", "o").join(before, ["s", "p", "o"], "left_anti")
        made.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def stream_closure(triples: DataFrame, table: ClosedTable, checkpoint: str, **trigger):
    return triples.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_changes(feed: DataFrame, table: DeltaVectorTable, checkpoint: str, **trigger):
    """A feed of changes into a delete-vector table; repeated batches are repeated changes, which count once."""
    return feed.writeStream.foreachBatch(lambda batch, _: table.apply(batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_history(rows: DataFrame, log: DataFrame | Callable[[], DataFrame], store: ChainStore, checkpoint: str, **trigger):
    """Sightings into a store of validity periods.

    A log that grows is given as a function, called for each batch: a table read once keeps the list of its files.
    """
    current = log if callable(log) else lambda: log
    return rows.writeStream.foreachBatch(lambda batch, _: store.apply(batch, current())).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
