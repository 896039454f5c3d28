"""Tables of append-only files with delete vectors, a key index, and states that are published atomically.

Rows lie in hash buckets (folders) of append-only Parquet files.  Beside them an index has, also by bucket, the 128-bit
hash of each row's key, the columns that decide what supersedes it, and the row's file and position.  Rows that are
superseded are marked in bitmaps by file; readers filter positions by the bitmaps.  A state (which folders count) is one
small file that is written once: of two writers of one version the second fails and must try again on the new state.
What a change costs depends on the buckets it touches and on what it matches there, not on the size of the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small

#: States kept for readers that still use them.
STATES_KEPT = 10
#: Folders of a bucket's rows beyond which a writer merges them.
COMPACT_AFTER = 16
HASH = ["k1", "k2"]


def _file() -> Column:
    """Folder and name of a row's file; names alone are not unique, as one task writes to several buckets."""
    return F.substring_index("_metadata.file_path", "/", -2).alias("file")


class Conflict(RuntimeError):
    """Another writer has published the version first."""


def bit_is_set(bitmap: Column, place: Column) -> Column:
    """Whether bit ``place`` (0-based, low bits first) of the binary ``bitmap`` is set."""
    bit = F.pmod(place, F.lit(8)).cast("int")
    digits = F.hex(F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1)))
    half = F.instr(F.lit("0123456789ABCDEF"), F.when(bit < 4, F.right(digits, F.lit(1))).otherwise(F.left(digits, F.lit(1)))) - 1
    return F.call_function("shiftright", half, F.pmod(bit, F.lit(4))).bitwiseAND(F.lit(1)) == 1


def hashed(columns: Sequence[str], names: Sequence[str] = HASH) -> list[Column]:
    """Two 64-bit hashes of the columns, together the identity of a key."""
    return [F.xxhash64(*columns).alias(names[0]), F.xxhash64(F.lit("second"), *columns).alias(names[1])]


class Versions:
    """The states of a table at ``path``, in files that are never written twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(path).getFileSystem(self.conf)

    def _all(self) -> list[int]:
        found = self.fs.globStatus(self.hadoop.Path(f"{self.path}/manifest-*.json")) or []
        return sorted(int(f.getPath().getName()[9:-5]) for f in found)

    def latest(self) -> dict | None:
        there = self._all()
        if not there:
            return None
        source = self.fs.open(self.hadoop.Path(f"{self.path}/manifest-{there[-1]}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def publish(self, state: dict) -> None:
        """Make ``state`` the latest; raises ``Conflict`` if its version is there."""
        version = state["version"]
        target, made = self.hadoop.Path(f"{self.path}/manifest-{version}.json"), self.hadoop.Path(f"{self.path}/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(made, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.hadoop.FileContext.getFileContext(target.toUri(), self.conf)
        mode = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 1)
        mode[0] = self.hadoop.Options.Rename.NONE
        try:
            context.rename(made, target, mode)
        except Exception as e:
            self.fs.delete(made, False)
            if self.fs.exists(target):
                raise Conflict(f"version {version} of {self.path} is there") from e
            raise
        for old in self._all()[:-STATES_KEPT]:
            self.fs.delete(self.hadoop.Path(f"{self.path}/manifest-{old}.json"), False)


class VectorTable:
    """Rows of ``schema`` at ``path``; ``key`` columns identify a row, ``spread_by`` choose its bucket, and ``carried``
    columns are kept in the index (with hashes of ``group`` columns, if any)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], spread_by: Sequence[str], carried: Sequence[str] = (), group: Sequence[str] = (), buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.spread_by, self.carried, self.group, self.buckets = list(key), list(spread_by), list(carried), list(group), buckets
        self.versions = Versions(spark, self.path)
        state = self.versions.latest()
        if state:
            self.buckets = state["buckets"]
        empty = spark.createDataFrame([], schema)
        self.columns = empty.columns
        self.index_schema = empty.select(*hashed(self.key), *self._groups(), *self.carried, F.lit("").alias("file"), F.lit(0).cast("bigint").alias("place"), F.lit(0).alias("bucket")).schema

    def state(self) -> dict:
        """The latest state: folders by kind and bucket."""
        return self.versions.latest() or {"version": 0, "buckets": self.buckets, "rows": {}, "index": {}, "bits": {}}

    def _groups(self) -> list[Column]:
        return hashed(self.group, ["g1", "g2"]) if self.group else []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.spread_by), F.lit(self.buckets)).cast("int").alias("bucket")

    def tag(self, state: dict) -> str:
        """Part of the names of a change's folders; no two writers share it."""
        return f"{state['version'] + 1}-{uuid.uuid4().hex[:12]}"

    # -- reading

    def paths(self, state: dict, kind: str, only: Iterable[int] | None = None) -> list[str]:
        wanted = None if only is None else {str(b) for b in only}
        return [f"{self.path}/{d}" for b, dirs in state.get(kind, {}).items() if wanted is None or b in wanted for d in dirs]

    def load(self, state: dict, kind: str, schema, only: Iterable[int] | None = None) -> DataFrame | None:
        paths = self.paths(state, kind, only)
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def index(self, state: dict, only: Iterable[int] | None = None) -> DataFrame | None:
        """Keys and positions of all rows of the buckets, also of those that are gone."""
        return self.load(state, "index", self.index_schema, only)

    def live(self, state: dict, only: Iterable[int] | None = None) -> DataFrame | None:
        """The rows that are not marked as gone."""
        rows = self.load(state, "rows", self.schema, only)
        bits = self.load(state, "bits", "file string, block bigint, bitmap binary", only)
        if rows is None or bits is None:
            return rows
        marked = bits.groupBy("file", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        at = rows.select(*self.columns, _file(), (F.col("_metadata.row_index") + 1).alias("place"))
        at = at.withColumn("block", F.bitmap_bucket_number("place"))
        joined = at.join(broadcast_if_small(marked), ["file", "block"], "left")
        return joined.where(~F.coalesce(bit_is_set(F.col("bitmap"), F.bitmap_bit_position("place")), F.lit(False))).select(*self.columns)

    # -- writing; a change is published by `publish`

    def write(self, df: DataFrame, folder: str, even: bool = True) -> list[int]:
        """``df`` (with ``bucket``) by bucket below ``folder``; the buckets that have rows.

        ``even`` gathers each bucket's rows and splits large buckets, by one shuffle.
        """
        (df.hint("rebalance", "bucket") if even else df).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        found = self.versions.fs.globStatus(self.versions.hadoop.Path(f"{self.path}/{folder}/bucket=*")) or []
        return sorted(int(f.getPath().getName()[7:]) for f in found)

    def add(self, state: dict, kind: str, folder: str, buckets: Iterable[int]) -> None:
        for b in buckets:
            state[kind].setdefault(str(b), []).append(f"{folder}/bucket={b}")

    def append(self, state: dict, rows: DataFrame, tag: str) -> None:
        """Write new rows and their index entries, and name them in ``state``."""
        hit = self.write(rows.select(*self.columns, self.bucket()), f"rows/{tag}")
        if not hit:
            return
        back = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{tag}/bucket={b}" for b in hit])
        entries = back.select(*hashed(self.key), *self._groups(), *self.carried, _file(), (F.col("_metadata.row_index") + 1).alias("place"), self.bucket())
        entries.withColumn("bucket_", F.col("bucket")).write.mode("overwrite").partitionBy("bucket_").parquet(f"{self.path}/index/{tag}")
        self.add(state, "rows", f"rows/{tag}", hit)
        for b in hit:
            state["index"].setdefault(str(b), []).append(f"index/{tag}/bucket_={b}")

    def mark(self, state: dict, gone: DataFrame, tag: str) -> None:
        """Set the bits of ``gone`` (bucket, file, place) and name the bitmaps in ``state``."""
        made = gone.groupBy("bucket", "file", F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
        self.add(state, "bits", f"bits/{tag}", self.write(made, f"bits/{tag}", even=False))

    def compact(self, state: dict, tag: str, only: Iterable[int] | None = None) -> None:
        """Rewrite the live rows of buckets with more than ``COMPACT_AFTER`` folders (or of those named)."""
        many = [int(b) for b, dirs in state["rows"].items() if len(dirs) > COMPACT_AFTER] if only is None else list(only)
        rows = self.live(state, many) if many else None
        if rows is None:
            return
        fresh: dict = {"rows": {}, "index": {}, "bits": {}}
        self.append(fresh, rows, f"{tag}-compact")
        for b in map(str, many):
            for kind in ("rows", "index", "bits"):
                state[kind].pop(b, None)
                if b in fresh[kind]:
                    state[kind][b] = fresh[kind][b]

    def publish(self, state: dict) -> None:
        state["version"] += 1
        self.versions.publish(state)

    def change(self, work: Callable[[dict, str], bool], tries: int = 5) -> None:
        """``work(state, tag)`` alters the state and says whether there is anything to publish; tried again on the new
        state when another writer was first."""
        for attempt in range(tries):
            state = self.state()
            tag = self.tag(state)
            if not work(state, tag):
                return
            try:
                return self.publish(state)
            except Conflict:
                if attempt == tries - 1:
                    raise

    def vacuum(self) -> int:
        """Remove folders that no kept state names; not while another writer is at work.  Returns how many."""
        named = {state_dir for v in self.versions._all() for state_dir in self._named(v)}
        removed = 0
        for kind in self.versions.fs.listStatus(self.versions.hadoop.Path(self.path)):
            if kind.isDirectory():
                for made in self.versions.fs.listStatus(kind.getPath()):
                    for part in self.versions.fs.listStatus(made.getPath()) if made.isDirectory() else []:
                        name = f"{kind.getPath().getName()}/{made.getPath().getName()}/{part.getPath().getName()}"
                        if part.isDirectory() and name not in named:
                            self.versions.fs.delete(part.getPath(), True)
                            removed += 1
        return removed

    def _named(self, version: int) -> set[str]:
        source = self.versions.fs.open(self.versions.hadoop.Path(f"{self.path}/manifest-{version}.json"))
        try:
            state = json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()
        return {d for folders in state.values() if isinstance(folders, dict) for dirs in folders.values() for d in dirs}


__all__ = ["Conflict", "VectorTable", "Versions", "bit_is_set", "hashed"]
