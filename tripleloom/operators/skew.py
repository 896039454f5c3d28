"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows are numbered in (key, order) by ``number_rows``: counts by partition, prefix sums, index in the partition.  Rows
are then processed in chunks of equal size, whatever keys they belong to: a row's number divided by the chunk's size
decides its task.  A chunk gives a small state for each key in it; the states of a key that goes over a chunk's end are
merged in the order of their first positions.  No task ever holds a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import partitions, stored
from .numbering import Numbered, number_rows

CHUNK_ROWS = 1 << 16


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it; the first is True."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk after another, each as one batch; the rows come in order."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            chunk = b.column("chunk")
            if held and held[-1].column("chunk")[0] != chunk[0]:
                yield _one(held)
                held = []
            same = int(np.searchsorted(chunk.to_numpy(), chunk[0].as_py(), "right"))
            held.append(b.slice(0, same))
            b = b.slice(same)
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def chunk_states(numbered: Numbered, key: str, columns: list[str], fn: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``fn(rows, starts)`` for every chunk of ``chunk_rows`` consecutive numbers; ``starts`` has the offsets in the chunk
    at which a key begins.

    The number alone decides a row's chunk, and chunks are spread evenly over the tasks, so no task has more rows than
    another whatever the keys; a key that goes over a chunk's end has states that must be merged.  Of the rows only
    ``key``, ``columns`` and ``pos`` are moved.
    """
    spark = numbered.df.sparkSession
    rows = numbered.df.select(key, *columns, "pos").withColumn("chunk", F.floor(F.col("pos") / chunk_rows))
    tasks = max(1, min(-(-numbered.rows // chunk_rows), max(partitions(spark), numbered.rows // (16 * chunk_rows))))
    spread = rows.repartition(tasks, F.col("chunk")).sortWithinPartitions("chunk", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            yield fn(b, np.flatnonzero(_changes(b.column(key))))

    return spread.mapInArrow(run, schema)


def _run_states(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """States of segments of (p, s) rows: the runs of equal subjects at both edges, and the longest run between.

    ``edge`` runs may go on in the neighbouring segment; inner runs are complete.
    """
    s = b.column("s")
    new = _changes(s)
    new[starts] = True
    runs = np.flatnonzero(new)
    length = np.diff(np.append(runs, b.num_rows))
    segment = np.searchsorted(starts, runs, "right") - 1
    first = np.ones(len(runs), bool)
    first[1:] = segment[1:] != segment[:-1]
    last = np.append(first[1:], True)
    edge = first | last
    inner = np.flatnonzero(~edge)
    # the longest inner run of each segment; of equals the first, which has the smallest subject
    inner = inner[np.lexsort((inner, -length[inner], segment[inner]))]
    keep = np.ones(len(inner), bool)
    keep[1:] = segment[inner[1:]] != segment[inner[:-1]]
    rows = np.concatenate([np.flatnonzero(edge), inner[keep]])
    at = pa.array(runs[rows])
    return pa.RecordBatch.from_arrays([b.column("p").take(at), s.take(at), pa.array(length[rows].astype(np.int64)), pa.array(edge[rows])], names=["p", "s", "n", "edge"])


def top_subjects(triples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For each predicate the subject with the most distinct objects, of equals the smallest: (p, s, n).

    Rows with a NULL in ``p``, ``s`` or ``o`` do not count; repeated triples count once, extra columns are ignored; an
    empty table gives no rows.
    """
    distinct = triples.select("p", "s", "o").dropna().distinct()
    states = stored(chunk_states(number_rows(distinct, "p", "s", "o"), "p", ["s"], _run_states, "p string, s string, n bigint, edge boolean", chunk_rows), "states")
    edges = states.where("edge").groupBy("p", "s").agg(F.sum("n").alias("n"))
    runs = states.where("NOT edge").select("p", "s", "n").unionByName(edges)
    best = runs.groupBy("p").agg(F.min(F.struct((-F.col("n")).alias("n"), "s")).alias("best"))
    return best.select("p", F.col("best.s").alias("s"), (-F.col("best.n")).alias("n"))


def fold_by_key(df: DataFrame, key: str, order: list[str], segment_fn: Callable, merge_fn: Callable, state_schema: str, result_schema: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ordered per-key fold: ``segment_fn(pandas rows) -> dict`` by key and chunk, then ``merge_fn(key, pandas states) -> pandas``.

    The states of one key are rows / ``chunk_rows`` in number and come in order.  NULL keys have no result.
    """
    values = [c for c in df.columns if c != key and c.lower() not in ("pos", "chunk_file", "chunk")]
    numbered = number_rows(df.where(F.col(key).isNotNull()).select(key, *values), key, *order)

    def states(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        pdf = b.to_pandas()
        rows = []
        for i, j in zip(starts, np.append(starts[1:], len(pdf))):
            part = pdf.iloc[i:j]
            rows.append({key: part[key].iloc[0], "first_pos": int(part["pos"].iloc[0]), **segment_fn(part)})
        names = list(rows[0])
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows]) for n in names], names=names)

    made = chunk_states(numbered, key, values, states, f"{key} {dict(df.dtypes)[key]}, first_pos bigint, {state_schema}", chunk_rows)
    return made.groupBy(key).applyInPandas(lambda k, pdf: merge_fn(k, pdf.sort_values("first_pos")), result_schema)


def _pause_state(part: pd.DataFrame) -> dict:
    at = part["at"].to_numpy(np.int64)
    return {"first": int(at[0]), "last": int(at[-1]), "pause": int(np.diff(at).max(initial=0))}


def _longest_pause(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
    between = states["first"].to_numpy()[1:] - states["last"].to_numpy()[:-1]
    return pd.DataFrame({"p": [key[0]], "pause": [max(int(states["pause"].max()), int(between.max(initial=0)))]})


def longest_pauses(triples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For each predicate the longest time in microseconds between one load and the next: (p, pause); 0 if there is one.

    Rows with a NULL in ``p`` or ``loaded_at`` do not count; an empty table gives no rows.
    """
    rows = triples.select("p", F.unix_micros("loaded_at").alias("at")).dropna()
    return fold_by_key(rows, "p", ["at"], _pause_state, _longest_pause, "first bigint, last bigint, pause bigint", "p string, pause bigint", chunk_rows)
