"""Encoding and decoding of a corpus with a public byte-level BPE.

Map-only: no shuffle (but of scans with fewer partitions than cores), texts stay in Arrow buffers, a worker keeps one transducer for all its tasks.  The vocabulary
file is read by the driver from the ``path`` parameter and sent as a broadcast variable (a few MB, the size of the file).

Defined cases: empty and NULL texts have no ids; special tokens' strings are ordinary text; repeated rows are encoded
each; texts of any length are encoded whole; columns not named are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .bpe import Transducer, Vocabulary, decode_stream

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

_workers: dict[int, Transducer] = {}
_sent: dict[tuple[str, str], object] = {}


def _broadcast(df: DataFrame, path: str):
    context = df.sparkSession.sparkContext
    key = (context.applicationId, path)
    if key not in _sent:
        _sent[key] = context.broadcast(Vocabulary.load(path))
    return _sent[key]


def _transducer(sent) -> Transducer:
    key = id(sent.value)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Transducer(sent.value)
    return _workers[key]


def _texts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return spread(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text_")))


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array of int) of the column ``text``."""
    rows, sent = _texts(df, text, keep), _broadcast(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(sent)
        for b in batches:
            at = 0
            for ids, counts in machine.encode_texts(b.column("text_")):
                part = b.slice(at, len(counts))
                at += len(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists], names=[*keep, "ids"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.select(*[f"`{c}`" for c in keep]).dtypes)
    return rows.mapInArrow(run, f"{kinds}, ids array<int>")


def count(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens`` (bigint), the number of ids of the column ``text``."""
    rows, sent = _texts(df, text, keep), _broadcast(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(sent)
        for b in batches:
            counts = [c for _, c in machine.encode_texts(b.column("text_"))]
            total = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(total, pa.int64())], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.select(*[f"`{c}`" for c in keep]).dtypes)
    return rows.mapInArrow(run, f"{kinds}, tokens bigint")


def decode(df: DataFrame, keep: list[str], ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``text``, the text of the column ``ids``; NULL ids give an empty text."""
    rows, sent = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("ids_")), _broadcast(df, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = sent.value.tokens
        for b in batches:
            texts = ["".join(decode_stream(tokens, x)) if x is not None else "" for x in b.pop("ids_")]
            yield b.assign(text=pd.Series(texts, dtype=object, index=b.index))

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.select(*[f"`{c}`" for c in keep]).dtypes)
    return rows.mapInPandas(run, f"{kinds}, text string")
