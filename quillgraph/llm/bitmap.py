"""Bitmaps of hashed keys: what keeps rows that a join cannot match from being shuffled.

A bitmap takes 16 bits a key, between 128 KB and 128 MB.  With more keys than that it lets more rows pass,
and the join behind it drops them: it decides nothing by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm import text as tx

#: Least and most bits of a bitmap.
BITS = (1 << 20, 1 << 30)
#: Pieces in which a bitmap is gathered.
PIECES = 64


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of the first column of ``keys``, 64-bit integers."""
    name = keys.columns[0]
    low, high = BITS
    bits = min(high, max(low, 1 << (16 * keys.count()).bit_length()))
    step = bits // PIECES

    def mark(batches):
        at = [_place(batch.column(name).to_numpy(), bits) for batch in batches]
        at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
        for p, own in enumerate(np.split(at, np.searchsorted(at, np.arange(1, PIECES) * step))):
            if len(own):
                part = np.zeros(step, np.uint8)
                part[own - p * step] = 1
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(np.packbits(part).tobytes(), 1)])], names=["piece", "bits"])

    def join(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column("piece").to_pylist(), batch.column("bits"), strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
                total[p] = total[p] | part if p in total else part
        for p, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=["piece", "bits"])

    rows = keys.select(name).mapInArrow(mark, "piece int, bits binary").repartition("piece").mapInArrow(join, "piece int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():  # at most PIECES rows
        out[r.piece * step // 8 : (r.piece + 1) * step // 8] = np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return out


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (tx.mix(keys.astype(np.int64).view(tx.U)) % tx.U(bits)).astype(np.int64)


def present(keys: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """False for each key that is surely not in the bitmap."""
    at = _place(keys, 8 * len(marked))
    return (marked[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def may_hold(spark, marked: np.ndarray):
    """A function of a column of 64-bit integers without nulls, for filters: whether the bitmap may hold it."""
    from pyspark.sql import functions as F

    shared = spark.sparkContext.broadcast(marked)

    @F.pandas_udf("boolean")
    def may(x):
        import pandas as pd

        return pd.Series(present(x.to_numpy(), shared.value))

    return may
