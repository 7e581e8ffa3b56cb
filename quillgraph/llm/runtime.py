"""Session plumbing shared by the corpus operators.

Lineage is cut with ordinary Parquet tables in the folder that the driver and every executor can reach, so
a lost executor costs a re-read and never a recomputation of the whole chain.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgraph.scratch import shared_folder

#: Rows and bytes of an Arrow batch: texts are long, so the bytes bound the memory of a batch of them, and the
#: rows that of narrow tables.  A row that is longer is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds the size of the Arrow batches that this session hands to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later stages start from files."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`cut` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path:
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of :func:`fresh`."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unclash(df: DataFrame | list[str], *names: str) -> list[str]:
    """Internal column names based on ``names`` that no column of ``df`` has (case does not count)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def file_system(uri: str):
    """(file system, path) for a URI that every executor can open; works in tasks, without a session."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """The one large object that a Python worker keeps from task to task: a vocabulary, an automaton."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def in_task(run: Callable, keep: str | None = None) -> Callable:
    """A function of batches that leaves little memory behind.

    Workers live on from one operator to the next, so what an earlier one has kept goes first (but for the
    object ``keep``), and memory that a task has freed goes back to the system when it ends.
    """

    def wrapped(batches):
        if any(k != keep for k in _HELD):
            _HELD.clear()
            gc.collect()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped
