"""Top-k by cosine similarity over precomputed vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Queries in a block, targets compared with it at once, and cells of a piece of their product.
BLOCK_QUERIES = 4096
CHUNK_TARGETS = 8192
CELLS = 1 << 21


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def mean_pooled(vectors: Column) -> Column:
    """The mean of an array of vectors, scaled to length 1."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(n - 1, F.lit(0))), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    mean = F.transform(total, lambda x: x / n)
    return F.transform(mean, lambda x: F.coalesce(F.try_divide(x, F.sqrt(dot(mean, mean))), F.lit(0.0)))


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length; without nulls, vectors with a null, and zeros.  Rows have length 1."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors)
    start = np.cumsum(size) - size
    nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = (size > 0) & (nulls[start + size] == nulls[start])
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[whole]).tolist():
        at = np.flatnonzero(whole & (size == n))
        m = values[start[at][:, None] + np.arange(n)]
        norm = np.sqrt((m * m).sum(axis=1))
        ok = norm != 0
        out[n] = at[ok], m[ok] / norm[ok][:, None]
    return out


def _best(block, ids: pa.Array, vectors: pa.Array, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, target, similarity) of the k targets nearest to each query of a block; ids are ascending."""
    n_queries, by_length = block
    targets, n = _by_length(vectors), len(ids)
    scale, step, few = 10**digits, max(1, CELLS // n), min(k, n)
    places = n - 1 - np.arange(n)
    out = []
    for lo in range(0, n_queries, step):
        hi = min(lo + step, n_queries)
        sim = np.zeros((hi - lo, n))
        for size, (where, m) in by_length.items():
            part = slice(*np.searchsorted(where, [lo, hi]))
            if size in targets and part.stop > part.start:
                cols, t = targets[size]
                sim[np.ix_(where[part] - lo, cols)] = m[part] @ t.T
        nan = np.isnan(sim)
        level = np.floor(np.abs(np.where(nan, 0, sim)) * scale + 0.5).astype(np.int64) * np.where(sim < 0, -1, 1)
        level[nan] = 2 * scale  # not a number stands above all others
        # level and place in one number: no ties are left
        top = np.argpartition(-(level * n + places), few - 1, axis=1)[:, :few]
        row = np.repeat(np.arange(hi - lo), few)
        col = top.reshape(-1)
        out.append((row + lo, col, np.where(nan[row, col], np.nan, level[row, col] / scale)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(queries: DataFrame) -> Iterator[list]:
    rows = queries.toLocalIterator()
    while held := list(islice(rows, BLOCK_QUERIES)):
        yield held


def top_k(queries: DataFrame, targets: DataFrame, query_id: str, query_vec: str, target_id: str, target_vec: str, k: int, digits: int = 6) -> DataFrame:
    """The k targets most similar to each query: query id, target id, similarity, rank; ties by target id.

    Queries go in blocks of bounded size, each in turn to every target, so there may be any number of them.
    Each chunk of targets keeps k rows a query, which bounds what the ranking sees.  The work is that of all
    pairs.
    """
    spark = targets.sparkSession
    q = queries.select(F.col(query_id).alias("q_"), F.col(query_vec).alias("qv_"))
    t = targets.select(F.col(target_id).alias("t_"), F.col(target_vec).alias("tv_"))
    schema = T.StructType([T.StructField("q_", q.schema["q_"].dataType), T.StructField("t_", t.schema["t_"].dataType), T.StructField("similarity", T.DoubleType())])
    id_type = to_arrow_type(q.schema["q_"].dataType)

    def against(block):
        def run(batches):
            names, (n, by_length) = block.value

            def answer(held):
                part = pa.Table.from_batches(held).combine_chunks()
                part = part.take(pc.sort_indices(part, sort_keys=[("t_", "ascending")], null_placement="at_start")).combine_chunks()
                ids, vectors = (part.column(c).chunk(0) for c in ("t_", "tv_"))
                row, col, sim = _best((n, by_length), ids, vectors, k, digits)
                for lo in range(0, len(row), 1 << 16):
                    s = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row[s])), ids.take(pa.array(col[s])), pa.array(sim[s], pa.float64())], names=["q_", "t_", "similarity"])

            held, rows = [], 0
            for batch in batches:
                for lo in range(0, batch.num_rows, CHUNK_TARGETS):
                    held.append(batch.slice(lo, CHUNK_TARGETS))
                    rows += held[-1].num_rows
                    if rows >= CHUNK_TARGETS:
                        yield from answer(held)
                        held, rows = [], 0
            if held:
                yield from answer(held)

        return t.mapInArrow(run, schema)

    parts = []
    for rows in _blocks(q):
        vectors = pa.array([r["qv_"] for r in rows], pa.list_(pa.float64()))
        names = pa.array([r["q_"] for r in rows], id_type)
        parts.append(against(spark.sparkContext.broadcast((names, (len(rows), _by_length(vectors))))))
    scored = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    best = Window.partitionBy("q_").orderBy(F.desc("similarity"), "t_")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("q_").alias(query_id), F.col("t_").alias(target_id), "similarity", "rank")
