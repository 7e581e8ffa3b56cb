"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many arcs of a 64-bit ring; a key belongs to the arc that its hash falls into.  A shard
takes keys up to its capacity, and the keys beyond it continue clockwise to the next shard with room.
Spark counts keys per arc; the walk around the ring is done on these counts and gives for each arc the ranges
of ranks that each shard takes.  A key's rank within its arc then decides its shard and its slot.  Of many keys
arcs are cut into bins of about BIN_KEYS keys, so that ranking them is many small tasks.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.runtime import unclash

VIRTUAL = 64
#: Keys in a bin (about), and most bins: the counts, and the ranges that are broadcast, are no more than these.
BIN_KEYS, BINS = 1 << 20, 1 << 18


def ring(shards: int, virtual: int = VIRTUAL, cuts: int = 0) -> tuple[list[int], list[int]]:
    """(end of each arc, ascending; its shard).  An arc's keys are those up to its end; the last goes round.

    ``cuts`` places at even distances end an arc as well; the part before them keeps its shard.
    """
    at = {}
    for s in range(shards):
        for v in range(virtual):
            raw = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()
            at.setdefault(int.from_bytes(raw, "little", signed=True), s)
    own = sorted(at)
    even = [(i << 64) // cuts - (1 << 63) for i in range(cuts)]
    ends = sorted({*own, *even})
    return ends, [at[own[bisect.bisect_left(own, e) % len(own)]] for e in ends]


def arc_of(ends: list[int], position: int) -> int:
    return bisect.bisect_left(ends, position) % len(ends)


def capacities(total: int, shards: int) -> list[int]:
    """As even as can be: the first shards hold one row more where the total does not divide."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(owner: list[int], counts: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) of every range of keys.

    Keys stay at home as far as there is room, arc by arc; then what is left of each arc goes clockwise.
    """
    room, out, over = list(capacity), [], deque()
    used = [0] * len(capacity)

    def give(arc: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.append((arc, first, first + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return n

    for arc, n in enumerate(counts):
        took = give(arc, 0, n, owner[arc])
        if took < n:
            over.append((arc, took, n - took))
    around = len(owner)
    skip = [1] * around  # arcs to go on from each, past those of full shards

    def next_with_room(arc: int) -> int:
        at, moved, passed = arc, 0, []
        while moved <= around:
            passed.append((at, moved))
            at, moved = (at + skip[at]) % around, moved + skip[at]
            if room[owner[at]]:
                for p, before in passed:  # rooms only shrink, so later walks may go there at once
                    skip[p] = moved - before
                return at
        raise ValueError("the capacities are less than the keys")

    for arc, first, n in over:
        while n:
            took = give(arc, first, n, owner[next_with_room(arc)])
            first, n = first + took, n - took
    return out


def assign(docs: DataFrame, key_col: str = "doc_id", shards: int = 24, virtual: int = VIRTUAL, tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs``, then ``shard`` and ``slot`` (gapless from 0 within each shard).

    Row counts of shards are at most one apart.  Equal keys share their place on the ring and are ordered
    by ``tie_cols``; rows that are equal in these as well are interchangeable, and each has its own slot.  A
    null key has a place of its own; an empty table has no slots.  No two different keys depend on each other but through full shards.
    """
    cuts = docs.count() // BIN_KEYS
    ends, owner = ring(shards, virtual, min(cuts, BINS) if cuts > shards * virtual else 0)
    place, arc, rank, lo, hi, base, a2 = unclash(docs, "place_", "arc_", "rank_", "lo_", "hi_", "base_", "arc2_")
    shard, slot = unclash(docs, "shard", "slot")
    table = np.array(ends, np.int64)

    @F.pandas_udf("int")
    def find(p):
        import pandas as pd

        return pd.Series((np.searchsorted(table, p.to_numpy()) % len(table)).astype(np.int32))

    keyed = docs.withColumn(place, F.xxhash64(F.col(key_col))).withColumn(arc, find(F.col(place)))
    counts = [0] * len(ends)
    for r in keyed.groupBy(arc).count().collect():  # at most one row for each arc
        counts[r[0]] = r[1]
    ranges = walk(owner, counts, capacities(sum(counts), shards))
    # a shard's ranges are laid out one after another; an arc's ranges are few, so they ride along as literals
    by_arc: dict[int, list] = {}
    for a, first, end, s, b in ranges:
        by_arc.setdefault(a, []).append((first, end, s, b))
    rows = [(a, first, end, s, b) for a, rs in by_arc.items() for first, end, s, b in rs]
    plan = docs.sparkSession.createDataFrame(rows, f"`{a2}` int, `{lo}` long, `{hi}` long, `{shard}` int, `{base}` long")
    order = Window.partitionBy(arc).orderBy(place, F.col(key_col), *(F.col(c) for c in tie_cols))
    ranked = keyed.withColumn(rank, F.row_number().over(order).cast("long") - 1)
    # at most shards x virtual + BINS arcs, and one more range for each shard that fills up: a proven bound
    joined = ranked.join(F.broadcast(plan), (F.col(arc) == F.col(a2)) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    return joined.withColumn(slot, F.col(base) + F.col(rank) - F.col(lo)).select(*docs.columns, shard, slot)
