"""Transitive closure of an edge table by semi-naive iteration.

Spark's recursive queries have no distinct union, so cycles would never end.  Here each round joins only
the pairs that the last round found, and drops those already known; the lineage is cut by tables in the
shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.scratch import shared_folder
from quillgraph.sources.registry import Edge, Graph


def stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(pairs: DataFrame, start: Column | None = None, end: Column | None = None, store=None) -> DataFrame:
    """(src, dst) with a path of at least one edge; only from ``start`` or to ``end`` where given."""
    store = store or stored
    edges = store(pairs.select("src", "dst").distinct())
    backwards = start is None and end is not None
    if backwards:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = end
    known = store(edges if start is None else edges.filter(F.col("src") == start))
    frontier = known
    step = edges.select(F.col("src").alias("mid"), F.col("dst").alias("next"))
    while not frontier.isEmpty():
        ahead = frontier.join(step, F.col("dst") == F.col("mid")).select("src", F.col("next").alias("dst")).distinct()
        frontier = store(ahead.join(known, ["src", "dst"], "left_anti"))
        known = known.unionByName(frontier)
    if backwards:
        known = known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return known


Step = tuple[str, str, DataFrame]
"""The classes at both ends, and pairs (a, b) of native keys."""


def reachable_by_class(steps: list[Step], loops: list[Step], start: dict[str, DataFrame], known: dict[str, DataFrame], store=None) -> dict[str, DataFrame]:
    """k of every node, by its class, at the end of at least one step from ``start`` (or in ``known``).

    Steps are read from their tables in each round and never stored: a round moves its new nodes, and rows of a
    step only where these are too many to be broadcast.  ``loops`` lead from nodes to themselves: they are
    asked for the start alone.
    """
    store = store or stored
    frontier, known, steps, later = start, dict(known), steps + loops, steps
    while frontier:
        ahead: dict[str, DataFrame] = {}
        for a, b, pairs in steps:
            if a in frontier:
                found = pairs.join(frontier[a], F.col("a") == F.col("k"), "left_semi").select(F.col("b").alias("k"))
                ahead[b] = ahead[b].unionByName(found) if b in ahead else found
        frontier, steps = {}, later
        for c, found in ahead.items():
            new = found.distinct()
            new = store(new.join(known[c], "k", "left_anti") if c in known else new)
            if not new.isEmpty():
                frontier[c] = new
                known[c] = known[c].unionByName(new) if c in known else new
    return known


class Between:
    """Nodes of a class whose key is made of its table's columns, in paths that only pass from some of these columns to others.

    A row that is entered by one column and left by another is one step between their nodes, so the long keys are not
    moved while the path is followed.  Where texts are null or hold the separator, keys of unlike rows may be the
    same: the rows of such keys are joined by key.
    """

    def __init__(self, g: Graph, cls: str, ways: list[tuple[Edge, bool]], store=None):
        self.cls, self.rows = cls, g.scan(ways[0][0].table, ways[0][0].key)
        self.value = g.value
        self.ins = [e for e, inverse in ways if inverse]
        self.outs = [e for e, inverse in ways if not inverse]
        parts = [F.expr(c) for c in g.classes[cls].parts]
        odd = self.rows.filter(reduce(lambda p, q: p | q, (c.isNull() | ((c < 0.001) & F.contains(c.cast("string"), F.lit("-"))) for c in parts)))
        self.odd = None if odd.isEmpty() else (store or stored)(odd.select("key_").distinct())
        self.store = store or stored

    def _pairs(self, i: Edge, o: Edge) -> DataFrame:
        pair = lambda df: df.select(self.value(i).alias("a"), self.value(o).alias("b")).filter("a is not null and b is not null")
        if self.odd is None:
            return pair(self.rows)
        mixed = self.rows.join(self.odd, "key_", "left_semi")
        ends = mixed.select("key_", self.value(i).alias("a")).join(mixed.select("key_", self.value(o).alias("b")), "key_").select("a", "b").filter("a is not null and b is not null")
        return self.store(pair(self.rows.join(self.odd, "key_", "left_anti")).unionByName(ends))

    def steps(self) -> tuple[list[Step], list[Step]]:
        """The steps, and those that lead from nodes to themselves."""
        pairs = [(i, o) for i in self.ins for o in self.outs]
        return [(i.target, o.target, self._pairs(i, o)) for i, o in pairs if i != o or self.odd is not None], [(i.target, i.target, self._pairs(i, i)) for i, o in pairs if i == o and self.odd is None]

    def leave(self, key: Column) -> dict[str, DataFrame]:
        """k, by class, of the nodes that one node of this class leads to."""
        out: dict[str, DataFrame] = {}
        for o in self.outs:
            ends = self.rows.filter(F.col("key_") == key).select(self.value(o).alias("k")).filter("k is not null")
            out[o.target] = out[o.target].unionByName(ends) if o.target in out else ends
        return {c: self.store(df.distinct()) for c, df in out.items()}

    def entered(self, reached: dict[str, DataFrame]) -> DataFrame | None:
        """k of the nodes of this class that what is reached leads to, each once.

        A column that is both entered and left by tells by itself, where it is not null.
        """
        both = next((e for e in self.ins if e in self.outs), None)
        rows, found = self.rows, []
        for e in [*([both] if both else []), *(e for e in self.ins if e != both)]:
            mine = rows.select(self.value(e).alias("at_"), F.col("key_").alias("k_"))
            if e.target in reached:
                # equal keys have equal values, so they are together after the join
                found.append(mine.join(reached[e.target], F.col("at_") == F.col("k"), "left_semi").distinct().select(F.col("k_").alias("k")))
            if e == both:
                if self.odd is None:
                    break
                rows = rows.filter(self.value(e).isNull())
        if not found:
            return None
        return found[0] if len(found) == 1 and self.odd is None else reduce(DataFrame.unionByName, found).distinct()


def reachable_from(g: Graph, ways: list[tuple[Edge, bool]], cls: str, key: Column, store=None) -> dict[str, DataFrame]:
    """k (native keys) of what one node leads to, by class, over edges or (where marked) their inverses."""
    between: dict[str, Between] = {}
    for c in {e.cls for e, _ in ways}:
        mine = [(e, inverse) for e, inverse in ways if e.cls == c]
        if len({(e.table, e.key) for e, _ in mine}) == 1 and all(e.column in g.classes[c].parts for e, _ in mine) and not any(e.target == c for e, _ in ways):
            between[c] = Between(g, c, mine, store)
    steps: list[Step] = []
    loops: list[Step] = []
    for b in between.values():
        more, own = b.steps()
        steps, loops = steps + more, loops + own
    for e, inverse in ways:
        if e.cls not in between:
            a, b = (g.value(e), F.col("key_")) if inverse else (F.col("key_"), g.value(e))
            pairs = g.scan(e.table, e.key).select(a.alias("a"), b.alias("b")).filter("a is not null and b is not null")
            steps.append((e.target, e.cls, pairs) if inverse else (e.cls, e.target, pairs))
    if cls in between:
        first = between[cls].leave(key)
        reached = reachable_by_class(steps, [], first, first, store)
        seeds: dict[str, DataFrame] = {}
    else:
        seeds = {cls: g.spark.range(1).select(key.alias("k"))}
        reached = reachable_by_class(steps, loops, seeds, {}, store)
    # the start leads to the nodes between as well, even where it is not reached itself
    ends = {c: df if c not in seeds else df.unionByName(seeds[c]) for c, df in {**seeds, **reached}.items()}
    for c, b in between.items():
        nodes = b.entered(ends)
        if nodes is not None:
            reached[c] = nodes
    return reached
