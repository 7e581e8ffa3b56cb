"""Construction of queries from answers: a beam of query graphs, each step judged by one DataFrame."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import explore
from quillgraph.plans.compiler import Engine
from quillgraph.plans.querygraph import QueryGraph, path_edges
from quillgraph.sources.registry import NS


@dataclass(frozen=True)
class SearchParams:
    """Limits of the search; these are its features, not limits on data."""

    beam: int = 20
    top_relations: int = 10
    max_size: int = 4
    sample_answers: int = 3
    operators: tuple[str, ...] = (">=", ">", "<=", "<")


def comparison_candidates(relations: DataFrame, literals: DataFrame, operators: tuple[str, ...] = SearchParams.operators) -> DataFrame:
    """relation, comparator, literal: every combination (a question has a few of each)."""
    ops = F.explode(F.array(*(F.lit(o) for o in operators)))
    return relations.crossJoin(F.broadcast(literals)).select("relation", ops.alias("comparator"), "literal")


def hits(engine: Engine, graphs: dict[int, QueryGraph], answers: DataFrame) -> DataFrame:
    """id, n_pred, n_hit, n_answers of each graph: one aggregation over the union of their answers."""
    wanted = answers.select(F.col("answer").cast("string").alias("answer")).distinct()
    parts = [engine.sparql(g.to_query()).toDF("pred").select(F.lit(i).alias("id"), F.col("pred").cast("string").alias("pred")) for i, g in graphs.items()]
    every = reduce(DataFrame.unionByName, parts).distinct()
    marked = every.join(wanted.withColumn("hit", F.lit(1)), F.col("pred") == F.col("answer"), "left")
    found = marked.groupBy("id").agg(F.count("*").alias("n_pred"), F.count("hit").alias("n_hit"))
    ids = engine.graph.spark.createDataFrame([(i,) for i in graphs], "id int")
    total = wanted.agg(F.count("*").alias("n_answers"))
    return ids.join(found, "id", "left").crossJoin(F.broadcast(total)).select("id", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "n_answers")


def scored(found: DataFrame) -> DataFrame:
    p, r = F.try_divide("n_hit", "n_pred"), F.try_divide("n_hit", "n_answers")
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return found.select("id", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def is_legal(precision: float, recall: float) -> bool:
    """A graph stays in the beam while it has every answer."""
    return abs(recall - 1) < 1e-6 and precision <= 1 + 1e-6


def atoms(engine: Engine, answers: DataFrame, constants: list[str], params: SearchParams) -> list[QueryGraph]:
    """Graphs of one constant that the sampled answers have: an edge, an edge through an n-ary node, or a comparison."""
    g = engine.graph
    sample = explore.sample_nodes(answers, params.sample_answers)
    n = sample.count()
    out: list[QueryGraph] = []
    numeric: list[str] | None = None
    for c in constants:
        reach = explore.common_relations(explore.relations_to(g, sample, c), n).orderBy("relation").collect()  # of the schema's size
        out += [QueryGraph("x", path_edges("x", r.relation, c, "n")) for r in reach]
        if not c.startswith(NS) and re.match(r'"?[+-]?\d', c):
            if numeric is None:
                ahead = explore.common_relations(explore.next_relations(g, sample, through=False), n)
                kinds = {e.predicate for e in g.edges if e.target in ("int", "dbl", "ts")}
                numeric = sorted(r.relation for r in ahead.collect() if r.relation in kinds)
            out += [QueryGraph("x", [], comparisons=[(r, "x", op, c)]) for r in numeric for op in params.operators]
    return out


def superlatives(engine: Engine, graphs: list[QueryGraph], relations: list[str]) -> list[QueryGraph]:
    return [replace(g, arg=(r, g.center, d)) for g, r, d in itertools.product(graphs, relations, (True, False)) if g.arg is None]


def with_types(graph: QueryGraph, cls: str) -> QueryGraph:
    return replace(graph, types={**graph.types, graph.center: [cls]})


def search(engine: Engine, answers: DataFrame, constants: list[str], params: SearchParams = SearchParams()) -> DataFrame:
    """query, size, precision, recall, f1 of the graphs that have every answer, best first.

    ``answers`` has a column ``answer``.  Level by level: legal graphs are joined with each atom; of each
    level the best ``beam`` by F1 go on.  Sets of constants that failed are not enlarged.
    """
    spark = engine.graph.spark
    cls = sorted({r[0] for r in answers.select(F.regexp_extract("answer", f"^{NS}([^/]+)/", 1)).distinct().limit(2).collect()})
    typed = [with_types(a, cls[0]) if len(cls) == 1 and cls[0] else a for a in atoms(engine, answers, constants, params)]
    level = {a.key(): a for a in typed}
    done: dict[str, tuple[QueryGraph, float, float, float]] = {}
    seeds: list[QueryGraph] = []
    for size in range(1, params.max_size + 1):
        graphs = dict(enumerate(level.values()))
        if not graphs:
            break
        rows = {r.id: r for r in scored(hits(engine, graphs, answers)).collect()}  # one row for each candidate of the beam
        legal = [(graphs[i], r.precision, r.recall, r.f1) for i, r in rows.items() if is_legal(r.precision, r.recall)]
        legal.sort(key=lambda x: (-x[3], x[0].size(), x[0].key()))
        legal = legal[: params.beam]
        done |= {x[0].key(): x for x in legal}
        if size == 1:
            seeds = [x[0] for x in legal]
        if any(x[3] > 1 - 1e-6 for x in legal):
            break
        grown = (a.attach(b) for (a, *_), b in itertools.product(legal, seeds))
        level = {g.key(): g for g in grown if g.size() <= params.max_size and g.key() not in done}
    best = sorted(done.values(), key=lambda x: (-x[3], x[0].size(), x[0].key()))
    rows = [(key_text(g), g.size(), p, r, f) for g, p, r, f in best]
    return spark.createDataFrame(rows, "query string, size int, precision double, recall double, f1 double")


def key_text(g: QueryGraph) -> str:
    return g.key()


def apply_choice(candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """qid and the candidate that a ranker chose: the first number of its reply counts from 1; else the first candidate."""
    number = F.regexp_extract("reply", r"(\d+)", 1).try_cast("int")
    picked = choices.select("qid", F.coalesce(number, F.lit(1)).alias("pick"))
    sized = candidates.groupBy("qid").agg(F.max("position").alias("last"))
    picked = picked.join(sized, "qid").select("qid", F.when(F.col("pick").between(1, F.col("last")), F.col("pick")).otherwise(1).alias("position"))
    return candidates.join(picked, ["qid", "position"])
