"""How equivalent two queries are when their constants vary (test-suite scores).

Constants that both queries have become projected variables, so one run of each gives the answers for
every perturbation; the scores are joins and aggregates over these two results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import metrics
from quillgraph.plans import ast as A
from quillgraph.plans.compiler import Engine
from quillgraph.plans.parser import parse
from quillgraph.plans.printer import query as show
from quillgraph.plans.rewrite import abstract, capped, contains_leaf, for_test_suite, replace_constant

TARGET = "target"
SEED = 374


def _read(q: str | A.Query) -> A.Query:
    return for_test_suite(parse(q) if isinstance(q, str) else q, TARGET)


def overlapping(golden: A.Query, constructed: A.Query, items: list[A.Term]) -> dict[A.Term, str]:
    """The items that occur in both, with the variables that stand for them; numbers and times stay as they are."""
    both = [c for c in items if contains_leaf(golden, c) and contains_leaf(constructed, c)]
    return {c: f"replace{i}" for i, c in enumerate(both) if isinstance(c, A.Iri)}


def answers(engine: Engine, q: A.Query, chosen: dict[A.Term, str], per_perturbation: bool = True) -> DataFrame:
    """For each perturbation (the replace columns) its set of answers.

    A query's ORDER BY and LIMIT hold for each perturbation; with ``per_perturbation`` off the limit is
    taken over all of them, as a store would.
    """
    names = list(chosen.values())
    wide = abstract(q, chosen)
    if per_perturbation and q.limit is not None and q.order_by:
        key = A.Projected(q.order_by[0].expr, A.Var("arg_"))
        plain = wide.with_(projection=(*wide.projection, key), order_by=(), limit=None, offset=None, distinct=False)
        rows = engine.sparql(plain)
        best = F.max if q.order_by[0].descending else F.min
        top = rows.groupBy(*names).agg(best("arg_").alias("arg_"))
        # one answer of those that tie, the smallest
        rows = rows.join(top, [*names, "arg_"]).groupBy(*names).agg(F.min(F.col(TARGET).cast("string")).alias(TARGET))
    else:
        rows = engine.sparql(wide)
    return rows.groupBy(*names).agg(F.collect_set(F.col(TARGET).cast("string")).alias("answers"))


def constant_row(engine: Engine, score: float, size: int) -> DataFrame:
    return engine.graph.spark.range(1).select(F.lit(score).alias("score"), F.lit(size).cast("long").alias("suite_size"))


def test_suite_score(engine: Engine, golden: str | A.Query, constructed: str | A.Query, items: list[A.Term], per_perturbation: bool = True) -> DataFrame:
    """Method 1: (score, suite_size): the mean Jaccard of answers over the perturbations of either query.

    Equal queries score 1 with size -1; without a common constant, or for queries that cannot be edited,
    the score is 0 with size -1.
    """
    try:
        g, c = _read(golden), _read(constructed)
        if show(g) == show(c):
            return constant_row(engine, 1.0, -1)
        chosen = overlapping(g, c, items)
        if not chosen:
            return constant_row(engine, 0.0, -1)
        left, right = answers(engine, g, chosen, per_perturbation), answers(engine, c, chosen, per_perturbation)
    except ValueError:
        return constant_row(engine, 0.0, -1)
    both = left.withColumnRenamed("answers", "g").join(right.withColumnRenamed("answers", "c"), list(chosen.values()), "full_outer")
    return both.agg(F.coalesce(F.avg(metrics.jaccard(F.col("g"), F.col("c"))), F.lit(0.0)).alias("score"), F.count("*").alias("suite_size"))


def regrounded(engine: Engine, q: A.Query, chosen: dict[A.Term, str]) -> dict[A.Term, DataFrame]:
    """For each constant alone, the values that give answers, as one string column v."""
    out = {}
    for c, name in chosen.items():
        wide = abstract(q, {c: name}).with_(order_by=(), limit=None, offset=None)
        out[c] = engine.sparql(wide).select(F.col(name).cast("string").alias("v")).distinct()
    return out


def two_part_score(engine: Engine, golden: str | A.Query, constructed: str | A.Query, items: list[A.Term], limit: int = 200, seed: int = SEED) -> DataFrame:
    """Method 2: (s1, s2, score).

    s1: mean Jaccard of the values that each constant can take in the two queries.  s2: mean Jaccard of
    answers over at most ``limit`` combinations of common values, in the order of a seeded hash (two empty
    answers are equal).  score = s1 * s2.
    """
    g, c = _read(golden), _read(constructed)
    chosen = overlapping(g, c, items)
    if not chosen:
        return engine.graph.spark.range(1).select(F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"), F.lit(0.0).alias("score"))
    gv, cv = regrounded(engine, g, chosen), regrounded(engine, c, chosen)
    parts = []
    for const in chosen:
        a, b = gv[const].withColumn("g", F.lit(1)), cv[const].withColumn("c", F.lit(1))
        sizes = a.join(b, "v", "full_outer").agg(F.count("g").alias("ng"), F.count("c").alias("nc"), F.count("*").alias("nu"), F.count(F.when(F.col("g").isNotNull() & F.col("c").isNotNull(), 1)).alias("ni"))
        parts.append(sizes.select(F.when((F.col("ng") == 0) | (F.col("nc") == 0), 0.0).otherwise(F.col("ni") / F.col("nu")).alias("j")))
    s1 = reduce(DataFrame.unionByName, parts).agg(F.avg("j").alias("s1"))
    names = list(chosen.values())
    combos = _combinations([gv[x].join(cv[x], "v", "left_semi") for x in chosen], names, limit, seed)
    left, right = answers(engine, g, chosen), answers(engine, c, chosen)
    scored = combos.join(left.withColumnRenamed("answers", "ga"), names, "left").join(right.withColumnRenamed("answers", "ca"), names, "left")
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    each = F.when(empty(F.col("ga")) & empty(F.col("ca")), 1.0).otherwise(metrics.jaccard(F.col("ga"), F.col("ca")))
    s2 = scored.agg(F.coalesce(F.avg(each), F.lit(0.0)).alias("s2"))
    return s1.crossJoin(s2).select("s1", "s2", (F.col("s1") * F.col("s2")).alias("score"))


def _combinations(values: list[DataFrame], names: list[str], limit: int, seed: int) -> DataFrame:
    """At most ``limit`` different combinations of one value (column v) of each table.

    The first ``limit`` values of each table, in the order of a seeded hash, are enough for so many; a
    combination is a number in the mixed base of their counts, and the numbers are spread evenly.
    """
    rows = [[r.v for r in t.orderBy(F.md5(F.concat("v", F.lit(f":{seed}")).cast("binary")), "v").limit(limit).collect()] for t in values]  # at most limit rows each
    total = math.prod(len(r) for r in rows)
    picked = []
    for i in range(min(total, limit)):
        at, cells = i * total // min(total, limit), []
        for r in rows:
            at, k = divmod(at, len(r))
            cells.append(r[k])
        picked.append(tuple(cells))
    return values[0].sparkSession.createDataFrame(picked, ", ".join(f"`{n}` string" for n in names))


def build_suite(engine: Engine, golden: str | A.Query, items: list[A.Term], limit: int = 50, seed: int = SEED) -> DataFrame:
    """Test cases of a query: case, replace columns, answers; the original constants come first.

    Every case has answers.  The rest are taken in the order of a seeded hash.
    """
    g = _read(golden)
    chosen = {c: f"replace{i}" for i, c in enumerate(x for x in items if isinstance(x, A.Iri) and contains_leaf(g, x))}
    every = answers(engine, g, chosen)
    own = reduce(lambda p, q: p & q, (F.col(n) == F.lit(c.value) for c, n in chosen.items()), F.lit(True))
    return every.withColumn("original", own).orderBy(F.desc("original"), F.xxhash64(*chosen.values(), F.lit(seed)), *chosen.values()).limit(limit)


def suite_scores(engine: Engine, constructed: str | A.Query, suite: DataFrame, chosen: dict[A.Term, str]) -> DataFrame:
    """Method 3: (precision, recall, f1, accuracy, cases): a query's answers against those of stored cases.

    The cases' replace columns hold for the constants that the query has; without any the scores are 0, and
    an empty suite scores 1.
    """
    c = _read(constructed)
    own = {k: n for k, n in chosen.items() if contains_leaf(c, k)}
    size = suite.agg(F.count("*").alias("cases"))
    if not own:
        zero = F.when(F.col("cases") == 0, 1.0).otherwise(0.0)
        return size.select(zero.alias("precision"), zero.alias("recall"), zero.alias("f1"), zero.alias("accuracy"), "cases")
    got = answers(engine, c, own).withColumnRenamed("answers", "predicted")
    scored = suite.join(got, list(own.values()), "left").select(metrics.prf1(F.col("predicted"), F.col("answers")).alias("m"))
    mean = lambda col: F.coalesce(F.avg(col), F.lit(1.0))
    return scored.agg(mean("m.precision").alias("precision"), mean("m.recall").alias("recall"), mean("m.f1").alias("f1"), mean(F.when(F.abs(F.col("m.f1") - 1) < 1e-9, 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("cases"))


def bind(q: str | A.Query, binding: dict[A.Term, A.Term]) -> A.Query:
    """A query with some constants replaced by others."""
    out = parse(q) if isinstance(q, str) else q
    for old, new in binding.items():
        out = replace_constant(out, old, new)
    return out


def apply_perturbation(engine: Engine, q: str | A.Query, chosen: dict[A.Term, str], cap: int | None = 200_000) -> DataFrame:
    """The answers of a query whose chosen constants are projected variables.

    ``cap`` is a store's limit on rows, a feature of the scores that are published; it holds where the query has
    no limit of its own, and None lifts it.
    """
    wide = abstract(_read(q), chosen)
    return engine.sparql(wide if cap is None else capped(wide, cap))


def build_suites(engine: Engine, golden: list[tuple[str, str, list[A.Term]]], limit: int = 50, seed: int = SEED) -> DataFrame:
    """qid, binding (a map of constant to its value), answers, original of the test cases of many queries.

    A query that cannot be edited or has no such constant has no cases; all share one seed.
    """
    parts = []
    for qid, text, items in golden:
        try:
            names = [c for c in items if isinstance(c, A.Iri) and contains_leaf(_read(text), c)]
            if names:
                suite = build_suite(engine, text, names, limit, seed)
                cells = [x for i, c in enumerate(names) for x in (F.lit(c.value), F.col(f"replace{i}"))]
                parts.append(suite.select(F.lit(qid).alias("qid"), F.create_map(*cells).alias("binding"), "answers", "original"))
        except ValueError:
            continue
    empty = engine.graph.spark.createDataFrame([], "qid string, binding map<string,string>, answers array<string>, original boolean")
    return reduce(DataFrame.unionByName, parts, empty)
