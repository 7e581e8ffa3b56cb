"""Scores of answer sets and comparisons of literals, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers closer than this are equal (fixed value).
EPS = 0.001
#: The day that "now" means (fixed value).
PRESENT = "2015-08-10"


def _n(a: Column) -> Column:
    return F.size(F.array_distinct(F.coalesce(a, F.expr("array()").cast("array<string>"))))


def _set(a: Column) -> Column:
    return F.array_distinct(F.coalesce(a, F.expr("array()").cast("array<string>")))


def _pack(p: Column, r: Column) -> Column:
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when either is empty."""
    return F.when((_n(a) == 0) | (_n(b) == 0), 0.0).otherwise(F.size(F.array_intersect(_set(a), _set(b))) / F.size(F.array_union(_set(a), _set(b))))


def prf1(pred: Column, gold: Column) -> Column:
    """Precision, recall and F1 of two arrays as sets; both empty is perfect."""
    common = F.size(F.array_intersect(_set(pred), _set(gold)))
    return prf1_sizes(_n(pred), _n(gold), common)


def prf1_sizes(n_pred: Column, n_gold: Column, common: Column) -> Column:
    none = (n_pred == 0) & (n_gold == 0)
    some = (n_pred > 0) & (n_gold > 0)
    p = F.when(none, 1.0).when(some, common / F.greatest(n_pred, F.lit(1))).otherwise(0.0)
    r = F.when(none, 1.0).when(some, common / F.greatest(n_gold, F.lit(1))).otherwise(0.0)
    return _pack(p, r)


def prf1_counts(n_pred: Column, n_gold: Column) -> Column:
    """As ``prf1`` where only the sizes of the sets are compared."""
    return prf1_sizes(n_pred, n_gold, F.least(n_pred, n_gold))


def prf1_lists(pred: Column, gold: Column) -> Column:
    """Of two arrays as lists, in the convention of question benchmarks.

    No gold answers: precision 0 (1 if nothing was predicted) and recall 1; no prediction: precision 1 and
    recall 0.  Repeated entries count each for itself.
    """
    tp = F.size(F.filter(gold, lambda x: F.array_contains(pred, x))).cast("double")
    fp = F.size(F.filter(pred, lambda x: ~F.array_contains(gold, x)))
    fn = F.size(gold) - tp
    p = F.when(F.size(gold) == 0, F.when(F.size(pred) == 0, 1.0).otherwise(0.0)).when(F.size(pred) == 0, 1.0).otherwise(F.try_divide(tp, tp + fp))
    r = F.when(F.size(gold) == 0, 1.0).when(F.size(pred) == 0, 0.0).otherwise(F.try_divide(tp, tp + fn))
    f = F.when(F.size(gold) == 0, F.when(F.size(pred) == 0, 1.0).otherwise(0.0)).when(F.size(pred) == 0, 0.0).otherwise(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"))


def bare(literal: Column) -> Column:
    """The lexical form of a rendered literal: quotes, datatype and language taken off."""
    return F.regexp_replace(F.regexp_replace(literal, r'("?)\^\^.*$|@[A-Za-z-]+$', "$1"), r'^"|"$', "")


def _let(c: Column, f) -> Column:
    """``f`` of a column that is computed once a row, however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def literal_time(literal: Column) -> Column:
    """A rendered time as a timestamp: missing parts are first days and midnight, zone offsets are dropped."""

    def time(lex: Column) -> Column:
        full = F.when(lex.rlike(r"^\d{4}$"), F.concat(lex, F.lit("-01-01"))).when(lex.rlike(r"^\d{4}-\d{1,2}$"), F.concat(lex, F.lit("-01")))
        return full.when(lex.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2})?$"), lex).try_cast("timestamp_ntz")

    return _let(F.translate(F.regexp_replace(bare(literal), r"(Z|[+-]\d\d:\d\d)$", ""), " ", "T"), time)


def _compared(a: Column, b: Column, times, numbers) -> Column:
    """What ``times`` says of two rendered literals where both are times (four digits are a year), else ``numbers``; each is read once."""
    as_numbers = _let(F.struct(bare(a).try_cast("double").alias("x"), bare(b).try_cast("double").alias("y")), lambda v: numbers(v["x"], v["y"]))
    both = F.struct(literal_time(a).alias("s"), literal_time(b).alias("t"))
    return _let(both, lambda v: F.when(v["s"].isNotNull() & v["t"].isNotNull(), times(v["s"], v["t"])).otherwise(as_numbers))


def _near(x: Column, y: Column) -> Column:
    return F.abs(x - y) < EPS


def compare_literals(a: Column, b: Column, op: str) -> Column:
    """Of two rendered literals: as times where both are times (four digits are a year), else as numbers.

    Numbers within EPS are equal and not ordered.  What is neither gives false.
    """
    times = {"=": lambda s, t: s == t, "<": lambda s, t: s < t, ">": lambda s, t: s > t, "<=": lambda s, t: s <= t, ">=": lambda s, t: s >= t}[op]
    numbers = {
        "=": _near, "<": lambda x, y: ~_near(x, y) & (x < y), ">": lambda x, y: ~_near(x, y) & (x > y),
        "<=": lambda x, y: _near(x, y) | (x < y), ">=": lambda x, y: _near(x, y) | (x > y),
    }[op]
    return F.coalesce(_compared(a, b, times, numbers), F.lit(False))


def holding_comparators(a: Column, b: Column) -> Column:
    """Array of the comparators GE, GT, EQ, LE, LT that hold between two rendered literals."""
    same, more, less, none = (F.array(*(F.lit(n) for n in names)).cast("array<string>") for names in (("GE", "EQ", "LE"), ("GE", "GT"), ("LE", "LT"), ()))
    times = lambda s, t: F.when(s == t, same).when(s > t, more).otherwise(less)
    numbers = lambda x, y: F.when(_near(x, y), same).when(x > y, more).when(x < y, less).otherwise(none)
    return _compared(a, b, times, numbers)


def valid_in(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Whether an interval (null: open) meets first..last."""
    return (start.isNull() | (start <= last)) & (end.isNull() | (end >= first))
