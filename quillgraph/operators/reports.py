"""Evaluation reports: means, bins, sweeps and question-benchmark scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import metrics
from quillgraph.functions import text as words


def method_means(rows: DataFrame, method: str, scores: list[str], order: list[str] | None = None) -> DataFrame:
    """Mean of each score by method; methods without rows are listed too when an order is given."""
    means = rows.groupBy(method).agg(F.count("*").alias("n"), *(F.avg(s).alias(s) for s in scores))
    if not order:
        return means
    names = rows.sparkSession.createDataFrame([(m, i) for i, m in enumerate(order)], f"`{method}` string, position int")
    return names.join(means, method, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hop_bin(hops: Column) -> Column:
    return F.when(hops > 3, ">3").when(hops >= 1, hops.cast("string"))


def score_bin(score: Column) -> Column:
    """Bins of a similarity: nothing, low, middle, high."""
    return F.when(score == 0, "0").when(score <= 0.25, "(0,0.25]").when(score <= 0.75, "(0.25,0.75]").otherwise("(0.75,1]")


def distance_bin(d: Column) -> Column:
    return F.when(d == 1, "1").when(d >= 0.75, "[0.75,1)").when(d >= 0.25, "[0.25,0.75)").otherwise("[0,0.25)")


def binned_mean(rows: DataFrame, first: Column, second: Column, value: str) -> DataFrame:
    return rows.groupBy(first.alias("row_bin"), second.alias("col_bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def level_means(rows: DataFrame, level: str, scores: list[str]) -> DataFrame:
    """Means by level and overall (level 'all'): one pass over the rows."""
    out = rows.rollup(level).agg(F.grouping(level).alias("g_"), F.count("*").alias("n"), *(F.avg(s).alias(s) for s in scores))
    return out.withColumn(level, F.when(F.col("g_") == 1, "all").otherwise(F.col(level))).drop("g_")


def threshold_sweep(rows: DataFrame, score: str, positive: str, thresholds: list[float]) -> DataFrame:
    """threshold, false_positives, false_negatives, in one aggregation whatever the number of thresholds."""
    cells = [F.struct(F.lit(t).alias("threshold"), F.count(F.when(~F.col(positive) & (F.col(score) >= t), 1)).alias("false_positives"), F.count(F.when(F.col(positive) & (F.col(score) < t), 1)).alias("false_negatives")) for t in thresholds]
    return rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def mark_best(rows: DataFrame, group: str, score: str, tolerance: float = 0.0005, higher: bool = True) -> DataFrame:
    """``mark``: 1 for the best of a group, 2 for the next, null else; scores within the tolerance share a mark."""
    step = F.round(F.col(score) / (2 * tolerance))
    w = Window.partitionBy(group).orderBy(F.desc(step) if higher else F.asc(step))
    return rows.withColumn("mark", F.dense_rank().over(w)).withColumn("mark", F.when(F.col("mark") <= 2, F.col("mark")))


def valid_annotations(rows: DataFrame, qid: str, seconds: str, parsable: str, abandoned: float = 9999) -> DataFrame:
    """Parsable rows of questions that nobody abandoned; one abandoned row drops its whole question."""
    given_up = rows.filter(F.col(seconds) == abandoned).select(qid).distinct()
    return rows.filter(F.col(parsable)).join(given_up, qid, "left_anti")


def best_parse(rows: DataFrame, qid: str, pred: str, gold: str) -> DataFrame:
    """qid, precision, recall, f1 of the gold parse with the best F1 (list convention); missing predictions are empty."""
    some = F.coalesce(F.col(pred), F.expr("array()").cast("array<string>"))
    scored = rows.select(qid, metrics.prf1_lists(some, F.col(gold)).alias("m"))
    return scored.groupBy(qid).agg(F.max_by("m", F.struct("m.f1", "m.precision", "m.recall")).alias("m")).select(qid, "m.precision", "m.recall", "m.f1")


def leveled_report(rows: DataFrame, level: str, exact: str, pred: str, gold: str) -> DataFrame:
    """Exact match and F1 by level and overall; an exact match has F1 1 whatever its answers."""
    f1 = F.when(F.col(exact), 1.0).otherwise(metrics.prf1(F.col(pred), F.col(gold))["f1"])
    return level_means(rows.withColumns({"em": F.col(exact).cast("double"), "f1": f1}), level, ["em", "f1"])


def set_accuracy(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    """accuracy, f1 over rows: equality of answer sets, and mean F1."""
    same = F.array_sort(F.array_distinct(pred)) == F.array_sort(F.array_distinct(gold))
    return rows.agg(F.avg(F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0)).alias("accuracy"), F.avg(metrics.prf1(F.col(pred), F.col(gold))["f1"]).alias("f1"))


def per_gold_mean(scores: DataFrame, golden: DataFrame, qid: str, score: str, missing: float, best=F.min) -> DataFrame:
    """mean, n_missing: the best score of each golden question, ``missing`` where it has none; divided by the golden count."""
    own = scores.groupBy(qid).agg(best(score).alias(score))
    joined = golden.select(qid).distinct().join(own, qid, "left")
    return joined.agg(F.avg(F.coalesce(score, F.lit(missing))).alias("mean"), F.count(F.when(F.col(score).isNull(), 1)).alias("n_missing"))


def first_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; every task keeps no more than n of a group before they meet."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("k_", k).filter(F.col("k_") <= n).drop("k_")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same on every run, and whatever the partitions."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)


def match_texts(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str) -> DataFrame:
    """left_id, right_id of equal query texts: with white space evened out, and of the others without any."""
    a = left.select(left_id, words.match_form(F.col(text)).alias("k_"))
    b = right.select(right_id, words.match_form(F.col(text)).alias("k_"))
    bare = lambda df: df.withColumn("k_", F.regexp_replace("k_", " ", ""))
    first = a.join(b, "k_").select(left_id, right_id)
    return first.unionByName(bare(a.join(first, left_id, "left_anti")).join(bare(b), "k_").select(left_id, right_id))


def score_table(rows: DataFrame, method: str, dataset: str, score: str, datasets: list[str], digits: int = 3, lower: bool = True) -> DataFrame:
    """A row for each method and a column of text for each data set: the mean score, **best** and <u>second</u> marked, -- where there is none."""
    means = rows.groupBy(dataset, method).agg(F.avg(score).alias("mean_"))
    marked = mark_best(means, dataset, "mean_", higher=not lower)
    text = F.format_number("mean_", digits)
    cell = F.when(F.col("mark") == 1, F.concat(F.lit("**"), text, F.lit("**"))).when(F.col("mark") == 2, F.concat(F.lit("<u>"), text, F.lit("</u>"))).otherwise(text)
    wide = marked.groupBy(method).pivot(dataset, datasets).agg(F.first(cell))
    return wide.select(method, *(F.coalesce(F.col(f"`{d}`"), F.lit("--")).alias(d) for d in datasets))


def compare_published(ours: DataFrame, published: DataFrame, keys: list[str], score: str) -> DataFrame:
    """keys, ours, published, difference: recomputed scores beside published ones, whichever there is."""
    a, b = ours.select(*keys, F.col(score).alias("ours")), published.select(*keys, F.col(score).alias("published"))
    return a.join(b, keys, "full_outer").withColumn("difference", F.col("ours") - F.col("published"))
