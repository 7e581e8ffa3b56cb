"""Files around the engine: result and annotation JSON, ontology tables, stage outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "struct<qid:string,question:string,search_results:array<struct<sparql:string,sexpr:string>>,searched_queries:array<struct<sparql:string,sexpr:string>>,time:double>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """qid, position, sparql, sexpr of result files of any of three forms.

    ``{"results": [...]}``, an object of items by question, or a list; ``searched_queries`` is another name
    of ``search_results``.  Each file is one JSON value.
    """
    return parse_results(spark.read.text(path, wholetext=True))


def parse_results(raw: DataFrame) -> DataFrame:
    """The same of a table of whole files (value)."""
    whole = F.trim("value")
    as_list = F.from_json("value", f"array<{_ITEM}>")
    as_results = F.from_json("value", f"struct<results:array<{_ITEM}>>")["results"]
    as_map = F.map_values(F.from_json("value", f"map<string,{_ITEM}>"))
    items = F.when(F.startswith(whole, F.lit("[")), as_list).otherwise(F.coalesce(as_results, as_map))
    each = raw.select(F.explode(items).alias("i"))
    found = F.coalesce("i.search_results", "i.searched_queries")
    return each.select(F.col("i.qid").alias("qid"), F.posexplode(found).alias("position", "r")).select("qid", "position", "r.sparql", "r.sexpr")


def read_reverse(spark: SparkSession, path: str) -> DataFrame:
    """relation, reverse of a tab-separated table, in both directions."""
    return both_ways(spark.read.csv(path, sep="\t", schema="relation string, reverse string"))


def both_ways(t: DataFrame) -> DataFrame:
    """relation, reverse of pairs, each way."""
    return t.unionByName(t.select(F.col("reverse").alias("relation"), F.col("relation").alias("reverse"))).distinct()


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """domain, relation, range of a table parted by white space."""
    return parse_roles(spark.read.text(path))


def parse_roles(lines: DataFrame) -> DataFrame:
    """The same of a table of lines (value)."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.size(parts) >= 3).select(parts[0].alias("domain"), parts[1].alias("relation"), parts[2].alias("range"))


def method_of(path: Column, methods: list[tuple[str, str]], other: str | None = None) -> Column:
    """The method that a result file's name tells: the first of (pattern, method) that matches it."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.lit(other)
    for pattern, method in reversed(methods):
        out = F.when(name.rlike(pattern), method).otherwise(out)
    return out


def read_methods(spark: SparkSession, folder: str, methods: list[tuple[str, str]]) -> DataFrame:
    """Text of every JSON file of a folder with its path and method."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).withColumn("path", F.input_file_name())
    return raw.withColumn("method", method_of(F.col("path"), methods))


def binding_number(kind: Column, value: Column, datatype: Column) -> Column:
    """A typed binding as a number; booleans are 1 and 0; null for what is no number."""
    local = F.element_at(F.split(datatype, "#"), -1)
    number = F.when(local == "boolean", F.when(value.isin("true", "1"), 1.0).otherwise(0.0)).when(local.isin("integer", "int", "long", "float", "double", "decimal"), value.try_cast("double"))
    return F.when(kind == "typed-literal", number)


def binding_text(kind: Column, value: Column, datatype: Column) -> Column:
    """A binding as text where it is no number; an unbound one is empty."""
    return F.when(binding_number(kind, value, datatype).isNull(), F.coalesce(value, F.lit("")))


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written only where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_markdown(df: DataFrame, path: str) -> None:
    """A report table as Markdown, one file: for results of a few rows."""
    markdown_lines(df).coalesce(1).write.mode("overwrite").text(path)


def markdown_lines(df: DataFrame) -> DataFrame:
    """value: the lines of a Markdown table, its head first."""
    head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "---|" * len(df.columns),)], "value string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    return head.unionByName(df.select(cells.alias("value")))
