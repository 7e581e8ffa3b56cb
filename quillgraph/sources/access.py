"""Results of queries in the shapes that callers of an endpoint expect, and a cache of them."""

from __future__ import annotations

import hashlib
import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans import ast as A
from quillgraph.plans.compiler import Engine
from quillgraph.sources.registry import NS

ERROR = "ERROR"


def _binding(term: Column) -> Column:
    """type, value, datatype, xml:lang of a term; null where it is unbound."""
    plain = term["dt"].isin(A.XSD + "string", A.RDF + "langString")
    kind = F.when(term["kind"] == 0, "uri").when(term["kind"] == 1, "bnode").when(plain, "literal").otherwise("typed-literal")
    dt = F.when((term["kind"] == 2) & ~plain, term["dt"])
    lang = F.when(term["lang"] != "", term["lang"])
    return F.when(term.isNotNull(), F.struct(kind.alias("type"), term["lex"].alias("value"), dt.alias("datatype"), lang.alias("xml:lang")))


def bindings(engine: Engine, text: str) -> DataFrame:
    """A struct (type, value, datatype, xml:lang) for each variable of each row; an ASK is one row {boolean}."""
    q = engine.compiler().read(text)
    if q.form == "ASK":
        return engine.sparql(q).select((F.col("answer") == 1).alias("boolean"))
    rows = engine.sparql(q, terms=True)
    return rows.select(*(_binding(F.col(f"`{c}`")).alias(c) for c in rows.columns))


def tuples(engine: Engine, text: str) -> DataFrame:
    """The rows as native values; an ASK is one row (1) or (0)."""
    return engine.sparql(text)


def one_variable(engine: Engine, text: str) -> DataFrame:
    """value: the distinct values of a query's first variable as text, IRIs without the namespace."""
    rows = engine.sparql(text)
    first = F.col(f"`{rows.columns[0]}`").cast("string")
    return rows.select(F.regexp_replace(first, f"^{NS}", "").alias("value")).distinct()


def typed_values(engine: Engine, text: str) -> DataFrame:
    """value: the distinct values of a query's only variable, literals with their datatype or language."""
    rows = engine.sparql(text, terms=True)
    if len(rows.columns) != 1:
        raise ValueError("not exactly one variable")
    t = F.col(f"`{rows.columns[0]}`")
    quoted = F.concat(F.lit('"'), t["lex"], F.lit('"'))
    typed = F.when(t["lang"] != "", F.concat(quoted, F.lit("@"), t["lang"])).when(t["dt"] == A.XSD + "string", quoted).otherwise(F.concat(quoted, F.lit("^^<"), t["dt"], F.lit(">")))
    return rows.select(F.when(t["kind"] == 2, typed).otherwise(F.regexp_replace(t["lex"], f"^{NS}", "")).alias("value")).distinct()


def or_error(engine: Engine, text: str) -> DataFrame:
    """The rows of a query, or one row that says so where it cannot be read or has no meaning here."""
    try:
        return engine.sparql(text)
    except ValueError:
        return engine.graph.spark.createDataFrame([(ERROR,)], "error string")


def first_that_answers(engine: Engine, *texts: str) -> DataFrame:
    """The rows of the first query that has any and no error; else of the last."""
    for text in texts[:-1]:
        rows = or_error(engine, text)
        if rows.columns != ["error"] and not rows.isEmpty():
            return rows
    return or_error(engine, texts[-1])


class ResultCache:
    """Results by query text, as Parquet below a shared folder.

    Texts that differ in white space alone share a result.  Quick empty results are not kept: ``slow`` is the
    number of seconds from which an empty one is.
    """

    def __init__(self, engine: Engine, folder: str, slow: float = 0.2):
        self.engine, self.folder, self.slow = engine, folder.rstrip("/"), slow

    def path(self, text: str) -> str:
        return f"{self.folder}/{hashlib.sha256(re.sub(r'\s+', ' ', text).strip().encode()).hexdigest()}"

    def get(self, text: str) -> DataFrame:
        spark, path = self.engine.graph.spark, self.path(text)
        done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(done):
            return spark.read.parquet(path)
        start = time.perf_counter()
        self.engine.sparql(text).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        if time.perf_counter() - start < self.slow and rows.isEmpty():
            rows = spark.createDataFrame([], rows.schema)
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
        return rows
