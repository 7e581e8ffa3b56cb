"""A virtual knowledge graph over Parquet tables.

Every class of nodes has a key in some table, and every predicate is a column of a table that holds the
subject's key.  Nothing is copied: a triple pattern becomes a projection of one table, several patterns on
one subject a single scan, and only a variable predicate needs the union of all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.terms import VType, to_term

NS = "kg:"


@dataclass(frozen=True)
class NodeClass:
    name: str
    native: bool = True  # the key is an integer column; else a string made from several
    named: bool = True  # nodes have a name; those without are intermediate (n-ary) nodes
    parts: tuple[str, ...] = ()  # columns, all numbers, whose texts joined by "-" are the key (nulls are left out)


@dataclass(frozen=True)
class Edge:
    """A predicate of one class: ``column`` of ``table``; ``target`` is a class name or a literal type."""

    predicate: str
    cls: str
    table: str
    key: str
    column: str
    target: str
    reverse: str | None = None


@dataclass
class Graph:
    """Classes, edges, and how to read their tables."""

    spark: SparkSession
    folder: str
    classes: dict[str, NodeClass] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def by_predicate(self, predicate: str) -> list[Edge]:
        return [e for e in self.edges if e.predicate == predicate]

    def predicates(self) -> list[str]:
        return sorted({e.predicate for e in self.edges})

    def is_class(self, target: str) -> bool:
        return target in self.classes

    def value_type(self, e: Edge) -> VType:
        return VType("iri", e.target) if self.is_class(e.target) else VType(e.target)

    def scan(self, table: str, key: str) -> DataFrame:
        """A table with its subject's key as column ``key_``."""
        return self.table(table).withColumn("key_", F.expr(key))

    def value(self, e: Edge) -> Column:
        return F.expr(e.column)

    def triples(self, edges: list[Edge] | None = None, subject: Column | None = None, obj: Column | None = None) -> DataFrame:
        """s (string), p (string), o (term) of the given edges; each table is read once.

        ``subject`` and ``obj`` are native keys that the edges' nodes must have: they reach the scan as filters.
        """
        groups: dict[tuple, list[Edge]] = {}
        for e in edges if edges is not None else self.edges:
            groups.setdefault((e.table, e.key, e.cls), []).append(e)
        out = None
        for (table, key, cls), es in groups.items():
            rows = self.scan(table, key)
            if subject is not None:
                rows = rows.filter(F.col("key_") == subject)
            if obj is not None:
                rows = rows.filter(reduce(lambda a, b: a | b, (self.value(e) == obj for e in es)))
            fits = (lambda e, c: c) if obj is None else (lambda e, c: F.when(self.value(e) == obj, c))
            cells = F.array(*(F.struct(F.lit(NS + e.predicate).alias("p"), fits(e, to_term(self.value(e), self.value_type(e))).alias("o")) for e in es))
            part = rows.select(F.concat(F.lit(f"{NS}{cls}/"), F.col("key_").cast("string")).alias("s"), F.explode(cells).alias("c"))
            part = part.select("s", "c.p", "c.o").filter("o is not null")
            out = part if out is None else out.unionByName(part)
        return out

    def nodes(self, classes: set[str] | None = None) -> DataFrame:
        """n (term): every subject and object, or the nodes of some classes, each once."""
        parts = []
        for e in self.edges:
            if classes is None or e.target in classes:
                parts.append(self.table(e.table).select(to_term(self.value(e), self.value_type(e)).alias("n")))
        seen = {(e.table, e.key, e.cls) for e in self.edges if classes is None or e.cls in classes}
        parts += [self.scan(table, key).select(to_term(F.col("key_"), VType("iri", cls)).alias("n")) for table, key, cls in sorted(seen)]
        return reduce(DataFrame.unionByName, parts).filter("n is not null").distinct()

    def catalog(self) -> DataFrame:
        """predicate, domain, range, is_object, reverse of every edge: a table of the schema's size."""
        rows = [(e.predicate, e.cls, e.target, self.is_class(e.target), e.reverse, self.classes[e.cls].named) for e in self.edges]
        return self.spark.createDataFrame(rows, "predicate string, domain string, range string, is_object boolean, reverse string, domain_named boolean")


_LINE_PARTS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "unix_micros(cast(l_shipdate as timestamp))", "l_extendedprice", "l_quantity")
_LINE = f"concat_ws('-', {', '.join(_LINE_PARTS)})"


def sales_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph over the tables of TESTDATA.md."""
    g = Graph(spark, folder)
    for name in ("region", "nation", "customer", "supplier", "part"):
        g.classes[name] = NodeClass(name)
    for name in ("order", "event", "document", "conversation", "page", "item"):
        g.classes[name] = NodeClass(name, named=False)
    g.classes["lineitem"] = NodeClass("lineitem", native=False, named=False, parts=_LINE_PARTS)
    g.classes["turn"] = NodeClass("turn", native=False, named=False, parts=("conv_id", "turn"))

    def add(cls: str, table: str, key: str, **columns: tuple[str, str]) -> None:
        for predicate, (column, target) in columns.items():
            g.edges.append(Edge(predicate, cls, table, key, column, target))

    add("region", "region", "cast(r_regionkey as bigint)", name=("r_name", "str"))
    add("nation", "nation", "cast(n_nationkey as bigint)", name=("n_name", "str"), in_region=("cast(n_regionkey as bigint)", "region"))
    add("customer", "customer", "c_custkey", name=("c_name", "str"), acctbal=("c_acctbal", "dbl"), mktsegment=("c_mktsegment", "str"), of_nation=("cast(c_nationkey as bigint)", "nation"))
    add("supplier", "supplier", "s_suppkey", name=("s_name", "str"), acctbal=("s_acctbal", "dbl"), of_nation=("cast(s_nationkey as bigint)", "nation"))
    add("part", "part", "p_partkey", name=("p_name", "str"), brand=("p_brand", "str"), type=("p_type", "str"), size=("p_size", "int"), retailprice=("p_retailprice", "dbl"))
    add("order", "orders", "o_orderkey", placed_by=("o_custkey", "customer"), status=("o_orderstatus", "str"), totalprice=("o_totalprice", "dbl"), orderdate=("o_orderdate", "ts"), orderpriority=("o_orderpriority", "str"))
    add(
        "lineitem", "lineitem", _LINE, of_order=("l_orderkey", "order"), of_part=("l_partkey", "part"), of_supplier=("l_suppkey", "supplier"), quantity=("l_quantity", "dbl"),
        extendedprice=("l_extendedprice", "dbl"), discount=("l_discount", "dbl"), tax=("l_tax", "dbl"), shipdate=("l_shipdate", "ts"), returnflag=("l_returnflag", "str"), linestatus=("l_linestatus", "str"),
    )
    add("event", "events", "event_id", by_user=("user_id", "customer"), at=("ts", "ts"), event_type=("event_type", "str"), value=("value", "dbl"))
    add("document", "documents", "doc_id", language=("lang", "str"), source=("source", "str"), n_chars=("n_chars", "int"), text=("struct(text as lex, lang as lang)", "lang"))
    add("document", "labels", "doc_id", quality=("quality", "int"), toxic=("toxic", "int"))
    add("turn", "conversations", "concat_ws('-', conv_id, turn)", in_conversation=("conv_id", "conversation"), turn_no=("turn", "int"), role=("role", "str"), said=("text", "str"))
    add("page", "pages", "page_id", url=("url", "str"))
    add("item", "benchmark", "item_id", text=("text", "str"))
    return g
