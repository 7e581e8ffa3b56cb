"""Scans of remote endpoints: tables of query texts in, their results out.

Each task sends the queries of its partition, one after another; a query that fails is sent again, and gives one
row with its error in the end.  Nothing passes the driver.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TERM = "struct<type:string,value:string,datatype:string,lang:string>"
_ROW_DDL = f"qid string, position int, bindings map<string,{_TERM}>, boolean boolean, error string"
_KIND = pa.struct([("type", pa.string()), ("value", pa.string()), ("datatype", pa.string()), ("lang", pa.string())])
_ROW = pa.schema([("qid", pa.string()), ("position", pa.int32()), ("bindings", pa.map_(pa.string(), _KIND)), ("boolean", pa.bool_()), ("error", pa.string())])
#: Rows of a batch that goes back to Spark.
BATCH = 1000


def _rows(queries: DataFrame, qid: str, text: str, ask: Callable[[str], Iterator[tuple]], retries: int, partitions: int | None) -> DataFrame:
    asked = queries.select(F.col(qid).cast("string").alias("qid"), F.col(text).alias("text"))
    asked = asked.repartition(partitions) if partitions else asked

    def answers(q: str | None, t: str | None) -> Iterator[tuple]:
        said = "no query"
        for _ in range(retries if t else 0):
            try:
                found = list(ask(t))  # whole, so that a failure half-way gives no rows twice
                yield from ((q, i, *row, None) for i, row in enumerate(found))
                return
            except (OSError, ValueError, KeyError) as e:
                said = f"{type(e).__name__}: {e}"
        yield q, 0, None, None, said

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for q, t in zip(batch.column("qid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for row in answers(q, t):
                    held.append(row)
                    if len(held) == BATCH:
                        yield _pack(held)
                        held = []
        if held:
            yield _pack(held)

    return asked.mapInArrow(run, _ROW_DDL)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def parse_json_results(raw: bytes) -> Iterator[tuple]:
    """(bindings, boolean) of each row of a result in the JSON format; an ASK is one row with its answer alone."""
    said = json.loads(raw)
    if "boolean" in said:
        yield None, bool(said["boolean"])
        return
    for row in said["results"]["bindings"]:
        yield [(name, {"type": t.get("type"), "value": t.get("value"), "datatype": t.get("datatype"), "lang": t.get("xml:lang")}) for name, t in row.items()], None


def http_scan(queries: DataFrame, url: str, qid: str = "qid", text: str = "text", retries: int = 4, seconds: float = 60.0, prefixes: str = "", partitions: int | None = None) -> DataFrame:
    """qid, position, bindings (a map of variable to type, value, datatype, lang), boolean, error of each row of each query.

    Queries go by POST and come back in the JSON results format.  ``partitions`` bounds how many are sent at once.
    """

    def ask(t: str) -> Iterator[tuple]:
        body = urllib.parse.urlencode({"query": f"{prefixes} {t}".strip()}).encode()
        request = urllib.request.Request(url, body, {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"})
        with urllib.request.urlopen(request, timeout=seconds) as reply:
            yield from parse_json_results(reply.read())

    return _rows(queries, qid, text, ask, retries, partitions)


def odbc_scan(queries: DataFrame, connection: str, qid: str = "qid", text: str = "text", retries: int = 4, partitions: int | None = None) -> DataFrame:
    """The same over ODBC, with one connection for each query; needs pyodbc on the executors.

    A store's drivers give values without their kinds, so a value is a literal but where it begins like an IRI.
    """

    def ask(t: str) -> Iterator[tuple]:
        try:
            import pyodbc
        except ImportError as e:
            raise OSError("pyodbc is not installed") from e
        with pyodbc.connect(connection) as c:
            cursor = c.cursor().execute(f"SPARQL {t}")
            names = [d[0] for d in cursor.description or ()]
            for row in cursor:
                yield [(n, {"type": "uri" if str(v).startswith(("http://", "https://")) else "literal", "value": str(v), "datatype": None, "lang": None}) for n, v in zip(names, row, strict=True) if v is not None], None

    return _rows(queries, qid, text, ask, retries, partitions)


def values(rows: DataFrame, variable: str) -> DataFrame:
    """qid, value: the distinct values of one variable of scanned rows."""
    return rows.select("qid", F.col("bindings")[variable]["value"].alias("value")).filter("value is not null").distinct()
