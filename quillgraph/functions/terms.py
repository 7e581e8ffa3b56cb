"""Typed bindings and RDF terms.

A variable whose type is known is a native column; ``VType`` says what it is.  Where types mix, a value is
a term struct (kind 0 IRI, 1 blank, 2 literal; lexical form; datatype; language).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.plans.ast import RDF, XSD

TERM = "struct<kind:int,lex:string,dt:string,lang:string>"
#: XSD names of the native literal types.
DATATYPE = {"str": "string", "int": "integer", "dbl": "double", "dec": "decimal", "bool": "boolean", "ts": "dateTime", "date": "date"}
NUMERIC = ("int", "dec", "dbl")


@dataclass(frozen=True)
class VType:
    kind: str  # iri str int dec dbl bool ts date lang term
    cls: str | None = None  # of an iri whose column is the native key

    @property
    def numeric(self) -> bool:
        return self.kind in NUMERIC


def text_of(c: Column, t: VType) -> Column:
    """The lexical form (STR)."""
    if t.kind == "iri":
        return c if t.cls is None else F.concat(F.lit(f"kg:{t.cls}/"), c.cast("string"))
    if t.kind == "ts":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if t.kind in ("term", "lang"):
        return c["lex"]
    return c.cast("string")


def to_term(c: Column, t: VType) -> Column:
    """The value as a term; the two zeros of doubles are one term, as they are one key of a native column."""
    if t.kind == "term":
        return c
    kind = 0 if t.kind == "iri" else 2
    if t.kind == "lang":
        dt, lang = F.lit(RDF + "langString"), F.lower(c["lang"])
    else:
        dt, lang = F.lit(None if kind == 0 else XSD + DATATYPE[t.kind]).cast("string"), F.lit("")
    lex = text_of(c + F.lit(0.0) if t.kind == "dbl" else c, t)  # -0.0 + 0.0 is 0.0
    return F.when(lex.isNotNull(), F.struct(F.lit(kind).alias("kind"), lex.alias("lex"), dt.alias("dt"), lang.alias("lang")))


def datatype_of(c: Column, t: VType) -> Column:
    if t.kind in ("term",):
        return F.when(c["kind"] == 2, c["dt"])
    if t.kind == "iri":
        return F.lit(None).cast("string")
    return F.when(c.isNotNull(), F.lit(RDF + "langString" if t.kind == "lang" else XSD + DATATYPE[t.kind]))


def number_of(c: Column, t: VType) -> Column:
    """The value as a double; null where it is not a number."""
    if t.numeric:
        return c.cast("double")
    if t.kind == "bool":
        return c.cast("double")
    if t.kind == "term":
        return F.when(c["dt"].isin(*(XSD + x for x in ("integer", "decimal", "double", "float", "int", "long"))), c["lex"].try_cast("double"))
    return F.lit(None).cast("double")


def time_of(c: Column, t: VType) -> Column:
    if t.kind == "ts":
        return c.cast("timestamp_ntz")
    if t.kind == "date":
        return c.cast("timestamp_ntz")
    return text_of(c, t).try_cast("timestamp_ntz")


def unify(a: VType, b: VType) -> VType:
    """A type that both can take."""
    if a == b:
        return a
    if a.kind == b.kind == "iri":
        return VType("iri")
    if a.numeric and b.numeric:
        return VType("dbl")
    return VType("term")


def coerce(c: Column, t: VType, to: VType) -> Column:
    if t == to:
        return c
    if to.kind == "term":
        return to_term(c, t)
    if to.kind == "iri":
        return text_of(c, t)
    return number_of(c, t)


def truth(c: Column, t: VType) -> Column:
    """Effective boolean value; null is an error, and a filter drops the row."""
    if t.kind == "bool":
        return c
    if t.kind == "str":
        return c != ""
    if t.kind == "lang":
        return c["lex"] != ""
    if t.numeric:
        return c.isNotNull() & ~F.isnan(c.cast("double")) & (c != 0) if t.kind == "dbl" else c != 0
    if t.kind == "term":
        boolean = F.when(c["dt"] == XSD + "boolean", c["lex"].isin("true", "1"))
        plain = F.when(c["dt"].isin(XSD + "string", RDF + "langString"), c["lex"] != "")
        return F.coalesce(boolean, number_of(c, t) != 0, plain)
    return F.lit(None).cast("boolean")
