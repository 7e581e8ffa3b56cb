"""SPARQL expressions as Spark columns.

``compile_expr`` gives a column and its type.  An error is null: every partial function is a ``try_``
form, and the three-valued logic of SQL is SPARQL's treatment of errors in ``&&``, ``||`` and ``!``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.terms import NUMERIC, VType, coerce, datatype_of, number_of, text_of, time_of, to_term, truth, unify
from quillgraph.plans import ast as A

STR, INT, DBL, BOOL, IRI, TERM_T = VType("str"), VType("int"), VType("dbl"), VType("bool"), VType("iri"), VType("term")
_INTEGERS = ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "nonPositiveInteger", "negativeInteger", "positiveInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")
_TIMES = ("dateTime", "date", "gYear", "gYearMonth")


class Unsupported(ValueError):
    """The engine has no meaning for this construct."""


def literal(t: A.Term) -> tuple[Column, VType]:
    """A constant as a native column where its datatype has one."""
    if isinstance(t, A.Iri):
        return F.lit(t.value), IRI
    name = t.dt.removeprefix(A.XSD)
    if t.lang:
        return F.struct(F.lit(t.lex).alias("lex"), F.lit(t.lang).alias("lang")), VType("lang")
    if t.dt == A.XSD + "string":
        return F.lit(t.lex), STR
    if name in _INTEGERS and t.lex.lstrip("+-").isdigit():
        return F.lit(int(t.lex)).cast("bigint"), INT
    if name in ("decimal", "double", "float"):
        return F.lit(t.lex).try_cast("double"), DBL
    if name == "boolean":
        return F.lit(t.lex in ("true", "1")), BOOL
    if name in _TIMES:
        return F.lit(full_time(t.lex)).try_cast("timestamp_ntz"), VType("ts")
    return F.struct(F.lit(2).alias("kind"), F.lit(t.lex).alias("lex"), F.lit(t.dt).alias("dt"), F.lit("").alias("lang")), TERM_T


def full_time(lex: str) -> str:
    """A year or a month as its first day; a trailing zone offset is dropped."""
    if lex[-6:-5] in "+-" and lex[-3:-2] == ":":
        lex = lex[:-6]
    parts = lex.lstrip("-").split("-")
    return lex + "-01-01" if len(parts) == 1 else lex + "-01" if len(parts) == 2 else lex


def compare(op: str, a: tuple[Column, VType], b: tuple[Column, VType]) -> Column:
    """``=`` and the orderings, by the types of both sides; no common type is an error."""
    (x, s), (y, t) = a, b
    num = lambda v: v.numeric or v.kind == "bool"
    when = lambda v: v.kind in ("ts", "date")
    text = lambda v: v.kind in ("str", "lang")
    if num(s) and num(t):
        l, r = (x, y) if s == t else (number_of(x, s), number_of(y, t))
    elif when(s) or when(t):
        l, r = time_of(x, s), time_of(y, t)
    elif s.kind == t.kind == "iri":
        l, r = (x, y) if s == t else (text_of(x, s), text_of(y, t))
    elif (num(s) and t.kind == "term") or (num(t) and s.kind == "term"):
        l, r = number_of(x, s), number_of(y, t)
    elif s.kind == t.kind == "lang" and op in ("=", "!="):
        l, r = F.struct(x["lex"], F.lower(x["lang"])), F.struct(y["lex"], F.lower(y["lang"]))
    elif text(s) and text(t):
        if s.kind != t.kind and op in ("=", "!="):
            return F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "!="))
        l, r = text_of(x, s), text_of(y, t)
    elif op in ("=", "!="):
        l, r = to_term(x, s), to_term(y, t)
        if s.kind == t.kind == "term":  # numbers of two datatypes may be equal
            same = F.coalesce(number_of(l, TERM_T) == number_of(r, TERM_T), l == r)
            return same if op == "=" else ~same
    else:
        p, q = to_term(x, s), to_term(y, t)
        by = {"<": lambda m, n: m < n, ">": lambda m, n: m > n, "<=": lambda m, n: m <= n, ">=": lambda m, n: m >= n}[op]
        both = number_of(p, TERM_T).isNotNull() & number_of(q, TERM_T).isNotNull()
        return F.when(both, by(number_of(p, TERM_T), number_of(q, TERM_T))).when((p["kind"] == 2) & (q["kind"] == 2) & (p["dt"] == q["dt"]), by(p["lex"], q["lex"]))
    return {"=": lambda: l == r, "!=": lambda: l != r, "<": lambda: l < r, ">": lambda: l > r, "<=": lambda: l <= r, ">=": lambda: l >= r}[op]()


def arithmetic(op: str, a: tuple[Column, VType], b: tuple[Column, VType]) -> tuple[Column, VType]:
    (x, s), (y, t) = a, b
    if s == t == INT and op != "/":
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), INT
    l, r = number_of(x, s), number_of(y, t)
    if op == "/":
        return F.try_divide(l, r), DBL
    return {"+": l + r, "-": l - r, "*": l * r}[op], DBL


def _flags(pattern: Column, flags: Column | None) -> Column:
    return pattern if flags is None else F.concat(F.lit("(?"), flags, F.lit(")"), pattern)


def _zone(lex: Column) -> Column:
    return F.regexp_extract(lex, r"(Z|[+-]\d\d:\d\d)$", 1)


def compile_expr(e: object, lookup: Callable[[str], tuple[Column, VType] | None], exists: Callable[[A.Exists], Column] | None = None) -> tuple[Column, VType]:
    """``lookup`` gives the column of a variable (None: never bound); ``exists`` that of an EXISTS test."""
    go = lambda x: compile_expr(x, lookup, exists)
    if isinstance(e, A.Var):
        return lookup(e.name) or (F.lit(None).cast("string"), STR)
    if isinstance(e, A.Iri | A.Lit):
        return literal(e)
    if isinstance(e, A.Exists):
        if exists is None:
            raise Unsupported("EXISTS is not allowed here")
        return exists(e), BOOL
    if isinstance(e, A.Op):
        if e.name in ("&&", "||"):
            l, r = (truth(*go(x)) for x in e.args)
            return (l & r if e.name == "&&" else l | r), BOOL
        if e.name == "!":
            return ~truth(*go(e.args[0])), BOOL
        if e.name == "neg":
            c, t = go(e.args[0])
            return (-c, INT) if t == INT else (-number_of(c, t), DBL)
        if e.name in ("IN", "NOT IN"):
            first = go(e.args[0])
            same = reduce(lambda p, q: p | q, (compare("=", first, go(x)) for x in e.args[1:]), F.lit(False))
            return (same if e.name == "IN" else ~same), BOOL
        if e.name in ("+", "-", "*", "/"):
            return arithmetic(e.name, go(e.args[0]), go(e.args[1]))
        return compare(e.name, go(e.args[0]), go(e.args[1])), BOOL
    if isinstance(e, A.Call):
        return call(e, go)
    raise Unsupported(f"no value for {e!r}")


def cast(name: str, c: Column, t: VType) -> tuple[Column, VType]:
    """A cast by the local name of an XSD datatype."""
    lex = F.trim(text_of(c, t))
    if name == "string":
        return text_of(c, t), STR
    if name in _INTEGERS:
        if t.numeric or t.kind == "bool":
            return c.try_cast("bigint"), INT
        return F.when(lex.rlike(r"^[+-]?\d+$"), lex.try_cast("bigint")), INT
    if name in ("double", "float", "decimal"):
        return F.coalesce(number_of(c, t), lex.try_cast("double")), DBL
    if name == "boolean":
        if t.numeric:
            return c != 0, BOOL
        return F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False), BOOL
    if name in ("dateTime", "date"):
        v = time_of(c, t)
        return (v, VType("ts")) if name == "dateTime" else (v.cast("date"), VType("date"))
    raise Unsupported(f"no cast to {name}")


def call(e: A.Call, go: Callable) -> tuple[Column, VType]:
    name = e.name
    if name.startswith(A.XSD):
        return cast(name[len(A.XSD) :], *go(e.args[0]))
    if name not in _CALLS:
        raise Unsupported(f"unknown function {name}")
    if name in ("TZ", "TIMEZONE") and isinstance(e.args[0], A.Lit):  # a native time has lost its zone
        return _CALLS[name]((F.lit(e.args[0].lex), STR))
    return _CALLS[name](*[go(a) for a in e.args])


def _str(p: tuple[Column, VType]) -> Column:
    return text_of(*p)


def _like(p: tuple[Column, VType], c: Column) -> tuple[Column, VType]:
    """A string result with the language of its argument."""
    if p[1].kind == "lang":
        return F.struct(c.alias("lex"), p[0]["lang"].alias("lang")), p[1]
    return c, STR


def _number(f: Callable[[Column], Column]):
    def apply(p):
        return (f(p[0]).cast("bigint"), INT) if p[1] == INT else (f(number_of(*p)).cast("double"), DBL)

    return apply


def _clock(f: Callable[[Column], Column], kind: VType = INT):
    return lambda p: (f(time_of(*p)).cast("bigint" if kind == INT else "double"), kind)


def _hash(f: Callable[[Column], Column]):
    return lambda p: (f(_str(p).cast("binary")), STR)


def _language(p):
    c, t = p
    if t.kind in ("lang", "term"):
        return F.coalesce(F.lower(c["lang"]), F.lit("")) if t.kind == "lang" else F.when(c["kind"] == 2, F.coalesce(c["lang"], F.lit("")))
    return F.when(c.isNotNull(), F.lit("")) if t.kind != "iri" else F.lit(None).cast("string")


def _kind(test: Callable[[VType], bool], term_kind: int):
    return lambda p: (F.when(p[0].isNotNull(), p[0]["kind"] == term_kind if p[1].kind == "term" else F.lit(test(p[1]))), BOOL)


def _if(c, a, b):
    t = unify(a[1], b[1])
    test = truth(*c)
    return F.when(test, coerce(a[0], a[1], t)).when(~test, coerce(b[0], b[1], t)), t


def _coalesce(*ps):
    t = reduce(unify, (p[1] for p in ps))
    return F.coalesce(*(coerce(c, s, t) for c, s in ps)), t


def _same(a, b):
    if a[1] == b[1] and a[1].kind != "dbl":
        return a[0] == b[0], BOOL
    return to_term(*a) == to_term(*b), BOOL


def _matches(lang, wanted):
    l, w = F.lower(_str(lang)), F.lower(_str(wanted))
    return F.when(w == "*", l != "").otherwise((l == w) | F.startswith(l, F.concat(w, F.lit("-")))), BOOL


def _regex(s, p, f=None):
    return F.rlike(_str(s), _flags(_str(p), _str(f) if f else None)), BOOL


def _before(s, x):
    place = F.instr(_str(s), _str(x))
    return _like(s, F.when(place > 0, F.substring(_str(s), F.lit(1), (place - 1).cast("int"))).otherwise(""))


def _after(s, x):
    place = F.instr(_str(s), _str(x))
    return _like(s, F.when(place > 0, F.substring(_str(s), (place + F.length(_str(x))).cast("int"), F.length(_str(s)))).otherwise(""))


def _substr(s, start, length=None):
    """1-based; a start below 1 counts against the length."""
    b = F.round(number_of(*start)).cast("int")
    end = F.lit((1 << 31) - 1) if length is None else F.least(b.cast("bigint") + F.round(number_of(*length)).cast("bigint"), F.lit((1 << 31) - 1)).cast("int")
    first = F.greatest(b, F.lit(1))
    return _like(s, F.substring(_str(s), first, F.greatest(end - first, F.lit(0))))


def _tz(p):
    zone = _zone(_str(p))
    return zone, STR


def _timezone(p):
    zone = _zone(_str(p))
    sign = F.when(F.startswith(zone, F.lit("-")), "-").otherwise("")
    h, m = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    body = F.concat(sign, F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    return F.when(zone == "Z", "PT0S").when(zone == "", None).when((h == 0) & (m == 0), "PT0S").otherwise(body), STR


def _uri(p):
    out = F.url_encode(_str(p))
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out, STR


def _blank(*p):
    lex = F.concat(F.lit("b"), _str(p[0])) if p else F.uuid()
    return F.struct(F.lit(1).alias("kind"), lex.alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit("").alias("lang")), TERM_T


def _typed(s, dt):
    return F.struct(F.lit(2).alias("kind"), _str(s).alias("lex"), _str(dt).alias("dt"), F.lit("").alias("lang")), TERM_T


_CALLS: dict[str, Callable] = {
    "STR": lambda p: (_str(p), STR),
    "LANG": lambda p: (_language(p), STR),
    "DATATYPE": lambda p: (datatype_of(*p), IRI),
    "IRI": lambda p: (_str(p), IRI),
    "BNODE": _blank,
    "ABS": _number(F.abs),
    "CEIL": _number(F.ceil),
    "FLOOR": _number(F.floor),
    "ROUND": _number(lambda c: F.floor(c + 0.5)),  # ties go up, as in XPath
    "STRLEN": lambda p: (F.length(_str(p)).cast("bigint"), INT),
    "UCASE": lambda p: _like(p, F.upper(_str(p))),
    "LCASE": lambda p: _like(p, F.lower(_str(p))),
    "ENCODE_FOR_URI": _uri,
    "YEAR": _clock(F.year),
    "MONTH": _clock(F.month),
    "DAY": _clock(F.dayofmonth),
    "HOURS": _clock(F.hour),
    "MINUTES": _clock(F.minute),
    "SECONDS": _clock(lambda c: F.extract(F.lit("SECOND"), c), DBL),
    "TZ": _tz,
    "TIMEZONE": _timezone,
    "MD5": _hash(F.md5),
    "SHA1": _hash(F.sha1),
    "SHA256": _hash(lambda c: F.sha2(c, 256)),
    "SHA384": _hash(lambda c: F.sha2(c, 384)),
    "SHA512": _hash(lambda c: F.sha2(c, 512)),
    "ISIRI": _kind(lambda t: t.kind == "iri", 0),
    "ISBLANK": _kind(lambda t: False, 1),
    "ISLITERAL": _kind(lambda t: t.kind != "iri", 2),
    "ISNUMERIC": lambda p: (F.when(p[0].isNotNull(), number_of(*p).isNotNull() if p[1].kind == "term" else F.lit(p[1].kind in NUMERIC)), BOOL),
    "LANGMATCHES": _matches,
    "CONTAINS": lambda a, b: (F.contains(_str(a), _str(b)), BOOL),
    "STRSTARTS": lambda a, b: (F.startswith(_str(a), _str(b)), BOOL),
    "STRENDS": lambda a, b: (F.endswith(_str(a), _str(b)), BOOL),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "STRLANG": lambda s, l: (F.struct(_str(s).alias("lex"), F.lower(_str(l)).alias("lang")), VType("lang")),
    "STRDT": _typed,
    "SAMETERM": _same,
    "RAND": lambda: (F.rand(), DBL),
    "NOW": lambda: (F.current_timestamp().cast("timestamp_ntz"), VType("ts")),
    "UUID": lambda: (F.concat(F.lit("urn:uuid:"), F.uuid()), IRI),
    "STRUUID": lambda: (F.uuid(), STR),
    "BOUND": lambda p: (p[0].isNotNull(), BOOL),
    "CONCAT": lambda *ps: (F.concat(*map(_str, ps)) if ps else F.lit(""), STR),
    "COALESCE": _coalesce,
    "IF": _if,
    "REGEX": _regex,
    "SUBSTR": _substr,
    "REPLACE": lambda s, p, r, f=None: _like(s, F.regexp_replace(_str(s), _flags(_str(p), _str(f) if f else None), _str(r))),
}
