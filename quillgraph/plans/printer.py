"""Queries as text.  What is printed parses to an equal tree."""

from __future__ import annotations

from typing import Any

from quillgraph.plans import ast as A
from quillgraph.plans.parser import PREFIXES

_QUOTED = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def term(t: Any) -> str:
    if t is None:
        return "UNDEF"
    if isinstance(t, A.Var):
        return ("_:" + t.name[1:]) if t.hidden else "?" + t.name
    if isinstance(t, A.Iri):
        if t.value == A.RDF + "type":
            return "rdf:type"
        for prefix, base in PREFIXES.items():
            local = t.value[len(base) :]
            if t.value.startswith(base) and local and all(c.isalnum() or c == "_" for c in local) and prefix:
                return f"{prefix}:{local}"
        return f"<{t.value}>"
    if isinstance(t, A.Lit):
        if t.dt in (A.XSD + "integer", A.XSD + "decimal", A.XSD + "double", A.XSD + "boolean") and t.lex and not t.lex.startswith("+"):
            shape = {"integer": t.lex.lstrip("-").isdigit(), "boolean": t.lex in ("true", "false"), "decimal": "." in t.lex and t.lex.lstrip("-").replace(".", "", 1).isdigit()}
            if shape.get(t.dt[len(A.XSD) :]):
                return t.lex
        body = '"' + "".join(_QUOTED.get(c, c) for c in t.lex) + '"'
        if t.lang:
            return f"{body}@{t.lang}"
        return body if t.dt == A.XSD + "string" else f"{body}^^{term(A.Iri(t.dt))}"
    raise TypeError(f"not a term: {t!r}")


def path(p: Any) -> str:
    if isinstance(p, A.PathSeq):
        return "(" + "/".join(map(path, p.parts)) + ")"
    if isinstance(p, A.PathAlt):
        return "(" + "|".join(map(path, p.parts)) + ")"
    if isinstance(p, A.PathInv):
        return "^" + (path(p.path) if not isinstance(p.path, A.PathMod) else f"({path(p.path)})")
    if isinstance(p, A.PathMod):
        inner = path(p.path)
        return (f"({inner})" if isinstance(p.path, A.PathInv | A.PathMod | A.PathNot) else inner) + p.mod
    if isinstance(p, A.PathNot):
        return "!(" + "|".join(("^" if inv else "") + term(i) for i, inv in p.parts) + ")"
    return term(p)


def expr(e: Any) -> str:
    if isinstance(e, A.Op):
        if e.name in ("IN", "NOT IN"):
            return f"({expr(e.args[0])} {e.name} ({', '.join(map(expr, e.args[1:]))}))"
        if len(e.args) == 1:
            return f"({'-' if e.name == 'neg' else e.name} {expr(e.args[0])})"
        return f"({expr(e.args[0])} {e.name} {expr(e.args[1])})"
    if isinstance(e, A.Call):
        name = e.name if e.name.isupper() or "_" in e.name else term(A.Iri(e.name))
        return f"{name}({', '.join(map(expr, e.args))})"
    if isinstance(e, A.Exists):
        return ("NOT " if e.negated else "") + "EXISTS " + group(e.group)
    if isinstance(e, A.Agg):
        sep = f" ; SEPARATOR={term(A.Lit(e.sep))}" if e.name == "GROUP_CONCAT" and e.sep != " " else ""
        return f"{e.name}({'DISTINCT ' if e.distinct else ''}{'*' if e.arg is None else expr(e.arg)}{sep})"
    return term(e)


def values(v: A.Values) -> str:
    rows = " ".join("(" + " ".join(map(term, r)) + ")" for r in v.rows)
    return f"VALUES ({' '.join(map(term, v.vars))}) {{ {rows} }}"


def part(p: Any) -> str:
    if isinstance(p, A.Triple):
        return f"{term(p.s)} {path(p.p)} {term(p.o)} ."
    if isinstance(p, A.Group):
        return group(p)
    if isinstance(p, A.OptionalP):
        return "OPTIONAL " + group(p.group)
    if isinstance(p, A.UnionP):
        return " UNION ".join(map(group, p.branches))
    if isinstance(p, A.MinusP):
        return "MINUS " + group(p.group)
    if isinstance(p, A.GraphP):
        return f"GRAPH {term(p.name)} {group(p.group)}"
    if isinstance(p, A.ServiceP):
        return f"SERVICE {'SILENT ' if p.silent else ''}{term(p.name)} {group(p.group)}"
    if isinstance(p, A.Filter):
        return f"FILTER ({expr(p.expr)})"
    if isinstance(p, A.Bind):
        return f"BIND ({expr(p.expr)} AS {term(p.var)})"
    if isinstance(p, A.Values):
        return values(p)
    if isinstance(p, A.SubSelect):
        return "{ " + query(p.query) + " }"
    raise TypeError(f"not a pattern: {p!r}")


def group(g: A.Group) -> str:
    return "{ " + " ".join(map(part, g.parts)) + " }"


def _projected(p: A.Projected) -> str:
    return term(p.var) if p.expr == p.var else f"({expr(p.expr)} AS {term(p.var)})"


def query(q: A.Query) -> str:
    out = [q.form]
    if q.form == "SELECT":
        out += ["DISTINCT"] * q.distinct + [" ".join(map(_projected, q.projection)) or "*"]
    elif q.form == "CONSTRUCT":
        out.append("{ " + " ".join(map(part, q.template)) + " }")
    elif q.form == "DESCRIBE":
        out.append(" ".join(map(term, q.targets)) or "*")
    out += [f"FROM {term(g)}" for g in q.graphs] + [f"FROM NAMED {term(g)}" for g in q.named_graphs]
    if q.where.parts or q.form != "DESCRIBE":
        out.append("WHERE " + group(q.where))
    if q.group_by:
        out.append("GROUP BY " + " ".join(map(_projected, q.group_by)))
    if q.having:
        out.append("HAVING " + " ".join(f"({expr(h)})" for h in q.having))
    if q.order_by:
        out.append("ORDER BY " + " ".join(f"{'DESC' if k.descending else 'ASC'}({expr(k.expr)})" for k in q.order_by))
    if q.limit is not None:
        out.append(f"LIMIT {q.limit}")
    if q.offset is not None:
        out.append(f"OFFSET {q.offset}")
    if q.values:
        out.append(values(q.values))
    return " ".join(out)
