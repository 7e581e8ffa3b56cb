"""Syntax of graph queries as plain dataclasses.

Patterns and expressions are immutable, so rewrites build new trees.  ``children``/``rebuild`` give one
generic way to walk and change any node; the rewrites and the printer rest on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def hidden(self) -> bool:
        """Blank nodes and path joints: bound during matching, never visible."""
        return self.name.startswith("_")


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = XSD + "string"
    lang: str = ""


Term = Var | Iri | Lit


# ---- property paths
@dataclass(frozen=True)
class PathSeq:
    parts: tuple


@dataclass(frozen=True)
class PathAlt:
    parts: tuple


@dataclass(frozen=True)
class PathInv:
    path: Any


@dataclass(frozen=True)
class PathMod:
    path: Any
    mod: str  # ? * +


@dataclass(frozen=True)
class PathNot:
    parts: tuple  # of (Iri, inverse)


# ---- patterns
@dataclass(frozen=True)
class Triple:
    s: Term
    p: Any
    o: Term


@dataclass(frozen=True)
class Group:
    parts: tuple = ()


@dataclass(frozen=True)
class OptionalP:
    group: Group


@dataclass(frozen=True)
class UnionP:
    branches: tuple


@dataclass(frozen=True)
class MinusP:
    group: Group


@dataclass(frozen=True)
class GraphP:
    name: Term
    group: Group


@dataclass(frozen=True)
class ServiceP:
    name: Term
    group: Group
    silent: bool = False


@dataclass(frozen=True)
class Filter:
    expr: Any


@dataclass(frozen=True)
class Bind:
    expr: Any
    var: Var


@dataclass(frozen=True)
class Values:
    vars: tuple
    rows: tuple  # of tuples of terms; None is UNDEF


@dataclass(frozen=True)
class SubSelect:
    query: Query


# ---- expressions
@dataclass(frozen=True)
class Op:
    """A prefix or infix operator, or IN / NOT IN (the operands after the first are the list)."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    """A built-in function (upper-case name) or a cast (the datatype's IRI)."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    group: Group
    negated: bool = False


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any  # None is *
    distinct: bool = False
    sep: str = " "


# ---- queries
@dataclass(frozen=True)
class Projected:
    expr: Any
    var: Var


@dataclass(frozen=True)
class OrderKey:
    expr: Any
    descending: bool = False


@dataclass(frozen=True)
class Query:
    form: str  # SELECT ASK CONSTRUCT DESCRIBE
    where: Group = Group()
    projection: tuple = ()  # of Projected; empty is *
    distinct: bool = False
    group_by: tuple = ()  # of Projected
    having: tuple = ()
    order_by: tuple = ()
    limit: int | None = None
    offset: int | None = None
    values: Values | None = None
    template: tuple = ()  # CONSTRUCT
    targets: tuple = ()  # DESCRIBE
    graphs: tuple = ()
    named_graphs: tuple = ()

    def with_(self, **changes) -> Query:
        return replace(self, **changes)


def children(node: Any) -> Iterator[Any]:
    """The nodes directly below a node."""
    values = (getattr(node, f.name) for f in fields(node)) if is_dataclass(node) else node if isinstance(node, tuple) else ()
    for v in values:
        if isinstance(v, tuple) or is_dataclass(v):
            yield v


def walk(node: Any) -> Iterator[Any]:
    """A node and all below it, each before its children."""
    yield node
    for c in children(node):
        yield from walk(c)


def rebuild(node: Any, change: Callable[[Any], Any]) -> Any:
    """The tree with every node replaced by ``change(node)``, children first."""
    if isinstance(node, tuple):
        return tuple(rebuild(x, change) for x in node)
    if is_dataclass(node):
        new = {f.name: rebuild(getattr(node, f.name), change) for f in fields(node)}
        return change(type(node)(**new))
    return node


def variables(node: Any) -> list[str]:
    """Names of the visible variables of a tree, in the order of appearance."""
    seen: dict[str, None] = {}
    for n in walk(node):
        if isinstance(n, Var) and not n.hidden:
            seen[n.name] = None
    return list(seen)


def in_scope(group: Group) -> list[str]:
    """Names of the variables that a group can bind: what ``SELECT *`` means."""
    seen: dict[str, None] = {}
    for part in group.parts:
        if isinstance(part, Triple):
            names = variables((part.s, part.p, part.o))
        elif isinstance(part, OptionalP | GraphP | ServiceP):
            names = [*variables(getattr(part, "name", ())), *in_scope(part.group)]
        elif isinstance(part, Group):
            names = in_scope(part)
        elif isinstance(part, UnionP):
            names = [n for b in part.branches for n in in_scope(b)]
        elif isinstance(part, Bind):
            names = [part.var.name]
        elif isinstance(part, Values):
            names = [v.name for v in part.vars]
        elif isinstance(part, SubSelect):
            names = projected_names(part.query)
        else:
            names = []
        seen.update(dict.fromkeys(names))
    return list(seen)


def projected_names(query: Query) -> list[str]:
    return [p.var.name for p in query.projection] if query.projection else in_scope(query.where)
