"""Graph queries as DataFrame plans.

Groups become joins of solutions.  The patterns of one subject are read by one scan of its table; classes
of nodes are inferred from the predicates, so keys join as native columns.  Catalyst sees plain
projections, filters and equi-joins, and does the pushing and ordering.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.scalar import Unsupported, compile_expr, literal
from quillgraph.functions.terms import NUMERIC, VType, coerce, number_of, text_of, to_term, truth, unify
from quillgraph.operators.closure import reachable, reachable_from
from quillgraph.plans import ast as A
from quillgraph.plans.parser import parse
from quillgraph.sources.registry import NS, Edge, Graph

RDF_TYPE = A.RDF + "type"


@dataclass
class Solutions:
    """Bindings: a column for each variable, its type, and which may be unbound.

    ``patterns``, where known, are the sets of variables that some row leaves unbound together.
    """

    df: DataFrame
    types: dict[str, VType] = field(default_factory=dict)
    maybe: frozenset = frozenset()
    patterns: frozenset | None = None

    def lookup(self, name: str) -> tuple[Column, VType] | None:
        return (self.df[name], self.types[name]) if name in self.types else None

    def by_name(self, name: str) -> tuple[Column, VType] | None:
        return (F.col(f"`{name}`"), self.types[name]) if name in self.types else None

    def retype(self, wanted: dict[str, VType]) -> Solutions:
        changes = {n: coerce(self.df[n], self.types[n], t) for n, t in wanted.items() if n in self.types and self.types[n] != t}
        return Solutions(self.df.withColumns(changes), {**self.types, **{n: wanted[n] for n in changes}}, self.maybe, self.patterns) if changes else self

    def keep(self, names: list[str]) -> Solutions:
        have = [n for n in names if n in self.types]
        return Solutions(self.df.select(*(F.col(f"`{n}`") for n in have)), {n: self.types[n] for n in have}, self.maybe & set(have))


def shared(a: Solutions, b: Solutions) -> list[str]:
    return [n for n in a.types if n in b.types]


def aligned(a: Solutions, b: Solutions) -> tuple[Solutions, Solutions, list[str]]:
    """Both sides with one type for each shared variable."""
    names = shared(a, b)
    both = {n: unify(a.types[n], b.types[n]) for n in names}
    return a.retype(both), b.retype(both), names


def renamed(b: Solutions, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    to = {n: f"{n}__r" for n in names}
    return b.df.select(*(F.col(f"`{n}`").alias(to.get(n, n)) for n in b.types)), to


def _unbound_parts(side: Solutions, names: list[str]) -> list[tuple[DataFrame, set[str]]]:
    """A side's rows by which of some names, that may be unbound, are."""
    parts = [(side.df, set())]
    for n in names:
        if n in side.maybe:
            c = F.col(f"`{n}`")
            parts = [(df.filter(test), none | more) for df, none in parts for test, more in ((c.isNotNull(), set()), (c.isNull(), {n}))]
    known = None if side.patterns is None else [set(p) & set(names) for p in side.patterns]
    return parts if known is None else [(df, none) for df, none in parts if none in known]


#: Names that may be unbound, of both sides, up to which a join is taken apart by which of them are.
_APART = 4


def _by_bound(a: Solutions, b: Solutions, names: list[str], need: bool = False):
    """Pairs of a part of ``a`` and the parts of ``b`` with the names that are bound in both: equi-keys all.

    ``need`` leaves out parts that share no bound name.
    """
    for left, none_a in _unbound_parts(a, names):
        rights = []
        for right, none_b in _unbound_parts(b, names):
            keys = [n for n in names if n not in none_a | none_b]
            if keys or not need:
                rights.append((Solutions(right, b.types, frozenset()), keys))
        yield left, rights


def _on(keys: list[str], to: dict[str, str]) -> Column:
    return reduce(lambda p, q: p & q, (F.col(f"`{n}`") == F.col(f"`{to[n]}`") for n in keys), F.lit(True))


def join(a: Solutions, b: Solutions, how: str = "inner", extra=None) -> Solutions:
    """Joins on shared variables; an unbound one is compatible with anything.

    ``extra`` compiles a further condition over both sides (the filter of an OPTIONAL).  Rows are taken apart by
    which shared variables are unbound, so that each part joins by equality of those that are bound.
    """
    a, b, names = aligned(a, b)
    loose = [n for n in names if n in a.maybe or n in b.maybe]
    types = {**b.types, **a.types}
    test = None if extra is None else extra(lambda n: (F.col(f"`{n}`"), types[n]) if n in types else None)
    maybe = (a.maybe | b.maybe) - {n for n in names if n not in loose or (n not in a.maybe or n not in b.maybe)}
    if how == "left":
        maybe |= {n for n in b.types if n not in a.types}
        maybe |= {n for n in names if n in a.maybe}
    apart = loose and sum((n in a.maybe) + (n in b.maybe) for n in loose) <= _APART
    if not apart:
        return _join_at_once(a, b, names, loose, how, test, types, maybe)
    if how == "inner":
        parts = [_join_at_once(Solutions(left, a.types), right, names, [], how, test, types, maybe, keys).df for left, rights in _by_bound(a, b, names) for right, keys in rights]
        return Solutions(reduce(DataFrame.unionByName, parts), types, frozenset(maybe))
    if how == "left":
        pairs, alone = join(a, b, "inner", extra), join(a, b, "left_anti", extra)
        rest = alone.df.select(*(F.col(f"`{n}`") if n in a.types else F.lit(None).cast(pairs.df.schema[n].dataType).alias(n) for n in types))
        return Solutions(pairs.df.select(*(F.col(f"`{n}`") for n in types)).unionByName(rest), types, frozenset(maybe))
    parts = []
    for left, rights in _by_bound(a, b, names):
        if how == "left_anti":
            for right, keys in rights:
                left = _join_at_once(Solutions(left, a.types), right, names, [], how, test, types, maybe, keys).df
            parts.append(left)
        else:  # a row that one part has matched is not looked for in the next
            for right, keys in rights:
                parts.append(_join_at_once(Solutions(left, a.types), right, names, [], how, test, types, maybe, keys).df)
                left = _join_at_once(Solutions(left, a.types), right, names, [], "left_anti", test, types, maybe, keys).df
    return Solutions(reduce(DataFrame.unionByName, parts), a.types, a.maybe)


def _join_at_once(a: Solutions, b: Solutions, names: list[str], loose: list[str], how: str, test, types: dict[str, VType], maybe, keys: list[str] | None = None) -> Solutions:
    """One join: by equality of ``keys`` (default: all shared names that are not loose), and loosely of the loose ones."""
    right, to = renamed(b, names)
    keys = [n for n in names if n not in loose] if keys is None else keys
    cond = [F.col(f"`{n}`") == F.col(f"`{to[n]}`") for n in keys]
    cond += [(F.col(f"`{n}`") == F.col(f"`{to[n]}`")) | F.col(f"`{n}`").isNull() | F.col(f"`{to[n]}`").isNull() for n in loose]
    if test is not None:
        cond.append(test)
    on = reduce(lambda p, q: p & q, cond) if cond else F.lit(True)
    if how in ("left_semi", "left_anti"):
        return Solutions(a.df.join(right, on, how), a.types, a.maybe)
    df = a.df.join(right, on, how) if cond or how != "inner" else a.df.crossJoin(right)
    whole = [n for n in names if n in keys and n not in loose]
    cols = [F.col(f"`{n}`") if n in whole or n not in to else F.coalesce(f"`{n}`", f"`{to[n]}`").alias(n) for n in a.types] + [F.col(f"`{n}`") for n in b.types if n not in a.types]
    return Solutions(df.select(*cols).select(*(F.col(f"`{n}`") for n in types)), types, frozenset(maybe))


#: What a filter on the kind of a term says of the edges that can have bound it.
_KIND_TESTS = {
    ("ISIRI", True): lambda g, e: g.is_class(e.target), ("ISIRI", False): lambda g, e: not g.is_class(e.target),
    ("ISLITERAL", True): lambda g, e: not g.is_class(e.target), ("ISLITERAL", False): lambda g, e: g.is_class(e.target),
    ("ISNUMERIC", True): lambda g, e: e.target in NUMERIC,
}


def kind_tests(g: A.Group) -> dict[str, Callable[[Graph, Edge], bool]]:
    """The kinds that the filters of a group demand of its variables."""
    out = {}
    waiting = [p.expr for p in g.parts if isinstance(p, A.Filter)]
    while waiting:
        e, wanted = waiting.pop(), True
        if isinstance(e, A.Op) and e.name == "&&":
            waiting += e.args
            continue
        if isinstance(e, A.Op) and e.name == "!":
            e, wanted = e.args[0], False
        if isinstance(e, A.Call) and (e.name, wanted) in _KIND_TESTS and isinstance(e.args[0], A.Var):
            out[e.args[0].name] = _KIND_TESTS[e.name, wanted]
    return out


class Compiler:
    def __init__(self, graph: Graph, checkpoint=None):
        self.graph = graph
        self.spark: SparkSession = graph.spark
        self.checkpoint = checkpoint
        self.count = itertools.count()
        self.kinds: dict[str, Callable[[Graph, Edge], bool]] = {}

    # ---- terms
    def node_key(self, iri: A.Iri, cls: str | None) -> Column | None:
        """The key of a constant node of a class; None when the IRI is of no such class."""
        head, _, key = iri.value.removeprefix(NS).partition("/")
        if not iri.value.startswith(NS) or not key or (cls is not None and head != cls):
            return None
        native = self.graph.classes.get(head)
        return F.lit(int(key)).cast("bigint") if native and native.native and key.lstrip("-").isdigit() else F.lit(key)

    @staticmethod
    def class_of(t: A.Term) -> str | None:
        return t.value.removeprefix(NS).partition("/")[0] if isinstance(t, A.Iri) and "/" in t.value and t.value.startswith(NS) else None

    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select())

    def empty(self, names: dict[str, VType]) -> Solutions:
        cols = [coerce(F.lit(None).cast("string"), VType("str"), t).alias(n) if t.kind == "term" else F.lit(None).cast("string").alias(n) for n, t in names.items()]
        types = {n: t if t.kind == "term" else VType("str") for n, t in names.items()}
        return Solutions(self.spark.range(0).select(*cols), types)

    # ---- basic graph patterns
    def bgp(self, triples: list[A.Triple], known: dict[str, VType]) -> Solutions:
        triples = list(itertools.chain.from_iterable(self.flatten(t) for t in triples))
        classes = self.infer(triples, known)
        units: list[Solutions] = []
        stars: dict[tuple, list[tuple[Edge, A.Triple]]] = {}
        for t in triples:
            if isinstance(t.p, A.Iri) and t.p.value != RDF_TYPE:
                edges = self.edges_for(t, classes)
                if len(edges) == 1:
                    e = edges[0]
                    stars.setdefault((t.s, e.table, e.key), []).append((e, t))
                    continue
                units.append(self.any_edges(t, edges))
            else:
                units.append(self.pattern(t, classes))
        units += [self.star(s, pairs) for (s, _, _), pairs in stars.items()]
        # constants first, then whatever shares a variable with what is joined
        units.sort(key=lambda u: len(u.types))
        done, rest = units[0] if units else self.unit(), units[1:]
        while rest:
            i = next((i for i, u in enumerate(rest) if shared(done, u)), 0)
            done = join(done, rest.pop(i))
        return done

    def flatten(self, t: A.Triple) -> list[A.Triple]:
        """Sequences and inversions as plain triples."""
        if isinstance(t.p, A.PathInv):
            return self.flatten(A.Triple(t.o, t.p.path, t.s))
        if isinstance(t.p, A.PathSeq):
            nodes = [t.s, *(A.Var(f"_p{next(self.count)}") for _ in t.p.parts[1:]), t.o]
            return [x for a, p, b in zip(nodes, t.p.parts, nodes[1:], strict=False) for x in self.flatten(A.Triple(a, p, b))]
        return [t]

    def infer(self, triples: list[A.Triple], known: dict[str, VType]) -> dict[A.Term, set[str]]:
        """Classes that each subject or object node can have."""
        out: dict[A.Term, set[str]] = {}
        for n, v in known.items():
            if v.kind == "iri" and v.cls:
                out[A.Var(n)] = {v.cls}
        for t in triples:
            for x in (t.s, t.o):
                if self.class_of(x) in self.graph.classes:
                    out[x] = {self.class_of(x)}
            if isinstance(t.p, A.Iri) and t.p.value == RDF_TYPE and isinstance(t.o, A.Iri):
                out[t.s] = {t.o.value.removeprefix(NS)}

        def narrow(x: A.Term, to: set[str]) -> bool:
            old = out.get(x)
            new = to if old is None else old & to
            out[x] = new
            return old != new

        changed = True
        while changed:
            changed = False
            for t in triples:
                if not isinstance(t.p, A.Iri) or t.p.value == RDF_TYPE:
                    continue
                edges = self.edges_for(t, out)
                changed |= narrow(t.s, {e.cls for e in edges})
                targets = {e.target for e in edges}
                if isinstance(t.o, A.Var) and targets and targets <= set(self.graph.classes):
                    changed |= narrow(t.o, targets)
        return out

    def edges_for(self, t: A.Triple, classes: dict[A.Term, set[str]]) -> list[Edge]:
        found = self.graph.by_predicate(t.p.value.removeprefix(NS)) if t.p.value.startswith(NS) else []
        if t.s in classes:
            found = [e for e in found if e.cls in classes[t.s]]
        if t.o in classes:
            found = [e for e in found if e.target in classes[t.o]]
        if isinstance(t.o, A.Lit):
            found = [e for e in found if not self.graph.is_class(e.target)]
        return found

    def star(self, s: A.Term, pairs: list[tuple[Edge, A.Triple]]) -> Solutions:
        """All patterns of one subject on one table, in one scan."""
        first = pairs[0][0]
        df = self.graph.scan(first.table, first.key)
        cols: dict[str, Column] = {}
        types: dict[str, VType] = {}
        conds: list[Column] = []

        def put(name: str, c: Column, t: VType) -> None:
            if name in cols:
                u = unify(types[name], t)
                conds.append(coerce(cols[name], types[name], u) == coerce(c, t, u))
            else:
                cols[name], types[name] = c, t

        if isinstance(s, A.Var):
            put(s.name, F.col("key_"), VType("iri", first.cls))
        else:
            key = self.node_key(s, first.cls)
            conds.append(F.col("key_") == key if key is not None else F.lit(False))
        for e, t in pairs:
            c, vt = self.graph.value(e), self.graph.value_type(e)
            conds.append(F.expr(e.column).isNotNull())
            if isinstance(t.o, A.Var):
                put(t.o.name, c, vt)
            else:
                conds.append(self.equals(c, vt, t.o))
        df = df.filter(reduce(lambda p, q: p & q, conds)).select(*(c.alias(n) for n, c in cols.items()))
        return Solutions(df, types)

    def equals(self, c: Column, t: VType, const: A.Term) -> Column:
        if isinstance(const, A.Iri):
            if t.kind == "iri" and t.cls:
                key = self.node_key(const, t.cls)
                return c == key if key is not None else F.lit(False)
            return text_of(c, t) == const.value
        v, vt = literal(const)
        if t.numeric and vt.numeric:
            return number_of(c, t) == number_of(v, vt) if t != vt else c == v
        if t == vt:
            return c == v
        return to_term(c, t) == to_term(v, vt)

    def any_edges(self, t: A.Triple, edges: list[Edge]) -> Solutions:
        """A predicate that several classes have (or none): the union of its tables."""
        parts = [self.star(t.s, [(e, t)]) for e in edges]
        if not parts:
            names = {x.name: VType("str") for x in (t.s, t.o) if isinstance(x, A.Var)}
            return self.empty(names)
        return reduce(union, parts)

    def pattern(self, t: A.Triple, classes: dict[A.Term, set[str]]) -> Solutions:
        if isinstance(t.p, A.PathAlt):
            return reduce(union, (self.bgp([A.Triple(t.s, p, t.o)], {}) for p in t.p.parts))
        if isinstance(t.p, A.PathMod):
            return self.closure(t, classes)
        if isinstance(t.p, A.PathNot):
            return self.negated(t)
        if isinstance(t.p, A.Iri):  # rdf:type
            return self.typed(t, classes)
        return self.any_predicate(t, classes)

    def typed(self, t: A.Triple, classes: dict[A.Term, set[str]]) -> Solutions:
        names = sorted(classes.get(t.s, set(self.graph.classes))) if isinstance(t.o, A.Var) else [t.o.value.removeprefix(NS)]
        parts = []
        for cls in names:
            edge = next((e for e in self.graph.edges if e.cls == cls), None)
            if edge is None:
                continue
            df = self.graph.scan(edge.table, edge.key)
            cols, types = [], {}
            if isinstance(t.s, A.Var):
                cols.append(F.col("key_").alias(t.s.name))
                types[t.s.name] = VType("iri", cls)
            else:
                key = self.node_key(t.s, cls)
                df = df.filter(F.col("key_") == key if key is not None else F.lit(False))
            if isinstance(t.o, A.Var):
                cols.append(F.lit(NS + cls).alias(t.o.name))
                types[t.o.name] = VType("iri")
            parts.append(Solutions(df.select(*cols), types))
        return reduce(union, parts) if parts else self.empty({x.name: VType("str") for x in (t.s, t.o) if isinstance(x, A.Var)})

    def any_predicate(self, t: A.Triple, classes: dict[A.Term, set[str]], edges: list[Edge] | None = None) -> Solutions:
        """A variable predicate: the triples of every edge that fits.  Constant nodes are native keys in the scan."""
        fit = [e for e in (self.graph.edges if edges is None else edges) if (t.s not in classes or e.cls in classes[t.s]) and (t.o not in classes or e.target in classes[t.o])]
        if isinstance(t.o, A.Var) and t.o.name in self.kinds:
            fit = [e for e in fit if self.kinds[t.o.name](self.graph, e)]
        subject = obj = None
        if isinstance(t.s, A.Iri):
            subject = self.node_key(t.s, self.class_of(t.s))
            fit = [e for e in fit if subject is not None and e.cls == self.class_of(t.s)]
        if isinstance(t.o, A.Iri):
            obj = self.node_key(t.o, self.class_of(t.o))
            fit = [e for e in fit if obj is not None and e.target == self.class_of(t.o)]
        if isinstance(t.o, A.Lit):
            fit = [e for e in fit if not self.graph.is_class(e.target)]
        if not fit or isinstance(t.s, A.Lit):
            return self.empty({x.name: VType("str") for x in (t.s, t.p, t.o) if isinstance(x, A.Var)})
        df = self.graph.triples(fit, subject, obj)
        cols: dict[str, Column] = {}
        types: dict[str, VType] = {}
        conds = [F.lit(True)]
        objects = all(self.graph.is_class(e.target) for e in fit)
        o_type = VType("iri") if objects else VType("term")
        for x, c, vt in ((t.s, F.col("s"), VType("iri")), (t.p, F.col("p"), VType("iri")), (t.o, F.col("o.lex") if objects else F.col("o"), o_type)):
            if isinstance(x, A.Lit):
                conds.append(self.equals(c, vt, x))
            elif isinstance(x, A.Iri):
                continue
            elif x.name in cols:
                u = unify(types[x.name], vt)
                conds.append(coerce(cols[x.name], types[x.name], u) == coerce(c, vt, u))
            else:
                cols[x.name], types[x.name] = c, vt
        df = df.filter(reduce(lambda p, q: p & q, conds))
        return Solutions(df.select(*(c.alias(n) for n, c in cols.items())), types)

    def negated(self, t: A.Triple) -> Solutions:
        ahead = {i.value.removeprefix(NS) for i, inv in t.p.parts if not inv}
        back = {i.value.removeprefix(NS) for i, inv in t.p.parts if inv}
        hidden = A.Var(f"_n{next(self.count)}")
        parts = []
        if ahead or not back:
            edges = [e for e in self.graph.edges if e.predicate not in ahead]
            parts.append(self.any_predicate(A.Triple(t.s, hidden, t.o), {}, edges))
        if back:
            edges = [e for e in self.graph.edges if e.predicate not in back]
            parts.append(self.any_predicate(A.Triple(t.o, hidden, t.s), {}, edges))
        names = [x.name for x in (t.s, t.o) if isinstance(x, A.Var)]
        return reduce(union, (p.keep(names) for p in parts))

    def closure(self, t: A.Triple, classes: dict[A.Term, set[str]]) -> Solutions:
        """``p?``, ``p*`` and ``p+``: pairs without repeats, safe on cycles.

        A path of no step joins every node of the graph with itself; where other patterns allow an end only
        some classes, their nodes do.
        """
        a, b = A.Var("_from"), A.Var("_to")
        step = self.bgp([A.Triple(a, t.p.path, b)], {})
        ty = unify(step.types["_from"], step.types["_to"])
        zero = t.p.mod in ("*", "?")
        free = zero and isinstance(t.s, A.Var) and isinstance(t.o, A.Var)
        some = [classes[x] for x in (t.s, t.o) if x in classes and classes[x] <= set(self.graph.classes)]
        if free:
            ty = unify(ty, VType("iri") if some else VType("term"))
        step = step.retype({"_from": ty, "_to": ty})
        pairs = step.df.select(F.col("_from").alias("src"), F.col("_to").alias("dst")).distinct()

        def fixed(x: A.Term) -> Column | None:
            if isinstance(x, A.Var):
                return None
            if isinstance(x, A.Iri) and ty.kind == "iri" and ty.cls:
                key = self.node_key(x, ty.cls)
                return key if key is not None else F.lit(None)
            return coerce(*literal(x), ty)

        s, o = fixed(t.s), fixed(t.o)
        if t.p.mod == "?":
            found = pairs
        elif (s is not None or o is not None) and (ways := self.ways(t.p.path)) is not None:
            found = self.reached(ways, t, s, o, ty)
        else:
            found = reachable(pairs, s, o, self.checkpoint)
        if zero:
            if free:
                every = self.graph.nodes(set.intersection(*some) if some else None)
                nodes = every.select(F.col("n.lex") if ty.kind == "iri" else F.col("n"))
                nodes = nodes.toDF("n")
            else:
                own = [self.spark.range(1).select(x.alias("n")) for x in (s, o) if x is not None]
                nodes = reduce(DataFrame.union, own).distinct()
            found = found.union(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"))).distinct()
        if s is not None:
            found = found.filter(F.col("src") == s)
        if o is not None:
            found = found.filter(F.col("dst") == o)
        if isinstance(t.s, A.Var) and t.s == t.o:
            return Solutions(found.filter("src = dst").select(F.col("src").alias(t.s.name)), {t.s.name: ty})
        cols = {x.name: c for x, c in ((t.s, "src"), (t.o, "dst")) if isinstance(x, A.Var)}
        return Solutions(found.select(*(F.col(c).alias(n) for n, c in cols.items())), dict.fromkeys(cols, ty))

    def ways(self, path: object) -> list[tuple[Edge, bool]] | None:
        """The edges of an alternation of predicates between nodes, each with whether it is inverted; None for other paths."""
        out = []
        for p in path.parts if isinstance(path, A.PathAlt) else (path,):
            p, inverse = (p.path, True) if isinstance(p, A.PathInv) else (p, False)
            if not isinstance(p, A.Iri) or not p.value.startswith(NS):
                return None
            out += [(e, inverse) for e in self.graph.by_predicate(p.value.removeprefix(NS))]
        return list(dict.fromkeys(out)) if out and all(self.graph.is_class(e.target) for e, _ in out) else None

    def reached(self, ways: list[tuple[Edge, bool]], t: A.Triple, s: Column | None, o: Column | None, ty: VType) -> DataFrame:
        """src, dst of the paths of at least one edge from a constant node, or to one."""
        near, end, c = ("src", "dst", s) if s is not None else ("dst", "src", o)
        node = t.s if s is not None else t.o
        cls = self.class_of(node)
        key = self.node_key(node, cls) if cls in self.graph.classes else None
        text = node.value.removeprefix(NS).partition("/")[2] if key is not None else ""
        if key is not None and self.graph.classes[cls].native and not (text.lstrip("-").isdecimal() and str(int(text)) == text and -(2**63) <= int(text) < 2**63):
            key = None
        if s is None:
            ways = [(e, not inverse) for e, inverse in ways]
        nodes = {} if key is None else reachable_from(self.graph, ways, cls, key, self.checkpoint)
        parts = [df.select(c.alias(near), coerce(F.col("k"), VType("iri", k), ty).alias(end)) for k, df in sorted(nodes.items())]
        return reduce(DataFrame.unionByName, parts).select("src", "dst") if parts else self.spark.range(0).select(*(coerce(F.lit(None).cast("string"), VType("str"), ty).alias(n) if ty.kind == "term" else F.lit(None).cast("bigint" if ty.cls else "string").alias(n) for n in ("src", "dst")))

    # ---- groups
    def group(self, g: A.Group, known: dict[str, VType] | None = None, correlated: list | None = None) -> Solutions:
        """Solutions of a group.  Filters over variables that it does not bind go to ``correlated``, if given."""
        done: Solutions | None = None
        waiting: list[A.Triple] = []
        filters: list = []
        known = dict(known or {})
        tests = kind_tests(g)

        def flush() -> None:
            nonlocal done
            if waiting:
                before, self.kinds = self.kinds, tests
                part = self.bgp(list(waiting), {**known, **(done.types if done else {})})
                self.kinds = before
                done = part if done is None else join(done, part)
                waiting.clear()

        for part in g.parts:
            if isinstance(part, A.Triple):
                waiting.append(part)
                continue
            if isinstance(part, A.Filter):
                filters.append(part.expr)
                continue
            if isinstance(part, A.OptionalP | A.MinusP | A.Bind):
                flush()
            have = done.types if done else {}
            if isinstance(part, A.OptionalP):
                inner: list = []
                right = self.group(part.group, {**known, **have}, inner)
                test = (lambda es: lambda lk: reduce(lambda p, q: p & q, (truth(*compile_expr(e, lk)) for e in es)))(inner) if inner else None
                done = join(done or self.unit(), right, "left", test)
            elif isinstance(part, A.MinusP):
                done = self.minus(done or self.unit(), self.group(part.group, {**known, **have}))
            elif isinstance(part, A.Bind):
                done = self.extended(done or self.unit(), part.expr, part.var.name)
            else:
                right = self.sub(part, {**known, **have})
                done = right if done is None else join(done, right)
        flush()
        done = done or self.unit()
        for e in filters:
            used = self.free(e)
            if correlated is not None and not used <= set(done.types):
                correlated.append(e)
            else:
                done = self.filter(done, e)
        return done

    @staticmethod
    def free(e: object) -> set[str]:
        """Variables of an expression outside the groups of its EXISTS tests."""
        if isinstance(e, A.Exists):
            return set()
        if isinstance(e, A.Var):
            return {e.name}
        return set().union(*(Compiler.free(c) for c in A.children(e))) if not isinstance(e, A.Lit | A.Iri) else set()

    def sub(self, part: object, known: dict[str, VType]) -> Solutions:
        if isinstance(part, A.Group):
            return self.group(part, known)
        if isinstance(part, A.UnionP):
            return reduce(union, (self.group(b, known) for b in part.branches))
        if isinstance(part, A.Values):
            return self.values(part)
        if isinstance(part, A.SubSelect):
            return self.select(part.query)
        if isinstance(part, A.GraphP):
            # one graph holds everything: a variable name is bound to it
            inner = self.group(part.group, known)
            name = F.lit(NS + "graph")
            if isinstance(part.name, A.Var):
                return Solutions(inner.df.withColumn(part.name.name, name), {**inner.types, part.name.name: VType("iri")}, inner.maybe)
            return inner if part.name.value == NS + "graph" else Solutions(inner.df.filter(F.lit(False)), inner.types, inner.maybe)
        if isinstance(part, A.ServiceP):
            if part.silent:
                return self.unit()
            raise Unsupported("SERVICE needs a remote endpoint")
        raise Unsupported(f"no meaning for {part!r}")

    def values(self, v: A.Values) -> Solutions:
        """Inline data; a column whose constants differ in type holds terms."""
        if not v.rows:
            return self.empty({x.name: VType("str") for x in v.vars})
        types, columns = {}, []
        for i, x in enumerate(v.vars):
            cells = [self.constant(r[i]) if r[i] is not None else None for r in v.rows]
            known = [t for c in cells if c is not None for t in [c[1]]]
            types[x.name] = reduce(unify, known) if known else VType("str")
            columns.append([F.lit(None) if c is None else coerce(c[0], c[1], types[x.name]) for c in cells])
        rows = F.array(*(F.struct(*(c[k].alias(x.name) for x, c in zip(v.vars, columns, strict=True))) for k in range(len(v.rows))))
        df = self.spark.range(1).select(F.explode(rows).alias("r")).select(*(F.col(f"r.`{x.name}`").alias(x.name) for x in v.vars))
        patterns = frozenset(frozenset(x.name for x, c in zip(v.vars, r, strict=True) if c is None) for r in v.rows)
        return Solutions(df, types, frozenset().union(*patterns), patterns)

    def constant(self, t: A.Term) -> tuple[Column, VType]:
        cls = self.class_of(t)
        if cls in self.graph.classes:
            return self.node_key(t, cls), VType("iri", cls)
        return literal(t)

    def minus(self, a: Solutions, b: Solutions) -> Solutions:
        if not shared(a, b):
            return a
        a2, b2, names = aligned(a, b)
        if not (a2.maybe | b2.maybe) & set(names):
            return join(a2, b2.keep(names), "left_anti")
        # what shares no variable that is bound on both sides takes nothing away
        parts = []
        for left, rights in _by_bound(a2, b2.keep(names), names, need=True):
            for right, keys in rights:
                left = _join_at_once(Solutions(left, a2.types), right.keep(keys), keys, [], "left_anti", None, a2.types, a2.maybe).df
            parts.append(left)
        return Solutions(reduce(DataFrame.unionByName, parts), a2.types, a2.maybe)

    # ---- filters
    def filter(self, sol: Solutions, e: object) -> Solutions:
        if isinstance(e, A.Op) and e.name == "&&":
            return self.filter(self.filter(sol, e.args[0]), e.args[1])
        if isinstance(e, A.Op) and e.name == "!" and isinstance(e.args[0], A.Exists):
            return self.filter(sol, A.Exists(e.args[0].group, not e.args[0].negated))
        if isinstance(e, A.Exists):
            outer: list = []
            inner = self.group(e.group, sol.types, outer)
            test = (lambda lk: reduce(lambda p, q: p & q, (truth(*compile_expr(x, lk)) for x in outer))) if outer else None
            if not shared(sol, inner) and not outer:
                found = inner.df.limit(1).select(F.lit(1).alias("one_"))
                return Solutions(sol.df.join(found, F.lit(True), "left_anti" if e.negated else "left_semi"), sol.types, sol.maybe)
            return join(sol, inner, "left_anti" if e.negated else "left_semi", test)
        flagged, flags = self.with_flags(sol, e)
        c, t = compile_expr(e, flagged.by_name, flags)
        return Solutions(flagged.df.filter(truth(c, t)).select(*(F.col(f"`{n}`") for n in sol.types)), sol.types, sol.maybe)

    def with_flags(self, sol: Solutions, e: object):
        """Adds a column for each EXISTS inside an expression: an outer join with its distinct keys."""
        tests = [x for x in A.walk(e) if isinstance(x, A.Exists)] if any(isinstance(x, A.Exists) for x in A.walk(e)) else []
        names: dict[A.Exists, str] = {}
        for x in tests:
            if x in names:
                continue
            inner = self.group(x.group, sol.types)
            keys = shared(sol, inner)
            flag = f"_e{next(self.count)}"
            names[x] = flag
            marked = inner.keep(keys).df.distinct().withColumn(flag, F.lit(True)) if keys else inner.df.limit(1).select(F.lit(True).alias(flag))
            types = {k: inner.types[k] for k in keys} | {flag: VType("bool")}
            sol = join(sol, Solutions(marked, types), "left")
        get = (lambda x: (F.col(names[x]).isNotNull()) if not x.negated else F.col(names[x]).isNull()) if tests else None
        return sol, get

    def extended(self, sol: Solutions, e: object, name: str) -> Solutions:
        """The solutions with a further variable, which is unbound where the expression is an error."""
        flagged, flags = self.with_flags(sol, e)
        c, t = compile_expr(e, flagged.by_name, flags)
        df = flagged.df.select(*(F.col(f"`{n}`") for n in sol.types if n != name), c.alias(name))
        return Solutions(df, {**{n: v for n, v in sol.types.items() if n != name}, name: t}, sol.maybe | {name})

    # ---- modifiers
    def select(self, q: A.Query) -> Solutions:
        sol = self.group(q.where)
        if q.values:
            sol = join(sol, self.values(q.values))
        projection = list(q.projection) or [A.Projected(A.Var(n), A.Var(n)) for n in A.in_scope(q.where) if n in sol.types]
        aggregates = [x for p in [*projection, *q.having, *q.order_by] for x in A.walk(p) if isinstance(x, A.Agg)]
        order = list(q.order_by)
        having = list(q.having)
        if aggregates or q.group_by:
            sol, swap = self.aggregate(sol, q, projection, list(dict.fromkeys(aggregates)))
            projection = [A.Projected(A.rebuild(p.expr, swap), p.var) for p in projection]
            having = [A.rebuild(h, swap) for h in having]
            order = [A.rebuild(k, swap) for k in order]
        extended = sol
        for p in projection:
            if p.expr != p.var or p.var.name not in extended.types:
                extended = self.extended(extended, p.expr, p.var.name)
        for h in having:
            extended = self.filter(extended, h)
        names = list(dict.fromkeys(p.var.name for p in projection))
        if q.distinct:
            hidden = [k for k in order if not Compiler.free(k.expr) <= set(names)]
            if hidden:
                raise Unsupported("ORDER BY on what DISTINCT has dropped")
            extended = extended.keep(names)
            extended = Solutions(extended.df.distinct(), extended.types, extended.maybe)
        df = extended.df
        if order:
            keys = []
            for k in order:
                c, t = compile_expr(k.expr, extended.by_name)
                c = text_of(c, t) if t.kind in ("term", "lang") else c
                keys.append(c.desc_nulls_last() if k.descending else c.asc_nulls_first())
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, extended.types, extended.maybe).keep(names)

    def aggregate(self, sol: Solutions, q: A.Query, projection: list[A.Projected], aggregates: list[A.Agg]):
        """Groups, and a change that puts each aggregate's result in its place.

        Variables that are projected beside aggregates without GROUP BY are the group's keys.
        """
        keys = list(q.group_by)
        if not keys:
            plain = [p.expr for p in projection if not any(isinstance(x, A.Agg) for x in A.walk(p.expr))]
            keys = [A.Projected(v, v) for v in plain if isinstance(v, A.Var)]
        for k in keys:
            if k.expr != k.var:
                c, t = compile_expr(k.expr, sol.by_name)
                sol = Solutions(sol.df.withColumn(k.var.name, c), {**sol.types, k.var.name: t}, sol.maybe)
        names = {a: f"_a{i}" for i, a in enumerate(aggregates)}
        cols, types = [], {k.var.name: sol.types.get(k.var.name, VType("str")) for k in keys}
        for a, n in names.items():
            c, types[n] = self.fold(sol, a)
            cols.append(c.alias(n))
        # grouping alone is DISTINCT on the keys
        grouped = sol.df.groupBy(*(F.col(f"`{k.var.name}`") for k in keys))
        df = grouped.agg(*cols) if cols else sol.df.select(*(F.col(f"`{k.var.name}`") for k in keys)).distinct()
        swap = lambda x: A.Var(names[x]) if isinstance(x, A.Agg) and x in names else x
        return Solutions(df, types, frozenset(n for n in types)), swap

    def fold(self, sol: Solutions, a: A.Agg) -> tuple[Column, VType]:
        if a.arg is None:
            every = F.struct(*(F.col(f"`{n}`") for n in sol.types))
            return (F.countDistinct(every) if a.distinct else F.count(F.lit(1))), VType("int")
        c, t = compile_expr(a.arg, sol.by_name)
        if a.name == "COUNT":
            return (F.countDistinct(c) if a.distinct else F.count(c)), VType("int")
        if a.name in ("SUM", "AVG"):
            n = c if t.kind == "int" and a.name == "SUM" else number_of(c, t)
            out = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda x: F.sum_distinct(x) / F.countDistinct(x)}[a.name, a.distinct](n)
            return F.coalesce(out, F.lit(0)), VType("int") if t.kind == "int" and a.name == "SUM" else VType("dbl")
        if a.name in ("MIN", "MAX", "SAMPLE"):
            f = F.max if a.name == "MAX" else F.min  # the sample is the smallest, so that it does not change
            if t.kind == "term":
                return f(F.struct(number_of(c, t), c["lex"], c["dt"], c["lang"], c["kind"])).cast("struct<n:double,lex:string,dt:string,lang:string,kind:int>").withField("x", F.lit(0)).dropFields("x", "n"), VType("term")
            return f(c), t
        if a.name == "GROUP_CONCAT":
            items = F.array_sort(F.collect_set(text_of(c, t)) if a.distinct else F.collect_list(text_of(c, t)))
            return F.array_join(items, a.sep), VType("str")
        raise Unsupported(f"no aggregate {a.name}")

    # ---- forms
    @staticmethod
    def read(q: A.Query | str) -> A.Query:
        return parse(q) if isinstance(q, str) else q

    def run(self, q: A.Query | str, terms: bool = False) -> DataFrame:
        q = self.read(q)
        if q.form == "SELECT":
            return self.final(self.select(q), terms)
        if q.form == "ASK":
            some = self.group(q.where).df.limit(1)
            return some.agg(F.count(F.lit(1)).cast("int").alias("answer"))
        if q.form == "CONSTRUCT":
            return self.construct(q)
        return self.describe(q)

    def final(self, sol: Solutions, terms: bool = False) -> DataFrame:
        """IRIs as text, literals as native values; or everything as terms."""
        if terms:
            return sol.df.select(*(to_term(F.col(f"`{n}`"), t).alias(n) for n, t in sol.types.items()))
        plain = lambda c, t: text_of(c, t) if t.kind in ("iri", "term", "lang") else c
        return sol.df.select(*(plain(F.col(f"`{n}`"), t).alias(n) for n, t in sol.types.items()))

    def construct(self, q: A.Query) -> DataFrame:
        sol = self.group(q.where)
        if q.limit is not None or q.offset or q.order_by:
            names = [A.Projected(A.Var(n), A.Var(n)) for n in sol.types if not n.startswith("_")]
            sol = self.select(A.Query("SELECT", q.where, tuple(names), order_by=q.order_by, limit=q.limit, offset=q.offset))

        def cell(x: A.Term) -> Column:
            if isinstance(x, A.Var):
                if x.name not in sol.types:
                    return F.lit(None).cast("string")
                return text_of(F.col(f"`{x.name}`"), sol.types[x.name])
            return text_of(*literal(x))

        made = F.array(*(F.struct(cell(t.s).alias("subject"), cell(t.p).alias("predicate"), cell(t.o).alias("object")) for t in q.template))
        out = sol.df.select(F.explode(made).alias("t")).select("t.*")
        return out.filter("subject is not null and predicate is not null and object is not null").distinct()

    def describe(self, q: A.Query) -> DataFrame:
        """The triples whose subject is one of the resources."""
        constants = [t for t in q.targets if isinstance(t, A.Iri)]
        names = [t.name for t in q.targets if isinstance(t, A.Var)] or ([] if constants else A.in_scope(q.where))
        classes = {self.class_of(t) for t in constants}
        parts = []
        if constants:
            parts.append(self.spark.range(1).select(F.explode(F.array(*(F.lit(t.value) for t in constants))).alias("s")))
        if names:
            sol = self.select(A.Query("SELECT", q.where, tuple(A.Projected(A.Var(n), A.Var(n)) for n in names), limit=q.limit, offset=q.offset, order_by=q.order_by))
            classes |= {t.cls for t in sol.types.values() if t.kind == "iri"}
            parts += [sol.df.select(text_of(F.col(f"`{n}`"), t).alias("s")) for n, t in sol.types.items() if t.kind in ("iri", "term")]
        wanted = reduce(DataFrame.union, parts).distinct()
        edges = None if None in classes else [e for e in self.graph.edges if e.cls in classes]
        return self.graph.triples(edges).join(wanted, "s", "left_semi").select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o.lex").alias("object"))


def union(a: Solutions, b: Solutions) -> Solutions:
    """A bag union; a variable of one side alone is unbound in the other's rows."""
    a, b, _ = aligned(a, b)
    types = {**b.types, **a.types}
    only = set(a.types) ^ set(b.types)
    return Solutions(a.df.unionByName(b.df, allowMissingColumns=True).select(*(F.col(f"`{n}`") for n in types)), types, a.maybe | b.maybe | frozenset(only))


class Engine:
    """Queries over a graph: text or trees in, DataFrames out."""

    def __init__(self, graph: Graph, checkpoint=None):
        self.graph = graph
        self.checkpoint = checkpoint

    def compiler(self) -> Compiler:
        return Compiler(self.graph, self.checkpoint)

    def sparql(self, q: A.Query | str, terms: bool = False) -> DataFrame:
        return self.compiler().run(q, terms)

    def ask(self, q: A.Query | str) -> bool:
        return bool(self.sparql(q).first()[0])


def scratch_name() -> str:
    return uuid.uuid4().hex
