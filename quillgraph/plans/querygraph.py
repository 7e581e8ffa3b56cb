"""Query graphs: edges around a centre, with types, comparisons, a superlative and a count."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quillgraph.plans import ast as A
from quillgraph.plans import sexpr
from quillgraph.plans.printer import query as show
from quillgraph.sources.registry import NS


def path_edges(center: str, relation: str, end: str, middle: str) -> list[tuple[str, str, str]]:
    """The edges of a relation p, ^p, or a/b over a middle node."""
    first, _, second = relation.partition("/")
    step = lambda r, a, b: (r[1:], b, a) if r.startswith("^") else (r, a, b)
    return [step(first, center, middle), step(second, middle, end)] if second else [step(first, center, end)]


def _term(x: str) -> A.Term:
    if x.startswith(NS):
        return A.Iri(x)
    if x.startswith('"') or x.lstrip("+-").replace(".", "", 1).isdigit():
        return sexpr.constant(x)
    return A.Var(x)


@dataclass(frozen=True)
class QueryGraph:
    """Edges are (predicate, from, to); an end is a variable's name, an IRI or a literal as text.

    ``types``: classes of variables; ``comparisons``: (predicate, variable, operator, literal); ``arg``:
    (predicate, variable, descending) of a superlative.
    """

    center: str
    edges: list[tuple[str, str, str]]
    types: dict[str, list[str]] = field(default_factory=dict)
    comparisons: list[tuple[str, str, str, str]] = field(default_factory=list)
    arg: tuple[str, str, bool] | None = None
    count: bool = False

    def size(self) -> int:
        return len(self.edges) + len(self.comparisons) + (self.arg is not None)

    def group(self, distinct_variables: bool = False) -> A.Group:
        parts: list = [A.Triple(_term(a), A.Iri(NS + p), _term(b)) for p, a, b in self.edges]
        for v, names in self.types.items():
            parts += [A.Triple(A.Var(v), A.Iri(A.RDF + "type"), A.Iri(NS + n)) for n in names]
        for i, (p, v, op, lit) in enumerate(self.comparisons):
            value = A.Var(f"value{i}")
            parts += [A.Triple(A.Var(v), A.Iri(NS + p), value), A.Filter(A.Op(op, (value, _term(lit))))]
        if self.arg:
            parts.append(A.Triple(A.Var(self.arg[1]), A.Iri(NS + self.arg[0]), A.Var("arg")))
        if distinct_variables:
            names = [n for n in A.variables(tuple(parts)) if n != "arg" and not n.startswith("value")]
            parts += [A.Filter(A.Op("!=", (A.Var(a), A.Var(b)))) for i, a in enumerate(names) for b in names[i + 1 :]]
        return A.Group(tuple(parts))

    def to_query(self, distinct_variables: bool = False) -> A.Query:
        x = A.Var(self.center)
        where = self.group(distinct_variables)
        if self.count:
            return A.Query("SELECT", where, (A.Projected(A.Agg("COUNT", x), A.Var("cnt")),), distinct=True)
        q = A.Query("SELECT", where, (A.Projected(x, x),), distinct=self.arg is None)
        return q.with_(order_by=(A.OrderKey(A.Var("arg"), self.arg[2]), A.OrderKey(x)), limit=1) if self.arg else q

    def with_answer(self, answer: str) -> A.Query:
        """Whether the graph has an answer: its centre as a constant."""
        group = A.rebuild(self.group(), lambda n: A.Iri(answer) if n == A.Var(self.center) else n)
        return A.Query("ASK", group)

    def readable(self, labels: dict[str, str] | None = None) -> str:
        """The graph as words, for ranking against a question."""
        name = lambda x: (labels or {}).get(x, x.rsplit("/", 1)[-1].strip('"').replace("_", " "))
        out = [f"{name(a)} {name(p)} {name(b)}" for p, a, b in self.edges]
        out += [f"{name(v)} {name(p)} {op} {name(lit)}" for p, v, op, lit in self.comparisons]
        out += [f"{'largest' if self.arg[2] else 'smallest'} {name(self.arg[0])}"] if self.arg else []
        return ("number of " if self.count else "") + ", ".join(out)

    def naturalised(self, labels: dict[str, str] | None = None) -> str:
        """The graph as a line of text with its variables, as rankers are given it."""
        name = lambda x: (labels or {}).get(x, x if x.startswith((NS, '"')) else f"?{x}")
        words = {">=": "greater or equal", ">": "greater", "<=": "less or equal", "<": "smaller"}
        out = f"COUNT (?{self.center}) " if self.count else f"SELECT ?{self.center} "
        out += f" that has {'maximum' if self.arg[2] else 'minimum'} {self.arg[0]}, " if self.arg else ""
        out += "".join(f"?{v} is a {c}, " for v, names in self.types.items() for c in names)
        out += "".join(f" ( {name(a)}, {p}, {name(b)} ), " for p, a, b in self.edges)
        return out + "".join(f"?{v} has {p} that {words[op]} than {lit}, " for p, v, op, lit in self.comparisons)

    def middle_nodes(self) -> dict[str, tuple[str, bool]]:
        """The variables one step from the centre that have further edges, with that step: predicate, and whether it leads to the centre."""
        out = {}
        for p, a, b in self.edges:
            for v, back in ((b, False), (a, True)):
                if (a if v == b else b) == self.center and not v.startswith((NS, '"')) and sum(v in e[1:] for e in self.edges) > 1:
                    out[v] = (p, back)
        return out

    def at_middle(self, other: QueryGraph) -> QueryGraph | None:
        """Another graph's constant at a middle node of this one, where both reach it by the same step."""
        for node, step in self.middle_nodes().items():
            for theirs, same in other.middle_nodes().items():
                if step != same:
                    continue
                more = [(p, node if a == theirs else a, node if b == theirs else b) for p, a, b in other.edges if theirs in (a, b) and other.center not in (a, b)]
                if more and not set(more) & set(self.edges) and not any(x in e[1:] for e in self.edges for m in more for x in m[1:] if x != node):
                    return self.with_edge(*more)
        return None

    def compared(self, relation: str, op: str, literal: str) -> QueryGraph:
        """A comparison of the centre's value, or of one over a middle node, which is shared where the step is the graph's."""
        first, _, second = relation.partition("/")
        if not second:
            return replace(self, comparisons=[*self.comparisons, (first, self.center, op, literal)])
        step = (first.lstrip("^"), first.startswith("^"))
        for node, own in self.middle_nodes().items():
            if own == step and not any(second == p and node in e for p, *e in self.edges):
                return replace(self, comparisons=[*self.comparisons, (second, node, op, literal)])
        node = f"m{len(self.edges)}_{len(self.comparisons)}"
        edge = (step[0], node, self.center) if step[1] else (step[0], self.center, node)
        return replace(self, edges=[*self.edges, edge], comparisons=[*self.comparisons, (second, node, op, literal)])

    def to_sexpr(self) -> str:
        return sexpr.from_query(self.to_query())

    def key(self) -> str:
        from quillgraph.plans.rewrite import canonical

        return show(canonical(self.to_query()))

    def with_edge(self, *edge: tuple[str, str, str]) -> QueryGraph:
        return replace(self, edges=[*self.edges, *edge])

    def attach(self, other: QueryGraph, at: str | None = None) -> QueryGraph:
        """Joins another graph on one shared variable (by default the centre); its other variables get new names.

        Types, comparisons and the count come along.
        """
        shared = at or self.center
        taken = set(A.variables(self.group()))
        to: dict[str, str] = {other.center: shared}
        for v in A.variables(other.group()):
            if v not in to:
                n, k = v, 1
                while n in taken:
                    n, k = f"{v}_{k}", k + 1
                to[v] = n
                taken.add(n)
        r = lambda x: to.get(x, x)
        types = {v: list(n) for v, n in self.types.items()}
        for v, names in other.types.items():
            types[r(v)] = list(dict.fromkeys([*types.get(r(v), []), *names]))
        arg = self.arg or (other.arg and (other.arg[0], r(other.arg[1]), other.arg[2]))
        edges = [*self.edges, *((p, r(a), r(b)) for p, a, b in other.edges)]
        comparisons = [*self.comparisons, *((p, r(v), op, lit) for p, v, op, lit in other.comparisons)]
        return QueryGraph(self.center, list(dict.fromkeys(edges)), types, comparisons, arg, self.count or other.count)
