"""Rewrites of query trees: each takes a query and gives a new one."""

from __future__ import annotations

import itertools
import re

from quillgraph.plans import ast as A

TIME_TYPES = tuple(A.XSD + t for t in ("date", "gYear", "gYearMonth", "dateTime"))
NUMBER_TYPES = tuple(A.XSD + t for t in ("integer", "decimal", "double", "float"))


class NotEditable(ValueError):
    """The query has a construct that the editor does not touch."""


def constants(q: A.Query) -> list[A.Term]:
    """Constant subjects and objects of patterns and constants of comparisons, in order, without repeats."""
    seen: dict[A.Term, None] = {}
    for n in A.walk(q):
        if isinstance(n, A.Triple):
            seen.update(dict.fromkeys(x for x in (n.s, n.o) if not isinstance(x, A.Var)))
        elif isinstance(n, A.Op) and n.name in ("=", "!=", "<", ">", "<=", ">=", "IN", "NOT IN"):
            seen.update(dict.fromkeys(x for x in n.args if isinstance(x, A.Iri | A.Lit)))
        elif isinstance(n, A.Values):
            seen.update(dict.fromkeys(x for r in n.rows for x in r if x is not None))
    return list(seen)


def check_editable(q: A.Query) -> A.Query:
    """Refuses forms that have no single answer variable, and parts that the editor does not know."""
    if q.form != "SELECT":
        raise NotEditable(f"{q.form} has no answer variable")
    for n in A.walk(q):
        if isinstance(n, A.ServiceP | A.MinusP | A.OptionalP | A.GraphP):
            raise NotEditable(f"{type(n).__name__} cannot be edited")
    return q


def same_leaf(a: A.Term, b: A.Term, fuzzy: bool = False) -> bool:
    """Equality of constants; the loose form accepts a value whose part after a colon contains the other's."""
    if a == b:
        return True
    if not fuzzy:
        return False
    x, y = (getattr(t, "value", None) or getattr(t, "lex", "") for t in (a, b))
    return any(p and (p in y) for p in x.split(":")[-1:])


def contains_leaf(q: A.Query, c: A.Term, fuzzy: bool = False) -> bool:
    return any(same_leaf(c, x, fuzzy) for x in constants(q))


def replace_constant(q: A.Query, old: A.Term, new: A.Term, fuzzy: bool = False) -> A.Query:
    """Puts a term in the place of a constant wherever it is a subject, an object or an operand."""
    swap = lambda x: new if not isinstance(x, A.Var) and isinstance(x, A.Iri | A.Lit) and same_leaf(old, x, fuzzy) else x

    def change(n):
        if isinstance(n, A.Triple):
            return A.Triple(swap(n.s), n.p, swap(n.o))
        if isinstance(n, A.Op):
            return A.Op(n.name, tuple(swap(x) if isinstance(x, A.Iri | A.Lit) else x for x in n.args))
        if isinstance(n, A.Values):
            return A.Values(n.vars, tuple(tuple(swap(x) if x is not None else None for x in r) for r in n.rows))
        return n

    return A.rebuild(q, change)


def abstract(q: A.Query, chosen: dict[A.Term, str]) -> A.Query:
    """Turns constants into projected variables; beside an aggregate they become the keys of groups."""
    for c, name in chosen.items():
        if not contains_leaf(q, c):
            raise NotEditable(f"{c} does not occur")
        q = replace_constant(q, c, A.Var(name))
    added = tuple(A.Projected(A.Var(n), A.Var(n)) for n in chosen.values())
    return q.with_(projection=added + q.projection)


def drop_projection(q: A.Query, name: str) -> A.Query:
    return q.with_(projection=tuple(p for p in q.projection if p.var.name != name))


def rename_target(q: A.Query, name: str) -> A.Query:
    """Names the single answer variable."""
    if len(q.projection) != 1:
        raise NotEditable("not exactly one variable is projected")
    p = q.projection[0]
    if p.expr == p.var:
        return rename_variables(q, {p.var.name: name})
    return q.with_(projection=(A.Projected(p.expr, A.Var(name)),))


def rename_variables(q: A.Query, to: dict[str, str]) -> A.Query:
    return A.rebuild(q, lambda n: A.Var(to.get(n.name, n.name)) if isinstance(n, A.Var) else n)


def unwrap(q: A.Query) -> A.Query:
    """Takes away an outer SELECT around one subquery; a COUNT of its variable moves inward."""
    if len(q.where.parts) != 1 or not isinstance(q.where.parts[0], A.SubSelect):
        return q
    inner = q.where.parts[0].query
    if len(q.projection) == 1 and isinstance(q.projection[0].expr, A.Agg) and len(inner.projection) == 1:
        agg = q.projection[0].expr
        return inner.with_(projection=(A.Projected(A.Agg(agg.name, inner.projection[0].expr, agg.distinct or inner.distinct), q.projection[0].var),), distinct=False)
    if len(q.projection) == len(inner.projection) and all(p.expr == p.var for p in q.projection):
        return inner.with_(distinct=inner.distinct or q.distinct)
    return q


def drop_filters(q: A.Query, patterns: list[str]) -> A.Query:
    """Drops filters whose text matches one of the patterns: noise that a data set adds to each query."""
    from quillgraph.plans.printer import part

    noise = [re.compile(p) for p in patterns]

    def change(n):
        if isinstance(n, A.Group):
            return A.Group(tuple(p for p in n.parts if not (isinstance(p, A.Filter) and any(r.search(part(p)) for r in noise))))
        return n

    return A.rebuild(q, change)


def split_direct(q: A.Query, predicates: dict[str, tuple[str, str]], as_path: bool = True) -> A.Query:
    """Replaces direct predicates by the two steps through their statement node."""
    count = iter(range(10**9))

    def change(n):
        if not isinstance(n, A.Triple) or not isinstance(n.p, A.Iri) or n.p.value not in predicates:
            return A.Group(tuple(x for p in n.parts for x in (p if isinstance(p, list) else [p]))) if isinstance(n, A.Group) else n
        a, b = (A.Iri(v) for v in predicates[n.p.value])
        if as_path:
            return A.Triple(n.s, A.PathSeq((a, b)), n.o)
        mid = A.Var(f"statement{next(count)}")
        return A.Group((A.Triple(n.s, a, mid), A.Triple(mid, b, n.o)))

    return A.rebuild(q, change)


def superlative(q: A.Query) -> A.Query:
    """``?v = (MIN or MAX of a subquery)`` as ORDER BY ?v LIMIT 1."""
    for part in q.where.parts:
        if isinstance(part, A.SubSelect) and len(part.query.projection) == 1 and isinstance(part.query.projection[0].expr, A.Agg):
            agg, name = part.query.projection[0].expr, part.query.projection[0].var.name
            if agg.name not in ("MIN", "MAX"):
                continue
            for f in q.where.parts:
                if isinstance(f, A.Filter) and isinstance(f.expr, A.Op) and f.expr.name == "=" and A.Var(name) in f.expr.args:
                    key = next(x for x in f.expr.args if x != A.Var(name))
                    rest = A.Group(tuple(p for p in q.where.parts if p not in (part, f)))
                    return q.with_(where=rest, order_by=(A.OrderKey(key, agg.name == "MAX"),), limit=1)
            rest = tuple(p for p in q.where.parts if p != part)
            if any(A.Var(name) == t.o for p in rest if isinstance(p, A.Triple) for t in [p]):
                return q.with_(where=A.Group(rest), order_by=(A.OrderKey(A.Var(name), agg.name == "MAX"),), limit=1)
    return q


def set_limit(q: A.Query, old: int, new: int) -> A.Query:
    return q.with_(limit=new) if q.limit == old else q


def inline_values(q: A.Query) -> A.Query:
    """A VALUES block of one row as constants."""
    to: dict[str, A.Term] = {}

    def change(n):
        if isinstance(n, A.Group):
            keep = []
            for p in n.parts:
                if isinstance(p, A.Values) and len(p.rows) == 1 and None not in p.rows[0]:
                    to.update({v.name: c for v, c in zip(p.vars, p.rows[0], strict=True)})
                else:
                    keep.append(p)
            return A.Group(tuple(keep))
        return n

    q = A.rebuild(q, change)
    return substitute(q, to)


def inline_equal(q: A.Query) -> A.Query:
    """``FILTER(?v = constant)`` as the constant in the place of the variable."""
    to: dict[str, A.Term] = {}

    def change(n):
        if isinstance(n, A.Group):
            keep = []
            for p in n.parts:
                e = p.expr if isinstance(p, A.Filter) else None
                if isinstance(e, A.Op) and e.name == "=" and isinstance(e.args[0], A.Var) and isinstance(e.args[1], A.Iri | A.Lit):
                    to[e.args[0].name] = e.args[1]
                else:
                    keep.append(p)
            return A.Group(tuple(keep))
        return n

    return substitute(A.rebuild(q, change), to)


def substitute(q: A.Query, to: dict[str, A.Term]) -> A.Query:
    """Constants for variables in patterns and expressions; projected ones stay, bound by BIND."""
    if not to:
        return q
    shown = {p.var.name for p in q.projection} & set(to)
    where = A.rebuild(q.where, lambda n: to.get(n.name, n) if isinstance(n, A.Var) else n)
    binds = tuple(A.Bind(to[n], A.Var(n)) for n in sorted(shown))
    return q.with_(where=A.Group(where.parts + binds))


def expand_times(q: A.Query) -> A.Query:
    """Comparisons with a date, year or month use the full dateTime of its start."""
    from quillgraph.functions.scalar import full_time

    def change(n):
        if isinstance(n, A.Lit) and n.dt in TIME_TYPES and n.dt != A.XSD + "dateTime":
            return A.Lit(full_time(n.lex) + "T00:00:00", A.XSD + "dateTime")
        return n

    return A.rebuild(q, change)


def force_distinct(q: A.Query) -> A.Query:
    return q.with_(distinct=True) if q.form == "SELECT" else q


def canonical(q: A.Query, inverse: dict[str, str] | None = None) -> A.Query:
    """Inverse predicates in one direction, repeats dropped, parts in order of their text, variables renamed.

    ``inverse`` maps a predicate to the one that it replaces; of a pair named both ways the smaller stays.
    """
    from quillgraph.plans.printer import part as show

    inverse = inverse or {}
    preferred = {b: a for a, b in inverse.items() if inverse.get(b) != a or a < b}

    def turn(n):
        if isinstance(n, A.Triple) and isinstance(n.p, A.Iri) and n.p.value in preferred:
            return A.Triple(n.o, A.Iri(preferred[n.p.value]), n.s)
        return n

    blind = lambda p: re.sub(r"\?\w+|_:\w+", "?", show(p))

    def order(n):
        if isinstance(n, A.Group):
            return A.Group(tuple(sorted(dict.fromkeys(n.parts), key=lambda p: (blind(p), show(p)))))
        return n

    q = A.rebuild(A.rebuild(q, turn), order)
    names = {}
    for n in A.walk(q):
        if isinstance(n, A.Var):
            names.setdefault(n.name, f"v{len(names)}")
    return A.rebuild(rename_variables(q, names), order)


def for_test_suite(q: A.Query, target: str = "target") -> A.Query:
    """The form that equivalence tests run on."""
    q = check_editable(inline_equal(inline_values(superlative(unwrap(q)))))
    return force_distinct(rename_target(q, target)) if not any(isinstance(x, A.Agg) for p in q.projection for x in A.walk(p)) else rename_target(q, target)


def for_edit_distance(q: A.Query, inverse: dict[str, str] | None = None) -> A.Query:
    """The form that edit distances compare."""
    return canonical(rename_target(inline_equal(inline_values(superlative(unwrap(q)))), "target"), inverse)


def capped(q: A.Query, limit: int) -> A.Query:
    """A limit for a query that has none of its own."""
    return q if q.limit is not None or q.form != "SELECT" else q.with_(limit=limit)


def with_prefix(text: str, name: str, iri: str) -> str:
    """Query text with a prefix that its author left out."""
    return text if re.search(rf"(?i)\bprefix\s+{re.escape(name)}:", text) else f"PREFIX {name}: <{iri}>\n{text}"


def update_leaf(q: A.Query, old: A.Term, new: A.Term) -> A.Query:
    """A constant replaced where it stands, or where the loose form finds it; it must be there."""
    fuzzy = not contains_leaf(q, old)
    if fuzzy and not contains_leaf(q, old, True):
        raise NotEditable(f"{old} does not occur")
    return replace_constant(q, old, new, fuzzy)


def rebuild_paths(q: A.Query, predicate: str, path: str) -> A.Query:
    """A direct predicate as the path that it stands for."""
    from quillgraph.plans.parser import parse_patterns

    steps = parse_patterns(f"?s {path} ?o").parts[0].p
    return A.rebuild(q, lambda n: A.Triple(n.s, steps, n.o) if isinstance(n, A.Triple) and n.p == A.Iri(predicate) else n)


def union_normal_form(q: A.Query) -> A.Query:
    """The query as one UNION of groups that have none: each choice of a branch of every UNION, with all other parts.

    Joins, OPTIONAL, MINUS, FILTER and BIND of a bag union are the bag unions of theirs.
    """

    def choices(g: A.Group) -> list[A.Group]:
        cells = []
        for p in g.parts:
            if isinstance(p, A.UnionP):
                cells.append([c for b in p.branches for c in choices(b)])
            elif isinstance(p, A.Group):
                cells.append(choices(p))
            else:
                cells.append([p])
        return [A.Group(parts) for parts in itertools.product(*cells)]

    found = choices(q.where)
    return q if len(found) == 1 else q.with_(where=A.Group((A.UnionP(tuple(found)),)))
