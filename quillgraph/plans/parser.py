"""Recursive-descent parser for SPARQL 1.1 queries.

A few constructs of store dialects are read as well: ``OR`` for ``||``, commas between projections,
``expr AS ?v`` without parentheses, a bare projected expression, ``COUNT DISTINCT ?x``, and solution
modifiers in any order.  Arithmetic is left-associative.
"""

from __future__ import annotations

import re
from typing import Any

from quillgraph.plans import ast as A

#: Prefixes that need no declaration.
PREFIXES = {"xsd": A.XSD, "rdf": A.RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "kg": "kg:", "": "kg:"}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<string>\"{3}(?:\"{0,2}(?:[^\"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<var>[?$][A-Za-z_0-9À-￿]+)
  | (?P<blank>_:[A-Za-z_0-9][\w.-]*)
  | (?P<pname>(?:[A-Za-zÀ-￿][\w-]*)?:(?:[\w:](?:[\w.:-]*[\w:-])?)?)
  | (?P<word>[A-Za-z_][A-Za-z_0-9]*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*/+|^?!=<>-])""",
    re.X | re.S,
)

_AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
_FUNCTIONS = set(
    "STR LANG DATATYPE IRI URI BNODE ABS CEIL FLOOR ROUND STRLEN UCASE LCASE ENCODE_FOR_URI YEAR MONTH DAY HOURS MINUTES SECONDS "
    "TIMEZONE TZ MD5 SHA1 SHA256 SHA384 SHA512 ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC LANGMATCHES CONTAINS STRSTARTS STRENDS "
    "STRBEFORE STRAFTER STRLANG STRDT SAMETERM RAND NOW UUID STRUUID BOUND CONCAT COALESCE IF REGEX SUBSTR REPLACE".split()
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class SyntaxProblem(ValueError):
    """The text is not a query of the supported grammar."""


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.text = text
        self.prefixes = {**PREFIXES, **(prefixes or {})}
        self.base = ""
        self.tokens: list[tuple[str, str, int]] = []
        self.at = 0
        self.fresh = 0
        self.blanks: dict[str, A.Var] = {}
        pos = 0
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise SyntaxProblem(f"unexpected character at {pos}: {text[pos : pos + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group(), pos))
            pos = m.end()

    # ---- tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i][:2] if i < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def is_op(self, *ops: str) -> bool:
        kind, s = self.peek()
        return kind == "op" and s in ops

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        kind, s = self.peek(ahead)
        return kind == "word" and s.upper() in words

    def take_op(self, *ops: str) -> str | None:
        return self.next()[1] if self.is_op(*ops) else None

    def take_word(self, *words: str) -> str | None:
        return self.next()[1].upper() if self.is_word(*words) else None

    def need(self, what: str) -> str:
        got = self.take_op(what) if not what.isalpha() else self.take_word(what)
        if got is None:
            place = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
            raise SyntaxProblem(f"expected {what} at {place}: {self.text[place : place + 30]!r}")
        return got

    def joint(self) -> A.Var:
        self.fresh += 1
        return A.Var(f"_j{self.fresh}")

    # ---- queries
    def parse(self) -> A.Query:
        self.prologue()
        q = self.query()
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"text after the query: {self.peek()[1]!r}")
        return q

    def prologue(self) -> None:
        while True:
            if self.take_word("PREFIX"):
                name = self.next()[1]
                self.prefixes[name.rstrip(":")] = self.next()[1][1:-1]
            elif self.take_word("BASE"):
                self.base = self.next()[1][1:-1]
            else:
                return

    def query(self) -> A.Query:
        form = self.take_word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
        if form == "SELECT":
            return self.select()
        parts: dict[str, Any] = {}
        if form == "CONSTRUCT":
            if self.is_op("{"):
                parts["template"] = tuple(p for p in self.triples_block() if isinstance(p, A.Triple))
        elif form == "DESCRIBE":
            targets = []
            while not self.take_op("*") and self.peek()[0] in ("var", "iri", "pname"):
                targets.append(self.term())
            parts["targets"] = tuple(targets)
        elif form != "ASK":
            raise SyntaxProblem(f"no query form: {self.peek()[1]!r}")
        parts |= self.datasets()
        self.take_word("WHERE")
        if self.is_op("{"):
            parts["where"] = self.group()
        parts |= self.modifiers()
        if form == "CONSTRUCT" and not parts.get("template"):
            parts["template"] = tuple(p for p in parts["where"].parts if isinstance(p, A.Triple))
        return A.Query(form, **parts)

    def select(self) -> A.Query:
        distinct = bool(self.take_word("DISTINCT", "REDUCED"))
        projection: list[A.Projected] = []
        if not self.take_op("*"):
            while not (self.is_op("{") or self.is_word("WHERE", "FROM")):
                if self.take_op(","):
                    continue
                projection.append(self.projected(len(projection)))
            if not projection:
                raise SyntaxProblem("nothing is projected")
        parts = self.datasets()
        self.take_word("WHERE")
        where = self.group()
        parts |= self.modifiers()
        return A.Query("SELECT", where, tuple(projection), distinct, **parts)

    def projected(self, n: int) -> A.Projected:
        if self.peek()[0] == "var" and not (self.is_word("AS", ahead=1)):
            v = self.var()
            return A.Projected(v, v)
        if self.is_op("("):
            save = self.at
            self.next()
            e = self.expr()
            if self.take_word("AS"):
                v = self.var()
                self.need(")")
                return A.Projected(e, v)
            self.at = save
        e = self.expr()
        return A.Projected(e, self.var() if self.take_word("AS") else A.Var(f"expr{n}"))

    def datasets(self) -> dict[str, tuple]:
        plain, named = [], []
        while self.take_word("FROM"):
            (named if self.take_word("NAMED") else plain).append(self.term())
        return {"graphs": tuple(plain), "named_graphs": tuple(named)}

    def modifiers(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while True:
            if self.take_word("GROUP"):
                self.need("BY")
                keys = []
                while not (self.peek()[0] == "end" or self.is_op("}") or self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES", "GROUP")):
                    keys.append(self.projected(100 + len(keys)))
                out["group_by"] = tuple(keys)
            elif self.take_word("HAVING"):
                tests = [self.constraint()]
                while self.is_op("("):
                    tests.append(self.constraint())
                out["having"] = tuple(tests)
            elif self.take_word("ORDER"):
                self.need("BY")
                keys = []
                while not (self.peek()[0] == "end" or self.is_op("}") or self.is_word("HAVING", "GROUP", "LIMIT", "OFFSET", "VALUES", "ORDER")):
                    way = self.take_word("ASC", "DESC")
                    keys.append(A.OrderKey(self.constraint() if way or self.is_op("(") else self.unary(), way == "DESC"))
                out["order_by"] = tuple(keys)
            elif self.take_word("LIMIT"):
                out["limit"] = int(self.next()[1])
            elif self.take_word("OFFSET"):
                out["offset"] = int(self.next()[1])
            elif self.is_word("VALUES"):
                self.next()
                out["values"] = self.values()
            else:
                return out

    # ---- patterns
    def group(self) -> A.Group:
        self.need("{")
        if self.is_word("SELECT"):
            self.next()
            inner = A.SubSelect(self.select())
            self.need("}")
            return A.Group((inner,))
        parts: list[Any] = []
        while not self.take_op("}"):
            parts += self.pattern()
        return A.Group(tuple(parts))

    def pattern(self) -> list[Any]:
        if self.take_op("."):
            return []
        if self.is_op("{"):
            branches = [self.group()]
            while self.take_word("UNION"):
                branches.append(self.group())
            if len(branches) > 1:
                return [A.UnionP(tuple(branches))]
            inner = branches[0]
            return [inner.parts[0]] if len(inner.parts) == 1 and isinstance(inner.parts[0], A.SubSelect) else [inner]
        word = self.take_word("OPTIONAL", "MINUS", "GRAPH", "SERVICE", "FILTER", "BIND", "VALUES")
        if word == "OPTIONAL":
            return [A.OptionalP(self.group())]
        if word == "MINUS":
            return [A.MinusP(self.group())]
        if word == "GRAPH":
            return [A.GraphP(self.term(), self.group())]
        if word == "SERVICE":
            silent = bool(self.take_word("SILENT"))
            return [A.ServiceP(self.term(), self.group(), silent)]
        if word == "FILTER":
            return [A.Filter(self.constraint())]
        if word == "BIND":
            self.need("(")
            e = self.expr()
            self.need("AS")
            v = self.var()
            self.need(")")
            return [A.Bind(e, v)]
        if word == "VALUES":
            return [self.values()]
        return self.subject()

    def triples_block(self) -> list[Any]:
        self.need("{")
        out: list[Any] = []
        while not self.take_op("}"):
            out += self.pattern()
        return out

    def values(self) -> A.Values:
        one = self.peek()[0] == "var"
        names = []
        if one:
            names.append(self.var())
        else:
            self.need("(")
            while not self.take_op(")"):
                names.append(self.var())
        self.need("{")
        rows = []
        cell = lambda: None if self.take_word("UNDEF") else self.constant()
        while not self.take_op("}"):
            if one:
                rows.append((cell(),))
            else:
                self.need("(")
                row = []
                while not self.take_op(")"):
                    row.append(cell())
                if len(row) != len(names):
                    raise SyntaxProblem("a VALUES row has another length than its variables")
                rows.append(tuple(row))
        return A.Values(tuple(names), tuple(rows))

    def subject(self) -> list[Any]:
        out: list[Any] = []
        if self.is_op("["):
            s = self.bracket(out)
            if self.is_op(".", "}"):
                return out
        else:
            s = self.node(out)
        self.properties(s, out)
        return out

    def properties(self, s: A.Term, out: list[Any]) -> None:
        while True:
            p = self.var() if self.peek()[0] == "var" else self.path()
            while True:
                out.append(A.Triple(s, p, self.node(out)))
                if not self.take_op(","):
                    break
            if not self.take_op(";"):
                return
            while self.take_op(";"):
                pass
            if self.is_op(".", "}", "]"):
                return

    def bracket(self, out: list[Any]) -> A.Var:
        self.need("[")
        v = self.joint()
        if not self.take_op("]"):
            self.properties(v, out)
            self.need("]")
        return v

    def node(self, out: list[Any]) -> A.Term:
        if self.is_op("["):
            return self.bracket(out)
        if self.take_op("("):
            items = []
            while not self.take_op(")"):
                items.append(self.node(out))
            nil = A.Iri(A.RDF + "nil")
            cells = [self.joint() for _ in items] + [nil]
            for item, cell, rest in zip(items, cells, cells[1:], strict=False):
                out += [A.Triple(cell, A.Iri(A.RDF + "first"), item), A.Triple(cell, A.Iri(A.RDF + "rest"), rest)]
            return cells[0]
        return self.term()

    # ---- paths
    def path(self) -> Any:
        parts = [self.path_sequence()]
        while self.take_op("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else A.PathAlt(tuple(parts))

    def path_sequence(self) -> Any:
        parts = [self.path_step()]
        while self.take_op("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else A.PathSeq(tuple(parts))

    def path_step(self) -> Any:
        if self.take_op("^"):
            return A.PathInv(self.path_step())
        if self.take_op("("):
            p = self.path()
            self.need(")")
        elif self.take_op("!"):
            group = self.take_op("(")
            parts = [self.negated()]
            while group and self.take_op("|"):
                parts.append(self.negated())
            if group:
                self.need(")")
            return A.PathNot(tuple(parts))
        else:
            p = self.verb()
        mod = self.take_op("*", "+", "?")
        return A.PathMod(p, mod) if mod else p

    def negated(self) -> tuple[A.Iri, bool]:
        inverse = bool(self.take_op("^"))
        return (self.verb(), inverse)

    def verb(self) -> A.Iri:
        if self.is_word("A"):
            self.next()
            return A.Iri(A.RDF + "type")
        t = self.term()
        if not isinstance(t, A.Iri):
            raise SyntaxProblem(f"not a predicate: {t}")
        return t

    # ---- terms
    def var(self) -> A.Var:
        kind, s = self.next()
        if kind != "var":
            raise SyntaxProblem(f"expected a variable, not {s!r}")
        return A.Var(s[1:])

    def constant(self) -> A.Term:
        t = self.term()
        if isinstance(t, A.Var):
            raise SyntaxProblem("a variable where a constant is needed")
        return t

    def term(self) -> A.Term:
        kind, s = self.next()
        if kind == "var":
            return A.Var(s[1:])
        if kind == "iri":
            v = s[1:-1]
            return A.Iri(v if ":" in v or not self.base else self.base + v)
        if kind == "pname":
            prefix, _, local = s.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"unknown prefix {prefix!r}")
            return A.Iri(self.prefixes[prefix] + local)
        if kind == "blank":
            return self.blanks.setdefault(s, A.Var(f"_b{len(self.blanks)}"))
        if kind == "string":
            lex = self.unquote(s)
            if self.peek()[0] == "lang":
                return A.Lit(lex, A.RDF + "langString", self.next()[1][1:].lower())
            if self.take_op("^^"):
                return A.Lit(lex, self.term().value)
            return A.Lit(lex)
        if kind == "op" and s in "+-" and self.peek()[0] == "number":
            t = self.term()
            return A.Lit(s.replace("+", "") + t.lex, t.dt)
        if kind == "number":
            dt = "double" if re.search("[eE]", s) else "decimal" if "." in s else "integer"
            return A.Lit(s, A.XSD + dt)
        if kind == "word" and s.lower() in ("true", "false"):
            return A.Lit(s.lower(), A.XSD + "boolean")
        raise SyntaxProblem(f"not a term: {s!r}")

    @staticmethod
    def unquote(s: str) -> str:
        body = s[3:-3] if s[:3] in ('"""', "'''") and len(s) >= 6 else s[1:-1]
        hexed = lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3])
        return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", hexed, body, flags=re.S)

    # ---- expressions
    def constraint(self) -> Any:
        if self.take_op("("):
            e = self.expr()
            self.need(")")
            return e
        return self.unary()

    def expr(self) -> Any:
        return self.chain(self.conjunction, {"||": "||", "OR": "||"})

    def conjunction(self) -> Any:
        return self.chain(self.relation, {"&&": "&&", "AND": "&&"})

    def chain(self, part, ops: dict[str, str]) -> Any:
        left = part()
        while self.peek()[0] in ("op", "word") and self.peek()[1].upper() in ops:
            name = ops[self.next()[1].upper()]
            left = A.Op(name, (left, part()))
        return left

    def relation(self) -> Any:
        left = self.sum()
        op = self.take_op("=", "!=", "<", ">", "<=", ">=")
        if op:
            return A.Op(op, (left, self.sum()))
        negated = self.is_word("NOT") and self.is_word("IN", ahead=1)
        if negated:
            self.next()
        if self.take_word("IN"):
            return A.Op("NOT IN" if negated else "IN", (left, *self.arguments()))
        return left

    def sum(self) -> Any:
        return self.chain(self.product, {"+": "+", "-": "-"})

    def product(self) -> Any:
        return self.chain(self.unary, {"*": "*", "/": "/"})

    def unary(self) -> Any:
        op = self.take_op("!", "-", "+")
        if op:
            return A.Op("neg" if op == "-" else op, (self.unary(),)) if op != "+" else self.unary()
        return self.primary()

    def arguments(self) -> tuple:
        self.need("(")
        out: list[Any] = []
        while not self.take_op(")"):
            if out:
                self.need(",")
            out.append(self.expr())
        return tuple(out)

    def primary(self) -> Any:
        kind, s = self.peek()
        if self.take_op("("):
            e = self.expr()
            self.need(")")
            return e
        if kind == "word":
            word = s.upper()
            if word == "NOT" and self.is_word("EXISTS", ahead=1):
                self.next(), self.next()
                return A.Exists(self.group(), True)
            if word == "EXISTS":
                self.next()
                return A.Exists(self.group())
            if word in _AGGREGATES:
                self.next()
                return self.aggregate(word)
            if word in _FUNCTIONS:
                self.next()
                name = {"ISURI": "ISIRI", "URI": "IRI"}.get(word, word)
                return A.Call(name, self.arguments())
        t = self.term()
        if isinstance(t, A.Iri) and self.is_op("("):
            return A.Call(t.value, self.arguments())
        return t

    def aggregate(self, word: str) -> A.Agg:
        if self.take_word("DISTINCT"):  # the dialect without parentheses
            return A.Agg(word, self.var(), True)
        self.need("(")
        distinct = bool(self.take_word("DISTINCT"))
        arg = None if self.take_op("*") else self.expr()
        sep = " "
        if self.take_op(";"):
            self.need("SEPARATOR")
            self.need("=")
            sep = self.unquote(self.next()[1])
        self.need(")")
        return A.Agg(word, arg, distinct, sep)


def parse(text: str, prefixes: dict[str, str] | None = None) -> A.Query:
    return Parser(text, prefixes).parse()


def parse_filter(text: str, prefixes: dict[str, str] | None = None) -> Any:
    """The expression of a stand-alone constraint."""
    p = Parser(text, prefixes)
    p.take_word("FILTER")
    return p.constraint()


def parse_patterns(text: str, prefixes: dict[str, str] | None = None) -> A.Group:
    """A stand-alone group, with or without braces."""
    text = text.strip()
    return Parser(text if text.startswith("{") else "{" + text + "}", prefixes).group()
