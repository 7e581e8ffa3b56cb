"""Parser, printer, rewrites, logical forms."""

import pytest

from quillgraph.plans import ast as A
from quillgraph.plans import printer, rewrite, sexpr
from quillgraph.plans.parser import SyntaxProblem, parse, parse_filter, parse_patterns
from quillgraph.plans.querygraph import QueryGraph

TEXTS = [
    "SELECT ?x WHERE { ?x a :customer }",
    "SELECT DISTINCT ?x ?y WHERE { ?x :p ?y ; :q 3 , 4.5 , \"a\\n\\\"b\"@en . OPTIONAL { ?y :r ?z FILTER(?z > 1 && !BOUND(?x)) } }",
    "SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { { ?x :p ?y } UNION { ?x ^:q/:r* ?y } MINUS { ?x :s ?y } } GROUP BY ?y HAVING(COUNT(*) > 2) ORDER BY DESC(?n) LIMIT 3 OFFSET 1",
    "ASK { ?x !(:a|^:b) ?y . FILTER NOT EXISTS { ?y :p ?x } }",
    "CONSTRUCT { ?x :q ?y } WHERE { ?x :p ?y }",
    "DESCRIBE <kg:nation/1>",
    "SELECT * WHERE { VALUES (?x ?y) { (:a UNDEF) (1 \"b\"^^xsd:date) } BIND(IF(?x = 1, \"y\", \"n\") AS ?z) { SELECT ?x WHERE { ?x :p 1 } } }",
    "SELECT (GROUP_CONCAT(?x ; SEPARATOR=\"|\") AS ?g) WHERE { GRAPH ?g2 { ?x (:a|:b)+ ?y } SERVICE SILENT <http://e> { ?x :p ?y } FILTER(?x NOT IN (1, 2)) }",
]


@pytest.mark.parametrize("text", TEXTS)
def test_print_and_parse_again(text):
    q = parse(text)
    once = printer.query(q)
    assert printer.query(parse(once)) == once


def test_arithmetic_is_left_associative():
    e = parse_filter("(1 - 2 - 3)")
    assert e == A.Op("-", (A.Op("-", (A.Lit("1", A.XSD + "integer"), A.Lit("2", A.XSD + "integer"))), A.Lit("3", A.XSD + "integer")))


def test_dialects():
    assert parse("SELECT ?a, ?b { ?a :p ?b FILTER(?a = 1 OR ?b = 2) }") == parse("SELECT ?a ?b { ?a :p ?b FILTER(?a = 1 || ?b = 2) }")
    assert parse("SELECT COUNT(?a) AS ?n { ?a :p 1 }").projection[0].var == A.Var("n")
    late = parse("SELECT ?a { ?a :p ?b } LIMIT 2 ORDER BY ?b")
    assert late.limit == 2 and late.order_by


@pytest.mark.parametrize("bad", ["", "SELECT", "SELECT ?x", "SELECT ?x { ?x :p }", "SELECT ?x { ?x nope:p ?y }", "SELECT ?x { ?x :p ?y } trailing", "SELECT (1 AS) { }"])
def test_errors(bad):
    with pytest.raises(SyntaxProblem):
        parse(bad)


def test_collections_and_blank_nodes():
    g = parse_patterns("?x :p (1 2) . [] :q [ :r 3 ]")
    assert sum(isinstance(p, A.Triple) for p in g.parts) == 7
    assert A.variables(g) == ["x"]


def test_rewrites():
    q = parse("SELECT ?x { VALUES ?n { <kg:nation/3> } ?x :of_nation ?n ; :acctbal ?b FILTER(?b = 5) }")
    flat = rewrite.inline_equal(rewrite.inline_values(q))
    assert rewrite.constants(flat) == [A.Iri("kg:nation/3"), A.Lit("5", A.XSD + "integer")]
    wide = rewrite.abstract(flat, {A.Iri("kg:nation/3"): "replace0"})
    assert [p.var.name for p in wide.projection] == ["replace0", "x"]
    with pytest.raises(rewrite.NotEditable):
        rewrite.abstract(flat, {A.Iri("kg:nation/9"): "r"})
    with pytest.raises(rewrite.NotEditable):
        rewrite.for_test_suite(parse("ASK { ?x :p 1 }"))
    arg = rewrite.superlative(parse("SELECT ?p { ?p :price ?r { SELECT (MAX(?x) AS ?m) { ?y :price ?x } } FILTER(?r = ?m) }"))
    assert arg.limit == 1 and arg.order_by[0].descending
    assert rewrite.expand_times(parse('SELECT ?x { ?x :p ?d FILTER(?d > "2001"^^xsd:gYear) }')).where.parts[1].expr.args[1].lex == "2001-01-01T00:00:00"


def test_canonical_form_ignores_names_and_order():
    a = parse("SELECT ?x { ?x :p ?y . ?y :q 1 }")
    b = parse("SELECT ?u { ?v :q 1 . ?u :p ?v . ?u :p ?v }")
    assert printer.query(rewrite.for_edit_distance(a)) == printer.query(rewrite.for_edit_distance(b))


@pytest.mark.parametrize("form", ["(JOIN of_nation nation/3)", "(AND (LE size 20) (JOIN (R of_part) (JOIN of_supplier supplier/1)))", "(COUNT (JOIN placed_by customer/1))", "(ARGMAX (JOIN placed_by customer/1) totalprice)"])
def test_logical_forms_round_trip(form):
    assert sexpr.from_query(sexpr.to_query(form)) == form
    assert sexpr.write(sexpr.read(form)) == form


def test_interval_form():
    q = sexpr.to_query('(TC (JOIN of_nation nation/3) position.from "2001")')
    assert sum(isinstance(n, A.Exists) for n in A.walk(q)) == 4
    assert A.Iri("kg:position.to") in list(A.walk(q))
    assert sexpr.linear(sexpr.read("(AND (JOIN a b) (LE c 3))"))[-1] == ["AND", "#0", "#1"]
    with pytest.raises(sexpr.Malformed):
        sexpr.read("(JOIN a b")


def test_query_graph():
    g = QueryGraph("x", [("of_nation", "x", "n"), ("in_region", "n", "kg:region/2")], types={"x": ["customer"]})
    h = QueryGraph("y", [("placed_by", "n", "y")], comparisons=[("totalprice", "n", ">", "100")], count=True)
    both = g.attach(h)
    assert both.count and ("placed_by", "n_1", "x") in both.edges and both.comparisons == [("totalprice", "n_1", ">", "100")]
    assert "of nation" in g.readable()
    assert g.with_answer("kg:customer/1").form == "ASK"
    assert g.key() == QueryGraph("c", [("in_region", "m", "kg:region/2"), ("of_nation", "c", "m")], types={"c": ["customer"]}).key()
