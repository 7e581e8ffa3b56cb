"""Operators against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import metrics
from quillgraph.operators import closure, editdist, equivalence, explore, reports, similarity, synthesis
from quillgraph.operators.editdist import LabelGraph, Tree
from quillgraph.plans import ast as A
from quillgraph.plans.compiler import Engine
from quillgraph.sources import files
from quillgraph.sources.registry import sales_graph


@pytest.fixture(scope="module")
def engine(spark, sf_dir):
    return Engine(sales_graph(spark, sf_dir))


def test_closure_on_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {tuple(r) for r in closure.reachable(df).collect()}
    want = set(edges)
    while True:
        more = {(a, d) for a, b in want for c, d in want if b == c} | want
        if more == want:
            break
        want = more
    assert got == want
    assert {tuple(r) for r in closure.reachable(df, start=F.lit(4)).collect()} == {(4, 5)}
    assert {tuple(r) for r in closure.reachable(df, end=F.lit(1)).collect()} == {(1, 1), (2, 1), (3, 1)}


def naive_distance(a, b):
    """Forest distance by the plain recursion."""
    from functools import lru_cache

    @lru_cache(None)
    def d(f, g):
        if not f:
            return sum(t.size() for t in g)
        if not g:
            return sum(t.size() for t in f)
        s, t = f[-1], g[-1]
        return min(d(f[:-1] + s.kids, g) + 1, d(f, g[:-1] + t.kids) + 1, d(f[:-1], g[:-1]) + d(s.kids, t.kids) + (s.label != t.label))

    return d((a,), (b,))


def random_tree(rng, n):
    if n <= 1:
        return Tree(rng.choice("abc"))
    kids, left = [], n - 1
    while left:
        k = rng.randint(1, left)
        kids.append(random_tree(rng, k))
        left -= k
    return Tree(rng.choice("abc"), tuple(kids))


def test_tree_distance_matches_recursion():
    rng = random.Random(5)
    for _ in range(60):
        a, b = random_tree(rng, rng.randint(1, 7)), random_tree(rng, rng.randint(1, 7))
        assert editdist.tree_distance(a, b) == naive_distance(a, b)
    assert Tree("a", (Tree("b"), Tree("c", (Tree("d"),)))).paths() == [("a", "b"), ("a", "c", "d")]


def test_graph_distance_and_isomorphism():
    rng = random.Random(7)
    for _ in range(25):
        n = rng.randint(1, 4)
        nodes = [rng.choice("xy") for _ in range(n)]
        edges = [(rng.randrange(n), rng.choice("pq"), rng.randrange(n)) for _ in range(rng.randint(0, 4))]
        g = LabelGraph(nodes, edges)
        order = list(range(n))
        rng.shuffle(order)
        h = LabelGraph([nodes[order.index(i)] for i in range(n)], [(order[s], l, order[t]) for s, l, t in edges])
        assert editdist.isomorphic(g, h)
        assert editdist.graph_distance(g, h) == 0
        assert editdist.graph_distance(g, LabelGraph([], [])) == g.cost()
    many = LabelGraph(["x"] * 8, [(i, "p", (i + 1) % 8) for i in range(8)])
    assert editdist.graph_distance(many, LabelGraph(["y"] * 8, []), 5) is None and editdist.normalised_graph_distance(many, LabelGraph(["y"] * 8, []), 5) == 1.0
    assert not editdist.isomorphic(LabelGraph(["x", "y"], [(0, "p", 1)]), LabelGraph(["x", "y"], [(1, "p", 0)]))


def test_equal_and_unlike_queries(engine):
    q = "SELECT ?c { ?c :of_nation <kg:nation/3> }"
    same = equivalence.test_suite_score(engine, q, "SELECT ?x { ?x :of_nation <kg:nation/3> }", [A.Iri("kg:nation/3")]).first()
    assert (same.score, same.suite_size) == (1.0, -1)
    none = equivalence.test_suite_score(engine, q, "SELECT ?x { ?x :of_nation <kg:nation/4> }", [A.Iri("kg:nation/3")]).first()
    assert (none.score, none.suite_size) == (0.0, -1)
    broken = equivalence.test_suite_score(engine, q, "ASK { ?x :of_nation <kg:nation/3> }", [A.Iri("kg:nation/3")]).first()
    assert broken.score == 0.0


def test_search_finds_the_query(engine):
    answers = engine.sparql("SELECT DISTINCT ?o { ?o :placed_by <kg:customer/1> ; :status \"O\" }").toDF("answer")
    if answers.isEmpty():
        pytest.skip("the customer has no such order")
    best = synthesis.search(engine, answers, ["kg:customer/1", '"O"']).first()
    assert best.f1 == 1.0 and "placed_by" in best.query


def test_search_helpers(spark):
    cands = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "qid string, position int, query string")
    for reply, want in (("2.", "b"), ("none", "a"), ("the answer is 7", "a")):
        choice = spark.createDataFrame([("q", reply)], "qid string, reply string")
        assert synthesis.apply_choice(cands, choice).first()["query"] == want


def test_optional_and_minus_with_unbound(engine):
    text = "SELECT ?n ?r WHERE { ?n a :nation OPTIONAL { ?n :in_region ?r FILTER(?r = <kg:region/1>) } MINUS { ?n :in_region <kg:region/2> } }"
    rows = engine.sparql(text).collect()
    every = engine.sparql("SELECT ?n ?r { ?n :in_region ?r }").collect()
    want = {(r.n, r.r if r.r == "kg:region/1" else None) for r in every if r.r != "kg:region/2"}
    assert {tuple(r) for r in rows} == want


def test_union_join_with_unbound(engine):
    text = "SELECT ?a ?b { { BIND(1 AS ?a) } UNION { BIND(2 AS ?b) } VALUES (?a ?b) { (1 2) (3 2) } }"
    assert sorted(tuple(r) for r in engine.sparql(text).collect()) == [(1, 2), (1, 2), (3, 2)]


def test_errors_drop_rows(engine):
    assert engine.sparql('SELECT ?x { VALUES ?x { 1 "a" 3 } FILTER(?x + 1 > 2) }').count() == 1
    assert engine.sparql('SELECT ?x { VALUES ?x { 0 1 } FILTER(1 / ?x > 0 || ?x = 0) }').count() == 2
    with pytest.raises(ValueError):
        engine.sparql("SELECT ?x { SERVICE <http://e> { ?x :p 1 } }")


def test_top_k_matches_sort(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.filter("vec_id < 3").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    got = similarity.top_k(q, e, "q", "v", "vec_id", "embedding", 4).collect()
    rows = e.collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    for i in range(3):
        own = next(r for r in rows if r.vec_id == i)
        best = sorted(rows, key=lambda r: (-round(cos(own.embedding, r.embedding), 6), r.vec_id))[:4]
        assert [g.vec_id for g in sorted((g for g in got if g.q == i), key=lambda g: g.rank)] == [b.vec_id for b in best]


def test_top_k_of_many_queries(spark, monkeypatch):
    """More queries than were once accepted, in many blocks and chunks; ties, null, short and zero vectors."""
    many = spark.range(10_050).select(F.col("id").alias("q"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("v"))
    t = spark.createDataFrame([(5, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0, 2.0]), (1, None), (6, [0.0, 0.0]), (7, [1.0]), (8, [-1.0, 0.0])], "t long, w array<double>")
    monkeypatch.setattr(similarity, "BLOCK_QUERIES", 3000)
    got = {}
    for r in similarity.top_k(many, t, "q", "v", "t", "w", 2).collect():
        got.setdefault(r.q, {})[r.rank] = r.t
    want = {0: {1: 2, 2: 5}, 1: {1: 3, 2: 4}, 2: {1: 4, 2: 3}}
    assert len(got) == 10_050 and all(ranks == want[q % 3] for q, ranks in got.items())
    few = similarity.top_k(many.limit(1), t, "q", "v", "t", "w", 8).orderBy("rank").collect()
    assert [r.t for r in few] == [2, 5, 3, 4, 1, 6, 7, 8] and [r.similarity for r in few[4:]] == [0.0, 0.0, 0.0, -1.0]
    assert similarity.top_k(many.limit(0), t, "q", "v", "t", "w", 2).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 9999.0, True), ("b", 2.0, True), ("b", 3.0, False)], "qid string, t double, ok boolean")
    assert [tuple(r) for r in reports.valid_annotations(rows, "qid", "t", "ok").collect()] == [("b", 2.0, True)]
    parses = spark.createDataFrame([("q", ["x"], ["x", "y"]), ("q", ["x"], ["x"]), ("r", None, ["z"])], "qid string, p array<string>, g array<string>")
    best = {r.qid: (r.precision, r.recall, r.f1) for r in reports.best_parse(parses, "qid", "p", "g").collect()}
    assert best == {"q": (1.0, 1.0, 1.0), "r": (1.0, 0.0, 0.0)}
    leveled = {r.level: r.f1 for r in reports.leveled_report(spark.createDataFrame([("i", True, ["a"], ["b"]), ("z", False, ["a"], ["a", "b"])], "level string, em boolean, p array<string>, g array<string>"), "level", "em", "p", "g").collect()}
    assert leveled["i"] == 1.0 and abs(leveled["z"] - 2 / 3) < 1e-9 and abs(leveled["all"] - 5 / 6) < 1e-9
    marks = reports.mark_best(spark.createDataFrame([("g", 0.5), ("g", 0.5001), ("g", 0.3), ("g", 0.1)], "k string, s double"), "k", "s").orderBy(F.desc("s")).collect()
    assert [m.mark for m in marks] == [1, 1, 2, None]


def test_json_forms(spark, tmp_path):
    import json

    item = {"qid": "1", "searched_queries": [{"sparql": "a"}, {"sparql": "b"}]}
    for i, shape in enumerate(({"results": [item]}, [item], {"1": item})):
        (tmp_path / f"{i}.json").write_text(json.dumps(shape))
        rows = files.read_results(spark, f"file://{tmp_path}/{i}.json").collect()
        assert [(r.qid, r.position, r.sparql) for r in rows] == [("1", 0, "a"), ("1", 1, "b")]
    (tmp_path / "r.tsv").write_text("a\tb\nc\td\n")
    rev = {tuple(r) for r in files.read_reverse(spark, f"file://{tmp_path}/r.tsv").collect()}
    assert rev == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}
    names = [("beam.*gold", "beam, gold links"), ("beam", "beam")]
    kinds = files.method_of(F.lit("/x/set_BEAM_gold_1.json"), names, "plain"), files.method_of(F.lit("/x/other.json"), names, "plain")
    assert tuple(spark.range(1).select(*kinds).first()) == ("beam, gold links", "plain")
    out = files.once(spark, f"file://{tmp_path}/done", lambda: spark.range(3))
    again = files.once(spark, f"file://{tmp_path}/done", lambda: itertools.count())
    assert out.count() == again.count() == 3


def test_bindings(spark):
    rows = spark.createDataFrame([("uri", "http://a", None), ("typed-literal", "42", A.XSD + "integer"), ("typed-literal", "true", A.XSD + "boolean"), ("typed-literal", "99.95", A.XSD + "decimal"), ("literal", "x", None)], "type string, value string, datatype string")
    got = [tuple(r) for r in rows.select(files.binding_number(F.col("type"), F.col("value"), F.col("datatype")).alias("n"), files.binding_text(F.col("type"), F.col("value"), F.col("datatype")).alias("s")).collect()]
    assert got == [(None, "http://a"), (42.0, None), (1.0, None), (99.95, None), (None, "x")]


def test_endpoint_scan(spark):
    """A stand-in endpoint: rows, an ASK, a failure that passes, one that stays, and no query."""
    import json
    import threading
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs

    from quillgraph.sources import endpoint

    seen = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            q = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            seen[q] += 1
            if "BROKEN" in q or ("FLAKY" in q and seen[q] < 3):
                self.send_error(502)
                return
            rows = [{"x": {"type": "uri", "value": f"http://e/{i}"}, "n": {"type": "typed-literal", "value": str(i), "datatype": A.XSD + "integer"}, "l": {"type": "literal", "value": "é", "xml:lang": "fr"}} for i in range(3)]
            body = json.dumps({"boolean": True} if "ASK" in q else {"results": {"bindings": [] if "NONE" in q else rows}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        queries = spark.createDataFrame([("a", "SELECT"), ("b", "ASK"), ("c", "FLAKY"), ("d", "BROKEN"), ("e", "NONE"), ("f", None)], "qid string, text string")
        rows = endpoint.http_scan(queries, f"http://127.0.0.1:{server.server_port}/", partitions=2).collect()
    finally:
        server.shutdown()
    by = {q: [r for r in rows if r.qid == q] for q in "abcdef"}
    assert [r.bindings["n"].value for r in by["a"]] == ["0", "1", "2"] and by["a"][0].bindings["l"].lang == "fr" and by["a"][0].bindings["n"].datatype == A.XSD + "integer"
    assert by["b"][0].boolean is True and by["b"][0].bindings is None
    assert len(by["c"]) == 3 and not by["e"]
    assert "502" in by["d"][0].error and seen["BROKEN"] == 4 and by["f"][0].error == "no query"
    assert {r.value for r in endpoint.values(spark.createDataFrame(rows, "qid string, position int, bindings map<string,struct<type:string,value:string,datatype:string,lang:string>>, boolean boolean, error string"), "x").collect()} == {f"http://e/{i}" for i in range(3)}
    gone = endpoint.odbc_scan(queries.limit(1), "DSN=none", retries=1).first()
    assert gone.error


def _odd_lines(spark, folder, n=60):
    """A small graph of orders and parts whose lines have nulls, negative numbers, repeats and keys that unlike rows share."""
    rng = random.Random(11)
    rows = [(1, 3, 4, 1), (1, None, 3, 4), (None, 1, 3, 4), (5, 5, -6, 1), (7, 8, 9, None), (7, None, 8, 9), (2, 2, 2, 2), (2, 2, 2, 2), (None, None, 1, 1), (-1, 3, 0, 0)]
    rows += [(rng.randint(10, 30), rng.randint(0, 25), rng.randint(0, 3), rng.choice([1, 2, None])) for _ in range(n)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "timestamp'1998-01-01' AS l_shipdate", "1.5D AS l_extendedprice", "double(if(l_linenumber = 2, -1, 1)) AS l_quantity", "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag", "'O' AS l_linestatus")
    df.write.parquet(f"{folder}/lineitem.parquet")
    return sales_graph(spark, str(folder)), df


def test_closure_over_lines_equals_plain_search(spark, tmp_path):
    g, df = _odd_lines(spark, tmp_path)
    key = next(e.key for e in g.edges if e.cls == "lineitem")
    lines = [(r.o and f"kg:order/{r.o}", r.p and f"kg:part/{r.p}", f"kg:lineitem/{r.k}") for r in df.selectExpr("string(l_orderkey) AS o", "string(l_partkey) AS p", f"{key} AS k").collect()]
    plus = lambda of, start: (lambda seen: [seen.add(y) or todo.append(y) for todo in [[start]] for x in todo for y in of.get(x, ()) if y not in seen] and seen or seen)(set())
    both = {"of_order": {(k, o) for o, _, k in lines if o}, "of_part": {(k, p) for _, p, k in lines if p}}
    both |= {"^" + n: {(b, a) for a, b in pairs} for n, pairs in both.items()}
    starts = ["kg:order/1", "kg:order/2", "kg:order/5", "kg:part/3", "kg:order/404", "kg:order/01", "kg:order/x", lines[9][2], "kg:part/1", lines[0][2]]
    paths = [("^of_order", "of_order", "of_part", "^of_part"), ("^of_order", "of_part"), ("^of_order", "of_part", "^of_part")]
    for steps, forwards in itertools.product(paths, (True, False)):
        of = {}
        for a, b in set().union(*(both[s] for s in steps)):
            of.setdefault(a if forwards else b, set()).add(b if forwards else a)
        path = "|".join(s.replace("of_", ":of_") for s in steps)
        for start in starts if len(steps) == 4 and forwards else starts[3::6]:
            text = f"SELECT ?x WHERE {{ <{start}> ({path})+ ?x }}" if forwards else f"SELECT ?x WHERE {{ ?x ({path})+ <{start}> }}"
            got = [r.x for r in Engine(g).sparql(text).collect()]
            assert sorted(got) == sorted(plus(of, start)), (text,)


def test_closure_from_a_node_stores_no_long_keys(spark, sf_dir, tmp_path):
    """Lines are passed through by the numbers of their orders and parts; before, every edge was stored as text."""
    kept = []

    def store(df):
        kept.append(closure.stored(df))
        return kept[-1]

    e = Engine(sales_graph(spark, sf_dir), store)
    n = e.sparql("SELECT (COUNT(?x) AS ?n) WHERE { <kg:order/1> (:of_order|^:of_order|:of_part|^:of_part)+ ?x }").first()[0]
    assert n > 6000 and {t for df in kept for _, t in df.dtypes} == {"bigint"}
    assert sum(df.count() for df in kept) < n / 3


def test_rows_around_anchors_are_narrow_and_counted_once(spark, sf_dir, monkeypatch):
    """What is joined with anchors is their key and bits; before, whole rows were, and those around subjects twice."""
    g = sales_graph(spark, sf_dir)
    anchors = spark.createDataFrame([(f"kg:{c}/{k}",) for c in ("order", "supplier") for k in range(1, 9)], "node string")
    seen, whole = [], explore._counted
    monkeypatch.setattr(explore, "_counted", lambda parts, spark: seen.extend(parts) or whole(parts, spark))
    assert {r.way for r in explore.statement_steps(g, anchors, "lineitem", "of_order", "of_part").collect()} == {"nn", "rn", "rr"}
    assert len(seen) == 2 and all(len(df.columns) <= 2 for df, _ in seen)
    explore.next_relations(g, anchors)
    assert all(len(df.columns) <= 2 for df, cells in seen if not all(c.startswith("^") and "/" not in c for c in cells))


def test_more_cells_than_a_word_has_bits(spark):
    rows = spark.range(200).selectExpr("id % 7 AS k", *(f"if(id % {i + 1} = 0, id, NULL) AS c{i}" for i in range(130)))
    keys = spark.createDataFrame([(k,) for k in (0, 2, 5)], "anchor_ long")
    df, cells = explore._packed(rows, F.col("k"), keys, {f"r{i}": F.col(f"c{i}") for i in range(130)})
    got = {r.relation: (r.n_anchors, r.n_pairs) for r in explore._counted([(df, cells)], spark).collect()}
    want = {f"r{i}": [n % 7 for n in range(200) if n % (i + 1) == 0 and n % 7 in (0, 2, 5)] for i in range(130)}
    assert got == {r: (len(set(v)), len(v)) for r, v in want.items() if v}


def test_literals_are_read_once_a_row(spark):
    """Both sides are taken apart once for all comparators; before, the plan read them again for each."""
    values = ['"1998"', '"1998-02-30"', '"1998-02-03T04:05:06Z"', '"1998-2"', '"25"', '"25.0005"', '"-3"', '"NaN"', '"Infinity"', '"1e3"^^<d>', '"word"@en', '""', None]
    rows = spark.createDataFrame(list(itertools.product(values, values)), "a string, b string")
    held = metrics.holding_comparators(F.col("a"), F.col("b"))
    each = [F.when(metrics.compare_literals(F.col("a"), F.col("b"), op), name) for name, op in (("GE", ">="), ("GT", ">"), ("EQ", "="), ("LE", "<="), ("LT", "<"))]
    df = rows.select(held.alias("held"), F.array_compact(F.array(*each)).alias("each"))
    assert all(r.held == r.each for r in df.collect())
    assert rows.select(held.alias("held"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 12
