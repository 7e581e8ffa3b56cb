"""The registered queries of the graph engine, each with its SQL where SQL can express it.

Keys begin with the operator's id.  Results are plain integers, doubles and strings; IRIs are text of the
form ``kg:class/key``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import metrics
from quillgraph.functions import text as words
from quillgraph.operators import editdist, equivalence, explore, questions, reports, similarity, synthesis, treesearch
from quillgraph.plans import ast as A
from quillgraph.plans import querygraph, sexpr
from quillgraph.plans import rewrite as rewrites
from quillgraph.plans.compiler import Engine
from quillgraph.plans.parser import parse, parse_filter, parse_patterns
from quillgraph.plans.printer import query as show_query
from quillgraph.scratch import shared_folder
from quillgraph.sources import access, files
from quillgraph.sources.registry import sales_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(sales_graph(spark, sf_dir))


def sparql(key: str, text: str, sql: str | None = None) -> None:
    QUERIES[key] = lambda spark, sf_dir: engine(spark, sf_dir).sparql(text)
    if sql:
        SQL[key] = sql


def query(key: str, sql: str | None = None):
    def register(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINE = "'kg:lineitem/' || concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"

# ---- B: projection, filters, leaves
sparql("b1_select", "SELECT ?c ?n WHERE { ?c :mktsegment ?m ; :name ?n }", "SELECT 'kg:customer/' || c_custkey AS c, c_name AS n FROM customer")
sparql("b2_select_all", "SELECT * WHERE { ?n :in_region ?r ; :name ?label }", "SELECT 'kg:nation/' || n_nationkey AS n, 'kg:region/' || n_regionkey AS r, n_name AS label FROM nation")
sparql("b3_projected_expr", "SELECT ?s (?b * 2 + 1 AS ?twice) WHERE { ?s :acctbal ?b ; a :supplier }", "SELECT 'kg:supplier/' || s_suppkey AS s, s_acctbal * 2 + 1 AS twice FROM supplier")
sparql("b4_bare_expr", "SELECT ?n (STRLEN(?n)) WHERE { ?x :in_region ?r ; :name ?n }", "SELECT n_name AS n, length(n_name)::BIGINT AS expr1 FROM nation")
sparql("b5_distinct", "SELECT DISTINCT ?n WHERE { ?p :brand ?b ; :name ?n }", "SELECT DISTINCT p_name AS n FROM part")
sparql("b6_comma_projection", "SELECT ?p, ?b WHERE { ?p :brand ?b }", "SELECT 'kg:part/' || p_partkey AS p, p_brand AS b FROM part")
sparql("b7_lists", "SELECT ?o WHERE { ?o :status ?s, \"F\" ; :orderpriority ?p . FILTER(?p = \"1-URGENT\") }", "SELECT 'kg:order/' || o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
sparql("b8_blank_nodes", "SELECT ?q ?pr WHERE { [ :of_order <kg:order/1> ; :quantity ?q ; :extendedprice ?pr ] }", "SELECT l_quantity AS q, l_extendedprice AS pr FROM lineitem WHERE l_orderkey = 1")
sparql("b10_type", "SELECT ?x WHERE { ?x a :nation }", "SELECT 'kg:nation/' || n_nationkey AS x FROM nation")
sparql("b11_prefix", "PREFIX g: <kg:> SELECT ?n WHERE { ?x g:in_region <kg:region/1> ; g:name ?n }", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
sparql("b12_filter", "SELECT ?c WHERE { ?c :acctbal ?b ; :mktsegment ?m FILTER(?b > 5000 && ?m != \"BUILDING\") }", "SELECT 'kg:customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
sparql("b13_relational", "SELECT ?p ?s WHERE { ?p :size ?s FILTER(?s >= 10 && ?s < 20 || ?s = 45) }", "SELECT 'kg:part/' || p_partkey AS p, p_size::BIGINT AS s FROM part WHERE (p_size >= 10 AND p_size < 20) OR p_size = 45")
sparql("b14_in", "SELECT ?e WHERE { ?e :event_type ?t ; :value ?v FILTER(?t IN (\"click\", \"view\")) FILTER(?v NOT IN (1, 2)) }", "SELECT 'kg:event/' || event_id AS e FROM events WHERE event_type IN ('click', 'view') AND value NOT IN (1, 2)")
sparql("b15_logic", "SELECT ?o WHERE { ?o :status ?s ; :totalprice ?t FILTER(!(?s = \"O\") && (?t < 1000 || ?t > 300000)) }", "SELECT 'kg:order/' || o_orderkey AS o FROM orders WHERE NOT (o_orderstatus = 'O') AND (o_totalprice < 1000 OR o_totalprice > 300000)")
sparql("b16_arithmetic", "SELECT ?s (?b - 10 - 5 AS ?x) (-?b / 4 AS ?y) WHERE { ?s :acctbal ?b ; a :supplier }", "SELECT 'kg:supplier/' || s_suppkey AS s, s_acctbal - 10 - 5 AS x, -s_acctbal / 4 AS y FROM supplier")
sparql("b17_bind", "SELECT ?l ?net WHERE { ?x :of_order <kg:order/3> ; :extendedprice ?p ; :discount ?d ; :linestatus ?l BIND(?p * (1 - ?d) AS ?net) }", "SELECT l_linestatus AS l, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_orderkey = 3")
sparql("b18_values", "SELECT ?n ?x WHERE { VALUES (?r ?x) { (<kg:region/1> 10) (<kg:region/2> UNDEF) } ?n :in_region ?r }", "SELECT 'kg:nation/' || n_nationkey AS n, v.x AS x FROM nation JOIN (VALUES (1, 10::BIGINT), (2, NULL)) v(r, x) ON n_regionkey = v.r")
sparql("b18_values_undef_join", "SELECT ?n ?label WHERE { ?n :in_region <kg:region/1> ; :name ?label } VALUES (?n ?label) { (<kg:nation/1> UNDEF) (UNDEF \"NATION_6\") }", "SELECT 'kg:nation/' || n_nationkey AS n, n_name AS label FROM nation JOIN (VALUES (1, NULL), (NULL, 'NATION_6')) v(k, l) ON (n_nationkey = k OR k IS NULL) AND (n_name = l OR l IS NULL) WHERE n_regionkey = 1")
sparql("b17_bind_exists", "SELECT ?c ?open WHERE { ?c :mktsegment ?m BIND(EXISTS { ?o :placed_by ?c ; :status \"P\" } AS ?open) }", "SELECT 'kg:customer/' || c_custkey AS c, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS open FROM customer")
sparql("b20_graph", "SELECT ?g ?n WHERE { GRAPH ?g { ?n :in_region <kg:region/0> } }", "SELECT 'kg:graph' AS g, 'kg:nation/' || n_nationkey AS n FROM nation WHERE n_regionkey = 0")
sparql("b21_service_silent", "SELECT ?n WHERE { ?n a :region SERVICE SILENT <http://nowhere> { ?n :x ?y } }", "SELECT 'kg:region/' || r_regionkey AS n FROM region")
sparql("b22_namespace", "SELECT DISTINCT ?p WHERE { <kg:customer/1> ?p ?o FILTER(STRSTARTS(STR(?p), \"kg:\")) }", "SELECT unnest(['kg:name', 'kg:acctbal', 'kg:mktsegment', 'kg:of_nation']) AS p")
sparql("b23_ignored", "SELECT DISTINCT ?p WHERE { <kg:customer/1> ?p ?o FILTER(!REGEX(STR(?p), \"^kg:of_\")) }", "SELECT unnest(['kg:name', 'kg:acctbal', 'kg:mktsegment']) AS p")
sparql("b25_distinct_variables", "SELECT ?a ?b WHERE { ?a :in_region ?r . ?b :in_region ?r . FILTER(?a != ?b) }", "SELECT 'kg:nation/' || x.n_nationkey AS a, 'kg:nation/' || y.n_nationkey AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_nationkey <> y.n_nationkey")
sparql("b32_answer_filter", "SELECT ?x WHERE { ?d a :document ; :text ?x FILTER(!ISLITERAL(?x) OR LANG(?x) = '' OR LANGMATCHES(LANG(?x), 'en')) }", "SELECT text AS x FROM documents WHERE lang = 'en' AND text IS NOT NULL")
sparql("b33_lexical", "SELECT ?d WHERE { ?d :language ?l FILTER(ISLITERAL(?l) && STR(?l) = \"de\") }", "SELECT 'kg:document/' || doc_id AS d FROM documents WHERE lang = 'de'")
sparql("b34_cast_filter", "SELECT ?p WHERE { ?p :retailprice ?r FILTER(xsd:integer(?r) > 950) }", "SELECT 'kg:part/' || p_partkey AS p FROM part WHERE trunc(p_retailprice) > 950")

# ---- C: joins
sparql(
    "c1_bgp_chain",
    "SELECT DISTINCT ?name WHERE { ?l :of_order ?o ; :of_part ?p . ?o :placed_by ?c . ?c :of_nation ?n . ?n :name \"NATION_3\" . ?p :name ?name . FILTER NOT EXISTS { ?l :name ?x } }",
    "SELECT DISTINCT p_name AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE n_name = 'NATION_3'",
)
sparql("c2_inverse", "SELECT ?c WHERE { <kg:nation/3> ^:of_nation ?c . ?c :mktsegment ?m }", "SELECT 'kg:customer/' || c_custkey AS c FROM customer WHERE c_nationkey = 3")
sparql("c3_cvt_twohop", "SELECT DISTINCT ?s ?p WHERE { ?s ^:of_supplier/:of_part ?p FILTER(?s = <kg:supplier/2>) }", "SELECT DISTINCT 'kg:supplier/' || l_suppkey AS s, 'kg:part/' || l_partkey AS p FROM lineitem WHERE l_suppkey = 2")
sparql("c4_statement_star", "SELECT ?q WHERE { ?l :of_part <kg:part/5> ; :of_supplier ?s ; :quantity ?q }", "SELECT l_quantity AS q FROM lineitem WHERE l_partkey = 5")
sparql("c5_optional_label", "SELECT ?d ?q WHERE { ?d :source ?s OPTIONAL { ?d :quality ?q FILTER(?q > 0) } }", "SELECT 'kg:document/' || d.doc_id AS d, CASE WHEN quality > 0 THEN quality END::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sparql("c6_minus", "SELECT ?d WHERE { ?d :source ?s MINUS { ?d :toxic 1 } }", "SELECT 'kg:document/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
sparql("c6_minus_disjoint", "SELECT ?n WHERE { ?n a :region MINUS { ?x a :nation } }", "SELECT 'kg:region/' || r_regionkey AS n FROM region")
sparql("c5_optional_chain", "SELECT ?d ?q WHERE { ?d :source ?s OPTIONAL { ?d :quality ?q } OPTIONAL { ?d :toxic ?q } }", "SELECT 'kg:document/' || d.doc_id AS d, coalesce(quality, toxic)::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sparql("c6_minus_unbound", "SELECT ?d ?q WHERE { ?d :source ?s OPTIONAL { ?d :quality ?q } MINUS { ?e :toxic ?q FILTER(?q = 1) } }", "SELECT 'kg:document/' || d.doc_id AS d, quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality <> 1 OR NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1)")
sparql("c7_exists", "SELECT ?c WHERE { ?c :mktsegment ?m FILTER EXISTS { ?o :placed_by ?c ; :orderpriority \"1-URGENT\" } }", "SELECT 'kg:customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
sparql("c8_not_exists", "SELECT ?c WHERE { ?c :mktsegment ?m FILTER NOT EXISTS { ?o :placed_by ?c ; :status \"P\" } }", "SELECT 'kg:customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sparql("c8_correlated_filter", "SELECT ?c WHERE { ?c :acctbal ?b ; :mktsegment ?m FILTER NOT EXISTS { ?o :placed_by ?c ; :totalprice ?t FILTER(?t > ?b * 50) } }", "SELECT 'kg:customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)")
sparql("c9_exists_or", "SELECT ?c WHERE { ?c :acctbal ?b ; :mktsegment ?m FILTER(EXISTS { ?o :placed_by ?c ; :status \"P\" } || ?b < 0) }", "SELECT 'kg:customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR c_acctbal < 0")
sparql("c10_values_semi", "SELECT ?o WHERE { VALUES ?c { <kg:customer/1> <kg:customer/4> <kg:customer/7> } ?o :placed_by ?c }", "SELECT 'kg:order/' || o_orderkey AS o FROM orders WHERE o_custkey IN (1, 4, 7)")
sparql("c12_subquery", "SELECT ?n ?c WHERE { { SELECT DISTINCT ?n WHERE { ?s :of_nation ?n ; a :supplier } LIMIT 10000000 } ?n :in_region ?r . ?c :of_nation ?n ; :mktsegment \"MACHINERY\" }", "SELECT 'kg:nation/' || n_nationkey AS n, 'kg:customer/' || c_custkey AS c FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
sparql("c13_theta", "SELECT ?a ?b WHERE { ?a :of_nation <kg:nation/3> ; :acctbal ?x ; a :supplier . ?b :of_nation <kg:nation/3> ; :acctbal ?y ; a :supplier . FILTER(?x < ?y) }", "SELECT 'kg:supplier/' || a.s_suppkey AS a, 'kg:supplier/' || b.s_suppkey AS b FROM supplier a, supplier b WHERE a.s_nationkey = 3 AND b.s_nationkey = 3 AND a.s_acctbal < b.s_acctbal")
sparql("c15_class_closure", "SELECT ?x WHERE { ?x :of_nation/:in_region* <kg:region/2> . ?x a :supplier }", "SELECT 'kg:supplier/' || s_suppkey AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
sparql("c20_intermediate_compare", "SELECT DISTINCT ?p WHERE { ?p ^:of_part/:quantity ?q FILTER(?q >= 49) }", "SELECT DISTINCT 'kg:part/' || l_partkey AS p FROM lineitem WHERE l_quantity >= 49")


@query("c11_label_batch", "SELECT 'kg:customer/' || c_custkey AS node, c_name AS label FROM customer UNION ALL SELECT 'kg:order/' || o_orderkey, NULL FROM orders")
def _c11(spark, sf_dir):
    return explore.labels(sales_graph(spark, sf_dir), _every(spark, sf_dir, "customer", "c_custkey").unionByName(_every(spark, sf_dir, "orders", "o_orderkey", "order")))


@query("c16_relation_intersection", "SELECT unnest(['name', 'acctbal', 'mktsegment', 'of_nation', '^placed_by', '^by_user']) AS relation")
def _c16(spark, sf_dir):
    g = sales_graph(spark, sf_dir)
    # three customers that have orders and events
    some = explore.sample_nodes(engine(spark, sf_dir).sparql("SELECT DISTINCT ?c WHERE { ?o :placed_by ?c . ?e :by_user ?c }"), 3)
    return explore.common_relations(explore.next_relations(g, some), 3)


@query("c19_interval_validity", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate AS s, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 90 DAY END AS e FROM orders) WHERE s <= TIMESTAMP '1996-12-31' AND (e IS NULL OR e >= TIMESTAMP '1996-01-01')")
def _c19(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s"), F.when(F.col("o_orderstatus") != "O", F.expr("o_orderdate + interval 90 days")).alias("e"))
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    return o.filter(metrics.valid_in(F.col("s"), F.col("e"), lit("1996-01-01"), lit("1996-12-31"))).select("o_custkey", "o_orderkey")


# ---- D: aggregation
sparql("d1_count", "SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?m) AS ?d) WHERE { ?c :mktsegment ?m }", "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS d FROM customer")
sparql("d2_sum_min_max_avg", "SELECT ?s (SUM(?z) AS ?a) (MIN(?z) AS ?b) (MAX(?z) AS ?c) (AVG(?z) AS ?d) (SUM(DISTINCT ?z) AS ?e) WHERE { ?p :brand ?s ; :size ?z } GROUP BY ?s", "SELECT p_brand AS s, sum(p_size)::BIGINT AS a, min(p_size)::BIGINT AS b, max(p_size)::BIGINT AS c, avg(p_size) AS d, sum(DISTINCT p_size)::BIGINT AS e FROM part GROUP BY 1")
sparql("d3_sample", "SELECT ?r (SAMPLE(?n) AS ?x) WHERE { ?k :in_region ?r ; :name ?n } GROUP BY ?r", "SELECT 'kg:region/' || n_regionkey AS r, min(n_name) AS x FROM nation GROUP BY 1")
sparql("d4_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=\"|\") AS ?x) WHERE { ?k :in_region ?r ; :name ?n } GROUP BY ?r", "SELECT 'kg:region/' || n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS x FROM nation GROUP BY 1")
sparql("d5_group_expr", "SELECT ?y (COUNT(?o) AS ?n) WHERE { ?o :orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY 1")
sparql("d6_having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :placed_by ?c } GROUP BY ?c HAVING(COUNT(?o) > 14)", "SELECT 'kg:customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14")
sparql("d7_implicit_group", "SELECT (COUNT(DISTINCT ?c) AS ?n) ?k WHERE { ?c :of_nation ?k ; :mktsegment ?m }", "SELECT count(DISTINCT c_custkey) AS n, 'kg:nation/' || c_nationkey AS k FROM customer GROUP BY 2")
sparql("d8_distinct_count", "SELECT DISTINCT COUNT(?n) AS ?cnt WHERE { ?p :brand ?b ; :name ?n }", "SELECT count(p_name) AS cnt FROM part")
sparql("d9_count_distinct", "SELECT (COUNT(DISTINCT ?n) AS ?cnt) WHERE { ?p :brand ?b ; :name ?n }", "SELECT count(DISTINCT p_name) AS cnt FROM part")
sparql("d10_count_dialect", "SELECT COUNT DISTINCT ?x WHERE { ?e :by_user ?x }", "SELECT count(DISTINCT user_id) AS expr0 FROM events")
_RATED = "(SELECT doc_id AS qid, CASE WHEN quality = 1 THEN 'graph' ELSE 'plain' END AS method, (n_chars % 101) / 100.0 AS score, (n_chars % 6)::INT AS hops, toxic = 0 AS good, lang AS level FROM labels JOIN documents USING (doc_id))"


def _rated(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(F.col("doc_id").alias("qid"), F.when(F.col("quality") == 1, "graph").otherwise("plain").alias("method"), (F.col("n_chars") % 101 / 100.0).alias("score"), (F.col("n_chars") % 6).cast("int").alias("hops"), (F.col("toxic") == 0).alias("good"), F.col("lang").alias("level"))


@query("d11_group_answers", "SELECT 'kg:nation/' || c_nationkey AS replace0, array_to_string(list_sort(list(DISTINCT 'kg:customer/' || c_custkey)), ',') AS answers FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def _d11(spark, sf_dir):
    e = engine(spark, sf_dir)
    q = A.Iri("kg:nation/3")
    text = "SELECT ?c WHERE { ?c :of_nation <kg:nation/3> ; :mktsegment \"BUILDING\" }"
    return equivalence.answers(e, equivalence._read(text), {q: "replace0"}).select("replace0", F.array_join(F.array_sort("answers"), ",").alias("answers"))


@query("d13_method_means", f"SELECT method, count(*) AS n, round(avg(score), 9) AS score FROM {_RATED} GROUP BY 1")
def _d13(spark, sf_dir):
    return reports.method_means(_rated(spark, sf_dir), "method", ["score"]).withColumn("score", F.round("score", 9))


@query("d14_binned_means", f"SELECT CASE WHEN hops > 3 THEN '>3' WHEN hops >= 1 THEN hops::VARCHAR END AS row_bin, CASE WHEN score = 0 THEN '0' WHEN score <= 0.25 THEN '(0,0.25]' WHEN score <= 0.75 THEN '(0.25,0.75]' ELSE '(0.75,1]' END AS col_bin, count(*) AS n, round(avg(score), 9) AS mean FROM {_RATED} GROUP BY 1, 2")
def _d14(spark, sf_dir):
    return reports.binned_mean(_rated(spark, sf_dir), reports.hop_bin(F.col("hops")), reports.score_bin(F.col("score")), "score").withColumn("mean", F.round("mean", 9))


@query("d15_level_rollup", f"SELECT level, count(*) AS n, round(avg(score), 9) AS score FROM {_RATED} GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(score), 9) FROM {_RATED}")
def _d15(spark, sf_dir):
    return reports.level_means(_rated(spark, sf_dir), "level", ["score"]).withColumn("score", F.round("score", 9))


@query("d16_threshold_sweep", f"SELECT t / 20.0::DOUBLE AS threshold, count(*) FILTER (NOT good AND score >= t / 20.0) AS false_positives, count(*) FILTER (good AND score < t / 20.0) AS false_negatives FROM {_RATED}, range(20) r(t) GROUP BY t")
def _d16(spark, sf_dir):
    return reports.threshold_sweep(_rated(spark, sf_dir), "score", "good", [t / 20.0 for t in range(20)])


sparql("d17_distribution", "SELECT ?t (COUNT(*) AS ?n) WHERE { ?e :event_type ?t } GROUP BY ?t", "SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1")

# ---- E: property paths
sparql("e1_sequence", "SELECT ?c ?r WHERE { ?c :of_nation/:in_region/:name ?r ; :mktsegment \"FURNITURE\" }", "SELECT 'kg:customer/' || c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'FURNITURE'")
sparql("e2_alt", "SELECT ?x WHERE { <kg:order/1> :status|:orderpriority ?x }", "SELECT o_orderstatus AS x FROM orders WHERE o_orderkey = 1 UNION ALL SELECT o_orderpriority FROM orders WHERE o_orderkey = 1")
sparql("e3_inverse", "SELECT ?n WHERE { <kg:region/1> ^:in_region ?n }", "SELECT 'kg:nation/' || n_nationkey AS n FROM nation WHERE n_regionkey = 1")
sparql("e4_optional_path", "SELECT ?x WHERE { <kg:nation/1> :in_region? ?x }", "SELECT 'kg:region/' || n_regionkey AS x FROM nation WHERE n_nationkey = 1 UNION SELECT 'kg:nation/1'")
sparql("e5_closure", "SELECT ?a ?b WHERE { ?a (:in_region|^:in_region)+ ?b . FILTER(?a = <kg:nation/2>) }", "SELECT 'kg:nation/2' AS a, 'kg:region/' || n_regionkey AS b FROM nation WHERE n_nationkey = 2 UNION SELECT 'kg:nation/2', 'kg:nation/' || n_nationkey FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 2)")
sparql("e5_closure_star", "SELECT ?x WHERE { <kg:customer/1> (:of_nation|:in_region)* ?x }", "SELECT 'kg:customer/1' AS x UNION SELECT 'kg:nation/' || c_nationkey FROM customer WHERE c_custkey = 1 UNION SELECT 'kg:region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
sparql(
    "e5_deep_closure",
    "SELECT (COUNT(?x) AS ?n) WHERE { <kg:order/1> (:of_order|^:of_order|:of_part|^:of_part)+ ?x }",
    """WITH RECURSIVE l AS (SELECT 'o' || l_orderkey AS o, 'p' || l_partkey AS p, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, epoch_us(l_shipdate), l_extendedprice, l_quantity) AS k FROM lineitem),
  e AS (SELECT k AS a, o AS b FROM l UNION SELECT o, k FROM l UNION SELECT k, p FROM l UNION SELECT p, k FROM l),
  r AS (SELECT b FROM e WHERE a = 'o1' UNION SELECT e.b FROM r JOIN e ON r.b = e.a)
SELECT count(*) AS n FROM r""",
)
sparql(
    "e5_zero_length",
    "SELECT (COUNT(*) AS ?n) WHERE { ?x :in_region* ?y }",
    """WITH s AS (SELECT r_name FROM region UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer UNION SELECT c_mktsegment FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part UNION SELECT p_brand FROM part
    UNION SELECT p_type FROM part UNION SELECT o_orderstatus FROM orders UNION SELECT o_orderpriority FROM orders UNION SELECT l_returnflag FROM lineitem UNION SELECT l_linestatus FROM lineitem UNION SELECT event_type FROM events
    UNION SELECT lang FROM documents UNION SELECT source FROM documents UNION SELECT role FROM conversations UNION SELECT text FROM conversations UNION SELECT url FROM pages UNION SELECT text FROM benchmark),
  i AS (SELECT p_size::BIGINT AS v FROM part UNION SELECT n_chars FROM documents UNION SELECT quality FROM labels UNION SELECT toxic FROM labels UNION SELECT turn FROM conversations),
  f AS (SELECT c_acctbal AS v FROM customer UNION SELECT s_acctbal FROM supplier UNION SELECT p_retailprice FROM part UNION SELECT o_totalprice FROM orders UNION SELECT l_quantity FROM lineitem UNION SELECT l_extendedprice FROM lineitem
    UNION SELECT l_discount FROM lineitem UNION SELECT l_tax FROM lineitem UNION SELECT value FROM events),
  t AS (SELECT date_trunc('second', o_orderdate) AS v FROM orders UNION SELECT date_trunc('second', l_shipdate) FROM lineitem UNION SELECT date_trunc('second', ts) FROM events),
  g AS (SELECT DISTINCT text, lower(lang) AS l FROM documents WHERE text IS NOT NULL),
  n AS (SELECT 'r' AS c, r_regionkey::VARCHAR AS k FROM region UNION SELECT 'r', n_regionkey::VARCHAR FROM nation UNION SELECT 'n', n_nationkey::VARCHAR FROM nation UNION SELECT 'n', c_nationkey::VARCHAR FROM customer
    UNION SELECT 'n', s_nationkey::VARCHAR FROM supplier UNION SELECT 'c', c_custkey::VARCHAR FROM customer UNION SELECT 'c', o_custkey::VARCHAR FROM orders UNION SELECT 'c', user_id::VARCHAR FROM events UNION SELECT 's', s_suppkey::VARCHAR FROM supplier
    UNION SELECT 's', l_suppkey::VARCHAR FROM lineitem UNION SELECT 'p', p_partkey::VARCHAR FROM part UNION SELECT 'p', l_partkey::VARCHAR FROM lineitem UNION SELECT 'o', o_orderkey::VARCHAR FROM orders UNION SELECT 'o', l_orderkey::VARCHAR FROM lineitem
    UNION SELECT 'l', concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, epoch_us(l_shipdate), l_extendedprice, l_quantity) FROM lineitem UNION SELECT 'e', event_id::VARCHAR FROM events UNION SELECT 'd', doc_id::VARCHAR FROM documents
    UNION SELECT 'd', doc_id::VARCHAR FROM labels UNION SELECT 'v', conv_id::VARCHAR FROM conversations UNION SELECT 'u', concat_ws('-', conv_id, turn) FROM conversations UNION SELECT 'w', page_id::VARCHAR FROM pages UNION SELECT 'i', item_id::VARCHAR FROM benchmark)
SELECT (SELECT count(*) FROM s WHERE r_name IS NOT NULL) + (SELECT count(v) FROM i) + (SELECT count(v) FROM f) + (SELECT count(v) FROM t) + (SELECT count(*) FROM g) + (SELECT count(k) FROM n) + (SELECT count(*) FROM nation) AS n""",
)
sparql("e6_negated_set", "SELECT ?o WHERE { <kg:order/2> !(:status|:orderdate|:totalprice) ?o }", "SELECT 'kg:customer/' || o_custkey AS o FROM orders WHERE o_orderkey = 2 UNION ALL SELECT o_orderpriority FROM orders WHERE o_orderkey = 2")
sparql("e7_grouping", "SELECT ?n WHERE { <kg:customer/5> (:of_nation/:in_region)/:name ?n }", "SELECT r_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 5")


@query("e9_reverse_names", "SELECT unnest(['has_nation', 'of_nation', '^placed_by']) AS relation")
def _e9(spark, sf_dir):
    rel = spark.createDataFrame([("^in_region",), ("of_nation",), ("^placed_by",)], "relation string")
    rev = spark.createDataFrame([("in_region", "has_nation")], "relation string, reverse string")
    return explore.normalise_reverse(rel, rev)


# ---- F: sets
sparql("f1_union_reversed", "SELECT ?x ?reversed WHERE { { <kg:nation/3> :in_region ?x BIND(0 AS ?reversed) } UNION { ?x :of_nation <kg:nation/3> BIND(1 AS ?reversed) ?x a :supplier } }", "SELECT 'kg:region/' || n_regionkey AS x, 0::BIGINT AS reversed FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'kg:supplier/' || s_suppkey, 1 FROM supplier WHERE s_nationkey = 3")
sparql("f1_union_unbound", "SELECT ?c ?s WHERE { { ?c :of_nation <kg:nation/1> ; :mktsegment ?m } UNION { ?s :of_nation <kg:nation/1> ; a :supplier } }", "SELECT 'kg:customer/' || c_custkey AS c, NULL AS s FROM customer WHERE c_nationkey = 1 UNION ALL SELECT NULL, 'kg:supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 1")

# ---- G: order, limit, top-k
sparql("g1_order", "SELECT ?c ?b WHERE { ?c :acctbal ?b ; :mktsegment ?m } ORDER BY DESC(?b) ?c LIMIT 25", "SELECT 'kg:customer/' || c_custkey AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_custkey::VARCHAR LIMIT 25")
sparql("g2_offset", "SELECT ?c WHERE { ?c :mktsegment ?m } ORDER BY ?c OFFSET 10 LIMIT 15", "SELECT 'kg:customer/' || c_custkey AS c FROM customer ORDER BY c_custkey LIMIT 15 OFFSET 10")
sparql("g3_any_order", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?c :of_nation ?n ; :mktsegment ?m } LIMIT 5 ORDER BY DESC(?k) ?n GROUP BY ?n", "SELECT 'kg:nation/' || c_nationkey AS n, count(*) AS k FROM customer GROUP BY c_nationkey ORDER BY 2 DESC, c_nationkey LIMIT 5")
sparql("g4_argmax", "SELECT ?o WHERE { ?o :placed_by ?c ; :totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 1", "SELECT 'kg:order/' || o_orderkey AS o FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
sparql("g6_max_subquery", "SELECT ?p WHERE { ?p :retailprice ?r { SELECT (MAX(?x) AS ?m) WHERE { ?y :retailprice ?x } } FILTER(?r = ?m) }", "SELECT 'kg:part/' || p_partkey AS p FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)")


@query("g8_similarity_topk", """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (
  SELECT q.vec_id AS query, e.vec_id AS vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings e)
SELECT query, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10""")
def _g8(spark, sf_dir):
    """The stated query set: every id divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    return similarity.top_k(q, e, "query", "qv", "vec_id", "embedding", 10)


@query("g11_keep_highest", f"SELECT level, qid FROM (SELECT level, qid, rank() OVER (PARTITION BY level ORDER BY score DESC) AS k FROM {_RATED}) WHERE k = 1")
def _g11(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("level").orderBy(F.desc("score"))
    return _rated(spark, sf_dir).withColumn("k", F.rank().over(w)).filter("k = 1").select("level", "qid")


@query("g14_best_marks", f"WITH m AS (SELECT level, method, avg(score) AS mean FROM {_RATED} GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (PARTITION BY level ORDER BY round(mean / 0.001) DESC) AS k FROM m) SELECT level, method, CASE WHEN k <= 2 THEN k END::INT AS mark FROM r")
def _g14(spark, sf_dir):
    m = _rated(spark, sf_dir).groupBy("level", "method").agg(F.avg("score").alias("mean"))
    return reports.mark_best(m, "level", "mean").select("level", "method", "mark")


# ---- I: scalar functions
sparql("i1_str_lang_datatype", "SELECT ?d (STR(?d) AS ?s) (LANG(?t) AS ?l) (DATATYPE(?n) AS ?k) WHERE { ?d :text ?t ; :n_chars ?n FILTER(LANG(?t) = \"fr\") }", "SELECT 'kg:document/' || doc_id AS d, 'kg:document/' || doc_id AS s, 'fr' AS l, 'http://www.w3.org/2001/XMLSchema#integer' AS k FROM documents WHERE lang = 'fr' AND text IS NOT NULL AND n_chars IS NOT NULL")
sparql("i6_numbers", "SELECT ?s (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?s :acctbal ?b ; a :supplier }", "SELECT 'kg:supplier/' || s_suppkey AS s, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(s_acctbal + 0.5) AS r FROM supplier")
sparql("i8_strings", "SELECT ?n (STRLEN(?n) AS ?a) (UCASE(?n) AS ?b) (LCASE(?n) AS ?c) (SUBSTR(?n, 2, 3) AS ?d) (CONCAT(?n, \"!\") AS ?e) WHERE { ?x :in_region ?r ; :name ?n }", "SELECT n_name AS n, length(n_name)::BIGINT AS a, upper(n_name) AS b, lower(n_name) AS c, substr(n_name, 2, 3) AS d, n_name || '!' AS e FROM nation")
sparql("i9_encode", "SELECT ?u (ENCODE_FOR_URI(?u) AS ?e) WHERE { ?p :url ?u }", "SELECT url AS u, url_encode(url) AS e FROM pages")
sparql("i10_times", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) (SECONDS(?d) AS ?s) WHERE { ?o :orderdate ?d }", "SELECT 'kg:order/' || o_orderkey AS o, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS k, hour(o_orderdate)::BIGINT AS h, minute(o_orderdate)::BIGINT AS i, second(o_orderdate)::DOUBLE AS s FROM orders")
sparql("i13_hashes", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x :in_region ?r ; :name ?n }", "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation")
sparql("i14_kinds", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o FILTER(ISIRI(?o)) } GROUP BY ?p", "SELECT 'kg:in_region' AS p, count(*) AS n FROM nation UNION ALL SELECT 'kg:of_nation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'kg:placed_by', count(*) FROM orders UNION ALL SELECT unnest(['kg:of_order', 'kg:of_part', 'kg:of_supplier']), count(*) FROM lineitem UNION ALL SELECT 'kg:by_user', count(*) FROM events UNION ALL SELECT 'kg:in_conversation', count(*) FROM conversations")
sparql("i14_numeric", "SELECT ?p WHERE { <kg:part/7> ?p ?o FILTER(ISNUMERIC(?o)) }", "SELECT unnest(['kg:size', 'kg:retailprice']) AS p")
sparql("i15_langmatches", "SELECT ?d WHERE { ?d :text ?t FILTER(LANGMATCHES(LANG(?t), \"es\")) }", "SELECT 'kg:document/' || doc_id AS d FROM documents WHERE lang = 'es'")
sparql("i16_contains", "SELECT ?p (STRSTARTS(?n, \"p\") AS ?a) (STRENDS(?n, \"1\") AS ?b) WHERE { ?p :name ?n ; :brand ?x FILTER(CONTAINS(?n, \"a\")) }", "SELECT 'kg:part/' || p_partkey AS p, starts_with(p_name, 'p') AS a, ends_with(p_name, '1') AS b FROM part WHERE contains(p_name, 'a')")
sparql("i17_before_after", "SELECT ?n (STRBEFORE(?n, \"_\") AS ?a) (STRAFTER(?n, \"_\") AS ?b) (STRBEFORE(?n, \"#\") AS ?c) WHERE { ?x :in_region ?r ; :name ?n }", "SELECT n_name AS n, split_part(n_name, '_', 1) AS a, split_part(n_name, '_', 2) AS b, '' AS c FROM nation")
sparql("i18_strlang", "SELECT ?n (LANG(STRLANG(?n, \"EN\")) AS ?l) (DATATYPE(STRDT(?n, xsd:token)) AS ?t) WHERE { ?x a :region ; :name ?n }", "SELECT r_name AS n, 'en' AS l, 'http://www.w3.org/2001/XMLSchema#token' AS t FROM region")
sparql("i19_sameterm", "SELECT ?a ?b WHERE { ?a :in_region ?r . ?b :in_region ?q . FILTER(SAMETERM(?r, ?q) && ?a != ?b) }", "SELECT 'kg:nation/' || x.n_nationkey AS a, 'kg:nation/' || y.n_nationkey AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_nationkey <> y.n_nationkey")
sparql("i20_generated", "SELECT ?n (STRLEN(STRUUID()) AS ?u) (RAND() < 1 AS ?r) (NOW() > \"2000-01-01\"^^xsd:date AS ?t) WHERE { ?n a :region }", "SELECT 'kg:region/' || r_regionkey AS n, 36::BIGINT AS u, true AS r, true AS t FROM region")
sparql("i21_bound_coalesce_if", "SELECT ?d (BOUND(?q) AS ?b) (COALESCE(?q, -1) AS ?c) (IF(BOUND(?q), \"yes\", \"no\") AS ?i) WHERE { ?d :source ?s OPTIONAL { ?d :quality ?q } }", "SELECT 'kg:document/' || d.doc_id AS d, quality IS NOT NULL AS b, coalesce(quality, -1)::BIGINT AS c, CASE WHEN quality IS NOT NULL THEN 'yes' ELSE 'no' END AS i FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sparql("i25_regex_replace", "SELECT ?n (REPLACE(?n, \"N([A-Z]+)_\", \"<$1>\") AS ?r) WHERE { ?x :in_region ?k ; :name ?n FILTER(REGEX(?n, \"^nation_1\", \"i\")) }", "SELECT n_name AS n, regexp_replace(n_name, 'N([A-Z]+)_', '<\\1>', 'g') AS r FROM nation WHERE regexp_matches(n_name, '^nation_1', 'i')")
sparql("i28_casts", "SELECT ?p (xsd:integer(?r) AS ?a) (xsd:string(?z) AS ?b) (xsd:double(\"x\") AS ?c) (xsd:boolean(?z) AS ?d) WHERE { ?p :retailprice ?r ; :size ?z }", "SELECT 'kg:part/' || p_partkey AS p, trunc(p_retailprice)::BIGINT AS a, p_size::VARCHAR AS b, NULL::DOUBLE AS c, p_size <> 0 AS d FROM part")
sparql("i30_year_compare", "SELECT ?o WHERE { ?o :orderdate ?d FILTER(YEAR(?d) >= 2000) }", "SELECT 'kg:order/' || o_orderkey AS o FROM orders WHERE year(o_orderdate) >= 2000")


# ---- J: text and scores
@query("j2_prf1", """WITH a AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 20) AS p, list(DISTINCT event_type) FILTER (value < 40) AS g FROM events GROUP BY 1),
 s AS (SELECT user_id, coalesce(len(p), 0) AS n, coalesce(len(g), 0) AS m, coalesce(len(list_intersect(p, g)), 0) AS c FROM a),
 t AS (SELECT user_id, CASE WHEN n = 0 AND m = 0 THEN 1.0::DOUBLE WHEN n > 0 AND m > 0 THEN c::DOUBLE / n ELSE 0.0 END AS precision, CASE WHEN n = 0 AND m = 0 THEN 1.0::DOUBLE WHEN n > 0 AND m > 0 THEN c::DOUBLE / m ELSE 0.0 END AS recall FROM s)
SELECT user_id, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM t""")
def _j2(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("p"), F.collect_set(F.when(F.col("value") < 40, F.col("event_type"))).alias("g"))
    return a.select("user_id", metrics.prf1(F.col("p"), F.col("g")).alias("m")).select("user_id", "m.*")


@query("j1_jaccard", "WITH a AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (value > 20), []) AS p, coalesce(list(DISTINCT event_type) FILTER (value < 40), []) AS g FROM events GROUP BY 1) SELECT user_id, CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE len(list_intersect(p, g))::DOUBLE / (len(p) + len(g) - len(list_intersect(p, g))) END AS j FROM a")
def _j1(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("p"), F.collect_set(F.when(F.col("value") < 40, F.col("event_type"))).alias("g"))
    return a.select("user_id", metrics.jaccard(F.col("p"), F.col("g")).alias("j"))


@query("j3_prf1_count", "SELECT event_type, user_id % 7 AS k, least(count(*), 20)::DOUBLE / count(*) AS precision, least(count(*), 20) / 20.0::DOUBLE AS recall FROM events GROUP BY 1, 2")
def _j3(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("k")).agg(F.count("*").alias("n"))
    m = metrics.prf1_counts(F.col("n"), F.lit(20))
    return a.select("event_type", "k", m["precision"].alias("precision"), m["recall"].alias("recall"))


@query("j4_prf1_lists", """WITH a AS (SELECT user_id, coalesce(list(event_type) FILTER (value > 20), []) AS p, coalesce(list(event_type) FILTER (value < 40), []) AS g FROM events GROUP BY 1),
 s AS (SELECT user_id, len(p) AS n, len(g) AS m, len(list_filter(g, lambda x: list_contains(p, x))) AS tp, len(list_filter(p, lambda x: NOT list_contains(g, x))) AS fp FROM a)
SELECT user_id, CASE WHEN m = 0 THEN CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.0 END WHEN n = 0 THEN 1.0 WHEN tp + fp = 0 THEN NULL ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN m = 0 THEN 1.0::DOUBLE WHEN n = 0 THEN 0.0 ELSE tp::DOUBLE / m END AS recall FROM s""")
def _j4(spark, sf_dir):
    none = F.expr("array()").cast("array<string>")
    e = table(spark, sf_dir, "events")
    a = e.groupBy("user_id").agg(F.coalesce(F.collect_list(F.when(F.col("value") > 20, F.col("event_type"))), none).alias("p"), F.coalesce(F.collect_list(F.when(F.col("value") < 40, F.col("event_type"))), none).alias("g"))
    return a.select("user_id", metrics.prf1_lists(F.col("p"), F.col("g")).alias("m")).select("user_id", "m.precision", "m.recall")


_STOP = ", ".join(f"'{w}'" for w in words.STOP_WORDS)


@query("b28_token_overlap", rf"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[,.;:#_?-]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(list_filter(a.w, lambda x: x NOT IN ({_STOP})), b.w)) > 0""")
def _b28(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark")
    # the benchmark is a small, fixed table
    a, b = t.select(F.col("item_id").alias("a"), F.col("text").alias("x")), t.select(F.col("item_id").alias("b"), F.col("text").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).filter(words.has_token_overlap(F.col("x"), F.col("y"))).select("a", "b")


_LITERALS = [('"12"', '"12.0005"'), ('"1999"', '"1999-01-01"'), ('"5.5"^^<http://www.w3.org/2001/XMLSchema#float>', '"7"'), ('"2001-05-06T00:00:00"', '"2001-05-06"'), ('"abc"', '"1"'), ('"2010-08"', '"2010-08-02-08:00"'), ('"3.1"', '"3.1"')]


@query("b30_compare_literals", "SELECT * FROM (VALUES (0, 'EQ,GE,LE'), (1, 'EQ,GE,LE'), (2, 'LE,LT'), (3, 'EQ,GE,LE'), (4, ''), (5, 'LE,LT'), (6, 'EQ,GE,LE')) v(i, held)")
def _b30(spark, sf_dir):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_LITERALS)], "i int, a string, b string")
    return rows.select("i", F.array_join(F.array_sort(metrics.holding_comparators(F.col("a"), F.col("b"))), ",").alias("held"))


@query("b29_constant_kind", "SELECT * FROM (VALUES ('m.0abc', 'entity'), ('people.person', 'class'), ('\"3\"^^<http://www.w3.org/2001/XMLSchema#integer>', 'quantity'), ('\"2001\"^^<http://www.w3.org/2001/XMLSchema#gYear>', 'time'), ('\"x\"@en', 'string'), ('x', NULL)) v(c, kind)")
def _b29(spark, sf_dir):
    xsd = "http://www.w3.org/2001/XMLSchema#"
    rows = spark.createDataFrame([(c,) for c in ("m.0abc", "people.person", f'"3"^^<{xsd}integer>', f'"2001"^^<{xsd}gYear>', '"x"@en', "x")], "c string")
    return rows.select("c", words.constant_kind(F.col("c")).alias("kind"))


@query("j8_expand_time", "SELECT * FROM (VALUES ('2012', '2012,2012-01-01,2012-12-31'), ('2012-02', '2012-02,2012-02-01,2012-02-29'), ('PRESENT_REF', '2015-08-10'), ('2001-02-03', '2001-02-03'), ('2001-02-03T10', '2001-02-03T10Z'), ('P3D', '')) v(t, v)")
def _j8(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in ("2012", "2012-02", "PRESENT_REF", "2001-02-03", "2001-02-03T10", "P3D")], "t string")
    return rows.select("t", F.array_join(words.expand_time(F.col("t")), ",").alias("v"))


@query("j10_numeral_triggers", "SELECT * FROM (VALUES (0, 'COUNT'), (1, 'ARG'), (2, 'COMPARE'), (3, ''), (4, 'ARG')) v(i, triggers)")
def _j10(spark, sf_dir):
    qs = ["How many orders are there?", "Which part has the maximum price?", "Which parts cost more than 5?", "Who placed the order?", "Which is the oldest nation?"]
    rows = spark.createDataFrame(list(enumerate(qs)), "i int, q string")
    return rows.select("i", F.array_join(words.numeral_triggers(F.col("q")), ",").alias("triggers"))


@query("j12_hops", "SELECT * FROM (VALUES (0, 3), (1, 1)) v(i, hops)")
def _j12(spark, sf_dir):
    rows = spark.createDataFrame([(0, "SELECT ?x { ?x p:P1 ?s . ?s ps:P1 ?y FILTER(?y > 1) }"), (1, "SELECT ?x { ?x wdt:P2 ?y }")], "i int, q string")
    return rows.select("i", words.hops(F.col("q")).cast("int").alias("hops"))


@query("j16_mean_pooled", "SELECT label, round(sum(v), 5) AS total FROM (SELECT label, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2)) GROUP BY 1")
def _j16(spark, sf_dir):
    g = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    pooled = similarity.mean_pooled(F.col("v.embedding"))
    return g.select("label", F.round(F.aggregate(pooled, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# ---- K: equivalence
_GOLD = "SELECT DISTINCT ?c WHERE { ?c :of_nation <kg:nation/3> ; :mktsegment \"BUILDING\" }"
_MADE = "SELECT DISTINCT ?c WHERE { ?c :of_nation <kg:nation/3> ; :mktsegment \"BUILDING\" ; :acctbal ?b FILTER(?b > 0) }"
_K1 = "WITH j AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) / count(*)::DOUBLE AS j FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)"


@query("k1_tss_m1", f"{_K1} SELECT round(avg(j), 9) AS score, count(*) AS suite_size FROM j")
def _k1(spark, sf_dir):
    return equivalence.test_suite_score(engine(spark, sf_dir), _GOLD, _MADE, [A.Iri("kg:nation/3")]).withColumn("score", F.round("score", 9))


@query("k1_tss_count", "WITH a AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS g, count(DISTINCT c_custkey) FILTER (c_acctbal > 0) AS c FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) SELECT round(avg(CASE WHEN g = c THEN 1.0 ELSE 0.0 END), 9) AS score, count(*) AS suite_size FROM a")
def _k1c(spark, sf_dir):
    g = "SELECT (COUNT(DISTINCT ?c) AS ?n) WHERE { ?c :of_nation <kg:nation/3> ; :mktsegment \"BUILDING\" }"
    c = "SELECT (COUNT(DISTINCT ?c) AS ?n) WHERE { ?c :of_nation <kg:nation/3> ; :mktsegment \"BUILDING\" ; :acctbal ?b FILTER(?b > 0) }"
    return equivalence.test_suite_score(engine(spark, sf_dir), g, c, [A.Iri("kg:nation/3")]).withColumn("score", F.round("score", 9))


@query("k1_tss_arg", "WITH o AS (SELECT o_custkey AS k, o_orderkey AS o, o_totalprice AS t, o_orderdate AS d FROM orders), a AS (SELECT k, arg_min(o, (-t, 'kg:order/' || o)) AS g, arg_min(o, (-epoch(d), 'kg:order/' || o)) AS c FROM o GROUP BY 1) SELECT round(avg(CASE WHEN g = c THEN 1.0 ELSE 0.0 END), 9) AS score, count(*) AS suite_size FROM a")
def _k1a(spark, sf_dir):
    g = "SELECT ?o WHERE { ?o :placed_by <kg:customer/1> ; :totalprice ?t } ORDER BY DESC(?t) LIMIT 1"
    c = "SELECT ?o WHERE { ?o :placed_by <kg:customer/1> ; :orderdate ?t } ORDER BY DESC(?t) LIMIT 1"
    return equivalence.test_suite_score(engine(spark, sf_dir), g, c, [A.Iri("kg:customer/1")]).withColumn("score", F.round("score", 9))


@query("k4_tss_m2", f"{_K1} SELECT round((SELECT count(*) FILTER (j > 0) / count(*)::DOUBLE FROM j), 9) AS s1, round((SELECT avg(j) FROM j WHERE j > 0), 9) AS s2")
def _k4(spark, sf_dir):
    return equivalence.two_part_score(engine(spark, sf_dir), _GOLD, _MADE, [A.Iri("kg:nation/3")]).select(F.round("s1", 9).alias("s1"), F.round("s2", 9).alias("s2"))


@query("k6_tss_m3", f"{_K1} SELECT round(avg(CASE WHEN j > 0 THEN 1.0 ELSE 0.0 END), 9) AS precision, round(avg(j), 9) AS recall, count(*) AS cases FROM j")
def _k6(spark, sf_dir):
    e, c = engine(spark, sf_dir), A.Iri("kg:nation/3")
    suite = equivalence.build_suite(e, _GOLD, [c])
    return equivalence.suite_scores(e, _MADE, suite, {c: "replace0"}).select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "cases")


@query("k7_suite", "SELECT 'kg:nation/' || c_nationkey AS replace0, array_to_string(list_sort(list(DISTINCT 'kg:customer/' || c_custkey)), ',') AS answers, c_nationkey = 3 AS original FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey")
def _k7(spark, sf_dir):
    return equivalence.build_suite(engine(spark, sf_dir), _GOLD, [A.Iri("kg:nation/3")]).select("replace0", F.array_join(F.array_sort("answers"), ",").alias("answers"), "original")


_PAIRS = [
    (0, "SELECT ?x { ?x :a <kg:e/1> }", "SELECT ?y { ?y :a <kg:e/1> }"),
    (1, "SELECT ?x { ?x :a <kg:e/1> . ?x :b ?z }", "SELECT ?x { ?x :a <kg:e/1> }"),
    (2, "SELECT ?x { ?x :a <kg:e/1> }", "SELECT ?x { <kg:e/1> :a ?x }"),
    (3, "SELECT ?x { ?x :a <kg:e/1> }", "not a query"),
]


def _pairs(spark):
    return spark.createDataFrame(_PAIRS, "i int, g string, c string")


@query("k9_ted", "SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 1 / 3.0::DOUBLE), (2, 0.25), (3, 1.0)) v(i, ted)")
def _k9(spark, sf_dir):
    return _pairs(spark).select("i", editdist.tree_distance_column(F.col("g"), F.col("c")).alias("ted"))


@query("k11_ged", "SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.4), (2, 2 / 3.0::DOUBLE), (3, 1.0)) v(i, ged)")
def _k11(spark, sf_dir):
    return _pairs(spark).select("i", editdist.graph_distance_column(F.col("g"), F.col("c")).alias("ged"))


@query("k13_exact_match", "SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, false)) v(i, em)")
def _k13(spark, sf_dir):
    return _pairs(spark).select("i", editdist.exact_match_column(F.col("g"), F.col("c")).alias("em"))


@query("k15_per_gold_mean", "SELECT round(avg(coalesce(s, 1.0)), 9) AS mean, count(*) - count(s) AS n_missing FROM documents LEFT JOIN (SELECT doc_id, min(quality / 2.0) AS s FROM labels GROUP BY 1) USING (doc_id)")
def _k15(spark, sf_dir):
    scores = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") / 2.0).alias("s"))
    return reports.per_gold_mean(scores, table(spark, sf_dir, "documents"), "doc_id", "s", 1.0).withColumn("mean", F.round("mean", 9))


_ANSWERS = "(SELECT user_id, user_id % 3 AS parse, coalesce(list(event_type) FILTER (value > 20), []) AS p, coalesce(list(event_type) FILTER (value < 40), []) AS g FROM events GROUP BY 1, 2)"


@query("k17_set_accuracy", f"SELECT round(avg(CASE WHEN list_sort(list_distinct(p)) = list_sort(list_distinct(g)) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM {_ANSWERS}")
def _k17(spark, sf_dir):
    none = F.expr("array()").cast("array<string>")
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.collect_list(F.when(F.col("value") > 20, F.col("event_type"))), none).alias("p"), F.coalesce(F.collect_list(F.when(F.col("value") < 40, F.col("event_type"))), none).alias("g"))
    return reports.set_accuracy(a, "p", "g").select(F.round("accuracy", 9).alias("accuracy"))


# ---- M: logical forms
@query("m3_sexpr", "SELECT DISTINCT 'kg:part/' || l_partkey AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 1 AND p_size <= 20")
def _m3(spark, sf_dir):
    return engine(spark, sf_dir).sparql(sexpr.to_query("(AND (JOIN (R of_part) (JOIN of_supplier supplier/1)) (LE size 20))"))


@query("m3_sexpr_count", "SELECT count(DISTINCT o_orderkey) AS n FROM orders WHERE o_custkey = 1")
def _m3c(spark, sf_dir):
    return engine(spark, sf_dir).sparql(sexpr.to_query("(COUNT (JOIN placed_by customer/1))")).toDF("n")


@query("m3_sexpr_arg", "SELECT 'kg:order/' || o_orderkey AS x FROM orders WHERE o_custkey = 1 ORDER BY o_totalprice DESC LIMIT 1")
def _m3a(spark, sf_dir):
    return engine(spark, sf_dir).sparql(sexpr.to_query("(ARGMAX (JOIN placed_by customer/1) totalprice)"))


@query("m12_query_graph", "SELECT DISTINCT 'kg:customer/' || c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_acctbal > 1000")
def _m12(spark, sf_dir):
    g = querygraph.QueryGraph("x", [("of_nation", "x", "n"), ("in_region", "n", "kg:region/2")], types={"x": ["customer"]}, comparisons=[("acctbal", "x", ">", "1000")])
    return engine(spark, sf_dir).sparql(g.to_query())


@query("m13_pr_pair", "SELECT count(DISTINCT c_custkey) AS n_pred, count(DISTINCT c_custkey) FILTER (c_mktsegment = 'BUILDING') AS n_hit FROM customer WHERE c_nationkey = 3")
def _m13(spark, sf_dir):
    e = engine(spark, sf_dir)
    g = querygraph.QueryGraph("x", [("of_nation", "x", "kg:nation/3")], types={"x": ["customer"]})
    return synthesis.hits(e, {0: g}, e.sparql("SELECT ?c WHERE { ?c :mktsegment \"BUILDING\" }").toDF("answer")).select("n_pred", "n_hit")


# ---- N: exploration, with every node of a class as anchor
def _every(spark, sf_dir, name, key, cls=None):
    return table(spark, sf_dir, name).select(F.concat(F.lit(f"kg:{cls or name}/"), F.col(key).cast("string")).alias("node"))


def _customers(spark, sf_dir):
    return _every(spark, sf_dir, "customer", "c_custkey")


def _suppliers(spark, sf_dir):
    return _every(spark, sf_dir, "supplier", "s_suppkey")


def _nations(spark, sf_dir):
    return _every(spark, sf_dir, "nation", "n_nationkey")


def _orders(spark, sf_dir):
    return _every(spark, sf_dir, "orders", "o_orderkey", "order")


_VALUES_OF_LINE = "['quantity', 'extendedprice', 'discount', 'tax', 'shipdate', 'returnflag', 'linestatus']"


@query("n2_classes", "SELECT 'kg:customer/' || c_custkey AS node, 'customer' AS cls FROM customer UNION ALL SELECT 'kg:order/' || o_orderkey, 'order' FROM orders")
def _n2(spark, sf_dir):
    return explore.classes_of(sales_graph(spark, sf_dir), _customers(spark, sf_dir).unionByName(_orders(spark, sf_dir)))


@query("n3_friendly_name", "SELECT 'kg:supplier/' || s_suppkey AS node, s_name AS label FROM supplier UNION ALL SELECT 'kg:order/' || o_orderkey, o_orderpriority FROM orders")
def _n3(spark, sf_dir):
    return explore.labels(sales_graph(spark, sf_dir), _suppliers(spark, sf_dir).unionByName(_orders(spark, sf_dir)), fallback="orderpriority")


@query("n6_meets", "SELECT 'lineitem' AS cls FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL HAVING count(*) > 0")
def _n6(spark, sf_dir):
    return explore.meets(sales_graph(spark, sf_dir), "of_part", "of_supplier")


@query("n7_third_relations", f"SELECT 'S' AS side, unnest(['of_order', 'of_part', 'of_supplier'] || {_VALUES_OF_LINE}) AS relation")
def _n7(spark, sf_dir):
    return explore.third_relations(sales_graph(spark, sf_dir), "of_part", "of_supplier", "S-S")


@query("n9_expand", """SELECT unnest(['name', 'acctbal', 'mktsegment', 'of_nation']) AS relation, count(*) AS n_anchors, count(*) AS n_pairs FROM customer
UNION ALL SELECT '^placed_by', count(DISTINCT o_custkey), count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) HAVING count(*) > 0
UNION ALL SELECT '^by_user', count(DISTINCT user_id), count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer) HAVING count(*) > 0""")
def _n9(spark, sf_dir):
    return explore.next_relations(sales_graph(spark, sf_dir), _customers(spark, sf_dir))


_OVER_LINES = f"""WITH l AS (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier))
SELECT '^of_supplier/' || p AS relation, count(DISTINCT l_suppkey)::BIGINT AS n_anchors, count(*) AS n_pairs FROM l, (SELECT unnest(['of_order', 'of_part'] || {_VALUES_OF_LINE}) AS p) GROUP BY 1"""


@query("n9_expand_cvt", _OVER_LINES)
def _n9c(spark, sf_dir):
    return explore.next_relations(sales_graph(spark, sf_dir), _suppliers(spark, sf_dir)).filter("contains(relation, '/')")


@query("n10_neighbors", "SELECT DISTINCT 'kg:customer/' || c_custkey AS anchor, 'kg:nation/' || n_nationkey AS item, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _n10(spark, sf_dir):
    return explore.next_items(sales_graph(spark, sf_dir), _customers(spark, sf_dir), "of_nation", with_label=True)


@query("n10_neighbors_cvt", "SELECT DISTINCT 'kg:supplier/' || l_suppkey AS anchor, 'kg:part/' || l_partkey AS item FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)")
def _n10c(spark, sf_dir):
    return explore.next_items(sales_graph(spark, sf_dir), _suppliers(spark, sf_dir), "^of_supplier/of_part")


@query("n11_two_phase", _OVER_LINES)
def _n11(spark, sf_dir):
    """Of the first hops from orders, parts and suppliers one is blacklisted, and of the others the more similar stays."""
    g = sales_graph(spark, sf_dir)
    anchors = _orders(spark, sf_dir).unionByName(_suppliers(spark, sf_dir)).unionByName(_every(spark, sf_dir, "part", "p_partkey"))
    similarity_ = spark.createDataFrame([("of_part", 0.2), ("of_supplier", 0.7), ("of_order", 0.9)], "relation string, similarity double")
    return explore.two_phase_relations(g, anchors, ("order",), 1, similarity_)


@query("n12_properties", "SELECT * FROM (VALUES ('orderdate', 'ts'), ('shipdate', 'ts'), ('at', 'ts')) v(predicate, \"range\")")
def _n12(spark, sf_dir):
    return explore.properties_of_type(sales_graph(spark, sf_dir), ["ts"])


@query("n13_coexists", "SELECT 'of_part' AS main, 'returnflag' AS qualifier, count(*) > 0 AS existence FROM lineitem WHERE l_partkey IS NOT NULL AND l_returnflag IS NOT NULL UNION ALL SELECT 'of_part', 'placed_by', false")
def _n13(spark, sf_dir):
    g = sales_graph(spark, sf_dir)
    return explore.coexists(g, "of_part", "returnflag").unionByName(explore.coexists(g, "of_part", "placed_by"))


@query("n14_literal_paths", "SELECT DISTINCT 'acctbal' AS relation, unnest(CASE WHEN c_acctbal > 1000 THEN ['GE', 'GT'] WHEN c_acctbal < 1000 THEN ['LE', 'LT'] ELSE ['GE', 'EQ', 'LE'] END) AS comparator FROM customer")
def _n14(spark, sf_dir):
    return explore.paths_to_literal(sales_graph(spark, sf_dir), _customers(spark, sf_dir), '"1000.0"')


@query("n15_reversed_paths", "SELECT 'kg:nation/' || c_nationkey AS anchor, '^of_nation' AS relation FROM customer WHERE c_custkey = 1")
def _n15(spark, sf_dir):
    return explore.paths_to_node(sales_graph(spark, sf_dir), _nations(spark, sf_dir), "kg:customer/1")


@query("n16_node_paths", "SELECT 'kg:customer/' || c_custkey AS anchor, 'of_nation' AS relation FROM customer WHERE c_nationkey = 3")
def _n16(spark, sf_dir):
    return explore.paths_to_node(sales_graph(spark, sf_dir), _customers(spark, sf_dir), "kg:nation/3")


@query("n16_relations", "SELECT 'kg:supplier/' || s_suppkey AS node, 'of_nation' AS relation, 1::BIGINT AS n FROM supplier UNION ALL SELECT 'kg:supplier/' || l_suppkey, '^of_supplier', count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY l_suppkey")
def _n16r(spark, sf_dir):
    return explore.paths_from_nodes(sales_graph(spark, sf_dir), _suppliers(spark, sf_dir))


@query("n17_arg_relations", """SELECT 'acctbal' AS relation, 'QUANTITY' AS special, count(*) AS n_anchors FROM supplier
UNION ALL SELECT '^of_supplier/' || p, CASE WHEN p = 'shipdate' THEN 'TEMPORAL' ELSE 'QUANTITY' END, count(DISTINCT l_suppkey) FROM lineitem, (SELECT unnest(['quantity', 'extendedprice', 'discount', 'tax', 'shipdate']) AS p) WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY p""")
def _n17(spark, sf_dir):
    return explore.arg_relations(sales_graph(spark, sf_dir), _suppliers(spark, sf_dir))


_LEAST_LINE = "(SELECT arg_min(l_orderkey, (l_orderkey, l_partkey, l_suppkey)) AS o, arg_min(l_partkey, (l_orderkey, l_partkey, l_suppkey)) AS p, arg_min(l_suppkey, (l_orderkey, l_partkey, l_suppkey)) AS s FROM lineitem)"


def _least_line(spark, sf_dir):
    """The part, supplier and order of one line, as a table of one row."""
    least = table(spark, sf_dir, "lineitem").agg(F.min(F.struct("l_orderkey", "l_partkey", "l_suppkey")).alias("l"))
    iri = lambda cls, c: F.concat(F.lit(f"kg:{cls}/"), F.col(f"l.{c}").cast("string"))
    return least.select(iri("part", "l_partkey").alias("a"), iri("supplier", "l_suppkey").alias("b"), iri("order", "l_orderkey").alias("c"))


@query("n18_statement_triples", f"SELECT 'of_part' AS p0, 'of_supplier' AS p1, 'of_order' AS p2, count(*) AS n FROM lineitem, {_LEAST_LINE} WHERE l_partkey = p AND l_suppkey = s AND l_orderkey = o")
def _n18(spark, sf_dir):
    return explore.statement_patterns(sales_graph(spark, sf_dir), "lineitem", _least_line(spark, sf_dir))


@query("n19_statement_patterns", f"SELECT 'of_part' AS p0, 'of_supplier' AS p1, count(*) AS n FROM lineitem, {_LEAST_LINE} WHERE l_partkey = p AND l_suppkey = s")
def _n19(spark, sf_dir):
    return explore.statement_patterns(sales_graph(spark, sf_dir), "lineitem", _least_line(spark, sf_dir).select("a", "b"))


@query("n20_statement_steps", f"""WITH o AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)), s AS (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier))
SELECT 'nn' AS way, 'p:of_part/' || CASE WHEN q = 'of_part' THEN 'ps:' ELSE 'pq:' END || q AS relation, count(DISTINCT l_orderkey) AS n_anchors FROM o, (SELECT unnest(['of_part', 'of_supplier'] || {_VALUES_OF_LINE}) AS q) GROUP BY q
UNION ALL SELECT 'rn', '^pq:of_supplier/' || CASE WHEN q = 'of_part' THEN 'ps:' ELSE 'pq:' END || q, count(DISTINCT l_suppkey) FROM s, (SELECT unnest(['of_part'] || {_VALUES_OF_LINE}) AS q) GROUP BY q
UNION ALL SELECT 'rr', '^pq:of_supplier/^p:of_part', count(DISTINCT l_suppkey) FROM s HAVING count(*) > 0""")
def _n20(spark, sf_dir):
    return explore.statement_steps(sales_graph(spark, sf_dir), _orders(spark, sf_dir).unionByName(_suppliers(spark, sf_dir)), "lineitem", "of_order", "of_part")


@query("n20_direct_steps", """SELECT 'nn' AS way, unnest(['p:name/ps:name', 'p:in_region/ps:in_region']) AS relation, count(*) AS n_anchors FROM nation
UNION ALL SELECT 'rr', '^ps:of_nation/^p:of_nation', count(DISTINCT n)::BIGINT FROM (SELECT c_nationkey AS n FROM customer) HAVING count(*) > 0""")
def _n20d(spark, sf_dir):
    """Nations are in no statement, so their own edges stand in; those of customers alone lead back to them here."""
    g = sales_graph(spark, sf_dir)
    g.edges = [e for e in g.edges if not (e.cls == "supplier" and e.predicate == "of_nation")]
    return explore.statement_steps(g, _nations(spark, sf_dir), "lineitem", "of_order", "of_part")


# ---- O: synthesis
@query("o10_comparison_candidates", "SELECT p AS relation, c AS comparator, v AS literal FROM (SELECT unnest(['acctbal', 'size']) AS p), (SELECT unnest(['>=', '>', '<=', '<']) AS c), (SELECT unnest(['5', '10']) AS v)")
def _o10(spark, sf_dir):
    rel = spark.createDataFrame([("acctbal",), ("size",)], "relation string")
    lit = spark.createDataFrame([("5",), ("10",)], "literal string")
    return synthesis.comparison_candidates(rel, lit)


@query("o15_candidate_scores", """WITH c AS (SELECT count(*) FILTER (c_nationkey = 3 AND c_mktsegment = 'BUILDING') AS a, count(*) FILTER (c_nationkey = 3) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS m FROM customer),
  g AS (SELECT 'SELECT DISTINCT ?v0 WHERE { ?v0 kg:mktsegment "BUILDING" . ?v0 kg:of_nation <kg:nation/3> . ?v0 rdf:type kg:customer . }' AS query, 2 AS size, 1.0::DOUBLE AS p FROM c
    UNION ALL SELECT 'SELECT DISTINCT ?v0 WHERE { ?v0 kg:of_nation <kg:nation/3> . ?v0 rdf:type kg:customer . }', 1, a / n::DOUBLE FROM c
    UNION ALL SELECT 'SELECT DISTINCT ?v0 WHERE { ?v0 kg:mktsegment "BUILDING" . ?v0 rdf:type kg:customer . }', 1, a / m::DOUBLE FROM c)
SELECT query, size, round(p, 9) AS precision, 1.0::DOUBLE AS recall, round(2 * p / (p + 1), 9) AS f1 FROM g, c WHERE a > 0""")
def _o15(spark, sf_dir):
    e = engine(spark, sf_dir)
    answers = e.sparql("SELECT ?c WHERE { ?c :of_nation <kg:nation/3> ; :mktsegment \"BUILDING\" }").toDF("answer")
    found = synthesis.search(e, answers, ["kg:nation/3", '"BUILDING"'])
    return found.select("query", "size", F.round("precision", 9).alias("precision"), "recall", F.round("f1", 9).alias("f1"))


# ---- P: forms
sparql("p2_construct", "CONSTRUCT { ?n :contains ?c } WHERE { ?c :of_nation ?n ; a :supplier }", "SELECT DISTINCT 'kg:nation/' || s_nationkey AS subject, 'kg:contains' AS predicate, 'kg:supplier/' || s_suppkey AS object FROM supplier")
sparql("p3_ask", "ASK { ?c :acctbal ?b FILTER(?b < -1000000) }", "SELECT 0 AS answer")
sparql("p3_ask_true", "ASK { ?c :mktsegment \"BUILDING\" }", "SELECT 1 AS answer")
sparql("p4_describe", "DESCRIBE <kg:nation/4>", "SELECT 'kg:nation/4' AS subject, 'kg:name' AS predicate, n_name AS object FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'kg:nation/4', 'kg:in_region', 'kg:region/' || n_regionkey FROM nation WHERE n_nationkey = 4")

# ---- further cases, one for each remaining construct
sparql("b19_from", "SELECT ?n FROM <kg:graph> WHERE { ?n a :region }", "SELECT 'kg:region/' || r_regionkey AS n FROM region")
sparql("b24_named_or_numeric", "SELECT ?p WHERE { <kg:order/1> ?p ?o FILTER(EXISTS { ?o :name ?n } || ISNUMERIC(?o)) }", "SELECT unnest(['kg:placed_by', 'kg:totalprice']) AS p")
sparql("b27_blacklist", "SELECT DISTINCT ?p WHERE { <kg:customer/1> ?p ?o FILTER(!CONTAINS(STR(?p), \"acct\")) }", "SELECT unnest(['kg:name', 'kg:mktsegment', 'kg:of_nation']) AS p")
sparql("c14_disequality", "SELECT DISTINCT ?a ?b WHERE { ?l :of_order <kg:order/1> ; :of_part ?a . ?m :of_order <kg:order/1> ; :of_part ?b . FILTER(?a != ?b) }", "SELECT DISTINCT 'kg:part/' || x.l_partkey AS a, 'kg:part/' || y.l_partkey AS b FROM lineitem x, lineitem y WHERE x.l_orderkey = 1 AND y.l_orderkey = 1 AND x.l_partkey <> y.l_partkey")
sparql("c17_left_join_by_key", "SELECT ?d ?q ?t WHERE { ?d :language \"es\" OPTIONAL { ?d :quality ?q ; :toxic ?t } }", "SELECT 'kg:document/' || d.doc_id AS d, quality::BIGINT AS q, toxic::BIGINT AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'es'")
sparql("d12_mean_of_scores", "SELECT (AVG(?q) AS ?m) WHERE { ?d :quality ?q }", "SELECT avg(quality) AS m FROM labels")
sparql("f5_product", "SELECT ?a ?b WHERE { ?a a :region . ?b a :region }", "SELECT 'kg:region/' || x.r_regionkey AS a, 'kg:region/' || y.r_regionkey AS b FROM region x, region y")
sparql("f6_combinations", "SELECT ?a ?b WHERE { ?a a :region ; :name ?x . ?b a :region ; :name ?y . FILTER(?x < ?y) }", "SELECT 'kg:region/' || x.r_regionkey AS a, 'kg:region/' || y.r_regionkey AS b FROM region x, region y WHERE x.r_name < y.r_name")
sparql("g5_arg_over_two_hops", "SELECT ?p WHERE { ?p ^:of_part ?l . ?l :of_supplier <kg:supplier/1> ; :extendedprice ?e } ORDER BY DESC(?e) ?p LIMIT 1", "SELECT 'kg:part/' || l_partkey AS p FROM lineitem WHERE l_suppkey = 1 ORDER BY l_extendedprice DESC, l_partkey LIMIT 1")
sparql("i5_bnode", "SELECT ?n (ISBLANK(BNODE(?l)) AS ?b) WHERE { ?n a :region ; :name ?l }", "SELECT 'kg:region/' || r_regionkey AS n, true AS b FROM region")
sparql("i12_zones", "SELECT (TZ(\"2011-01-10T14:45:13-05:00\"^^xsd:dateTime) AS ?z) (TIMEZONE(\"2011-01-10T14:45:13-05:00\"^^xsd:dateTime) AS ?t) (TIMEZONE(\"2011-01-10T14:45:13Z\"^^xsd:dateTime) AS ?u) WHERE { }", "SELECT '-05:00' AS z, '-PT5H' AS t, 'PT0S' AS u")
sparql("i29_function_call", "SELECT ?s (<http://www.w3.org/2001/XMLSchema#integer>(?b) AS ?k) WHERE { ?s :acctbal ?b ; a :supplier }", "SELECT 'kg:supplier/' || s_suppkey AS s, trunc(s_acctbal)::BIGINT AS k FROM supplier")


@query("a12_formats", "SELECT * FROM (VALUES ('1', 0, 'a'), ('1', 1, 'b'), ('2', 0, 'c'), ('3', 0, 'd'), ('4', 0, 'e')) v(qid, position, sparql)")
def _a12(spark, sf_dir):
    """Result files of the three forms, and of both names of their list."""
    texts = [
        '{"results": [{"qid": "1", "search_results": [{"sparql": "a"}, {"sparql": "b"}]}, {"qid": "2", "searched_queries": [{"sparql": "c"}]}]}',
        '{"3": {"qid": "3", "search_results": [{"sparql": "d"}]}}', '[{"qid": "4", "search_results": [{"sparql": "e"}]}]',
    ]
    return files.parse_results(spark.createDataFrame([(t,) for t in texts], "value string")).select("qid", "position", "sparql")


@query("b26_answer_substituted", "SELECT (count(*) > 0)::INT AS answer FROM customer WHERE c_custkey = 1 AND c_nationkey = 3 UNION ALL SELECT (count(*) > 0)::INT FROM customer WHERE c_custkey = 1 AND c_nationkey IN (SELECT n_nationkey FROM nation)")
def _b26(spark, sf_dir):
    e = engine(spark, sf_dir)
    graphs = [querygraph.QueryGraph("x", [("of_nation", "x", "kg:nation/3")]), querygraph.QueryGraph("x", [("of_nation", "x", "n"), ("name", "n", "label")])]
    first, second = (e.sparql(g.with_answer("kg:customer/1")) for g in graphs)
    return first.unionByName(second)


@query("b31_valid_annotations", "SELECT event_id, user_id FROM events WHERE event_type <> 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def _b31(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 97 == 0, 9999.0).otherwise(F.col("value")).alias("seconds"), (F.col("event_type") != "view").alias("ok"))
    return reports.valid_annotations(rows, "user_id", "seconds", "ok").select("event_id", "user_id")


@query("c18_attached_graphs", "SELECT DISTINCT 'kg:customer/' || c_custkey AS x FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderpriority = '1-URGENT'")
def _c18(spark, sf_dir):
    a = querygraph.QueryGraph("x", [("of_nation", "x", "kg:nation/3")], types={"x": ["customer"]})
    b = querygraph.QueryGraph("y", [("placed_by", "o", "y"), ("orderpriority", "o", '"1-URGENT"')])
    return engine(spark, sf_dir).sparql(a.attach(b).to_query())


@query("e10_pruned_inverses", "SELECT unnest(['a/c', '^b/a', 'd']) AS relation")
def _e10(spark, sf_dir):
    return explore.without_round_trips(spark.createDataFrame([("a/^a",), ("a/c",), ("^b/a",), ("^b/b",), ("d",)], "relation string"))


@query("g12_first_answers", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def _g12(spark, sf_dir):
    return reports.first_of_each(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 3)


@query("g13_seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':374'), c_custkey LIMIT 50")
def _g13(spark, sf_dir):
    return reports.seeded_sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 50, equivalence.SEED)


@query("j6_rendered_constants", "SELECT * FROM (VALUES ('uri', 'm.01', 'm.01'), ('typed-literal', '5', '\"5\"^^<t>'), ('literal', 'x', '\"x\"@en')) v(kind, value, shown)")
def _j6(spark, sf_dir):
    rows = spark.createDataFrame([("uri", "m.01", None, None), ("typed-literal", "5", "t", None), ("literal", "x", None, "en")], "kind string, value string, dt string, lang string")
    return rows.select("kind", "value", words.render(F.col("kind"), F.col("value"), F.col("dt"), F.col("lang")).alias("shown"))


@query("j7_word_ngrams", "SELECT n_nationkey AS k, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS g FROM (SELECT n_nationkey, string_split(lower(n_name) || '_of_the_earth', '_') AS w FROM nation)")
def _j7(spark, sf_dir):
    w = words.tokens(F.concat(F.col("n_name"), F.lit("_of_the_earth")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.array_join(words.word_ngrams(w, 2), "|").alias("g"))


@query("j13_direct_paths", "SELECT 'SELECT ?x { ?x wdt:P31 ?y . ?x p:P5/ps:P6 ?z }' AS q")
def _j13(spark, sf_dir):
    return spark.createDataFrame([("SELECT ?x { ?x p:P31/ps:P31 ?y . ?x p:P5/ps:P6 ?z }",)], "q string").select(words.direct_form(F.col("q")).alias("q"))


@query("j15_matched_texts", "SELECT * FROM (VALUES (1, 10), (2, 20)) v(a, b)")
def _j15(spark, sf_dir):
    left = spark.createDataFrame([(1, "SELECT  ?x\n{ ?x :p 1 }"), (2, "ASK{?x :q 2}")], "a int, t string")
    right = spark.createDataFrame([(10, "SELECT ?x { ?x :p 1 }"), (20, "ASK { ?x :q 2 }")], "b int, t string")
    return reports.match_texts(left, right, "a", "b", "t")


@query("k5_reground", "SELECT DISTINCT 'kg:nation/' || c_nationkey AS v FROM customer WHERE c_mktsegment = 'BUILDING'")
def _k5(spark, sf_dir):
    n = A.Iri("kg:nation/3")
    return equivalence.regrounded(engine(spark, sf_dir), equivalence._read(_GOLD), {n: "replace0"})[n]


def rewritten(key: str, text: str, rewrite: Callable[[A.Query], A.Query], sql: str) -> None:
    """A query that runs after a rewrite must answer as its SQL."""
    QUERIES[key] = lambda spark, sf_dir: engine(spark, sf_dir).sparql(rewrite(parse(text)))
    SQL[key] = sql


rewritten("l7_unwrap", "SELECT (COUNT(?c) AS ?n) WHERE { SELECT DISTINCT ?c WHERE { ?o :placed_by ?c } }", rewrites.unwrap, "SELECT count(DISTINCT o_custkey) AS n FROM orders")
rewritten("l8_drop_filters", "SELECT ?n WHERE { ?x :in_region ?r ; :name ?n FILTER(?n != \"noise\") }", lambda q: rewrites.drop_filters(q, ["noise"]), "SELECT n_name AS n FROM nation")
rewritten("l11_superlative", "SELECT ?p WHERE { ?p :retailprice ?r { SELECT (MAX(?x) AS ?m) WHERE { ?y :retailprice ?x } } FILTER(?r = ?m) }", lambda q: rewrites.superlative(q).with_(projection=(A.Projected(A.Var("r"), A.Var("r")),)), "SELECT max(p_retailprice) AS r FROM part")
rewritten("l12_limit", "SELECT ?n WHERE { ?n a :nation } ORDER BY ?n LIMIT 5", lambda q: rewrites.set_limit(q, 5, 1), "SELECT 'kg:nation/0' AS n")
rewritten("l13_inline_values", "SELECT ?c WHERE { VALUES ?n { <kg:nation/3> } ?c :of_nation ?n ; :mktsegment ?m }", rewrites.inline_values, "SELECT 'kg:customer/' || c_custkey AS c FROM customer WHERE c_nationkey = 3")
rewritten("l14_inline_filter", "SELECT ?c WHERE { ?c :of_nation ?n ; :mktsegment ?m FILTER(?m = \"BUILDING\") }", rewrites.inline_equal, "SELECT 'kg:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
rewritten("l15_time_literals", "SELECT ?o WHERE { ?o :orderdate ?d FILTER(?d >= \"2000\"^^xsd:gYear) }", rewrites.expand_times, "SELECT 'kg:order/' || o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
rewritten("l16_force_distinct", "SELECT ?n WHERE { ?p :brand ?b ; :name ?n }", rewrites.force_distinct, "SELECT DISTINCT p_name AS n FROM part")
rewritten("l18_canonical", "SELECT ?c WHERE { ?n :has_customer ?c . ?n :in_region <kg:region/1> }", lambda q: rewrites.canonical(q, {"kg:of_nation": "kg:has_customer"}).with_(projection=(A.Projected(A.Agg("COUNT", None), A.Var("n")),)), "SELECT count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey WHERE n_regionkey = 1")


_CATALOG = """(VALUES
  ('name', 'region', 'str'), ('name', 'nation', 'str'), ('in_region', 'nation', 'region'), ('name', 'customer', 'str'), ('acctbal', 'customer', 'dbl'), ('mktsegment', 'customer', 'str'),
  ('of_nation', 'customer', 'nation'), ('name', 'supplier', 'str'), ('acctbal', 'supplier', 'dbl'), ('of_nation', 'supplier', 'nation'), ('name', 'part', 'str'), ('brand', 'part', 'str'),
  ('type', 'part', 'str'), ('size', 'part', 'int'), ('retailprice', 'part', 'dbl'), ('placed_by', 'order', 'customer'), ('status', 'order', 'str'), ('totalprice', 'order', 'dbl'),
  ('orderdate', 'order', 'ts'), ('orderpriority', 'order', 'str'), ('of_order', 'lineitem', 'order'), ('of_part', 'lineitem', 'part'), ('of_supplier', 'lineitem', 'supplier'), ('quantity', 'lineitem', 'dbl'),
  ('extendedprice', 'lineitem', 'dbl'), ('discount', 'lineitem', 'dbl'), ('tax', 'lineitem', 'dbl'), ('shipdate', 'lineitem', 'ts'), ('returnflag', 'lineitem', 'str'), ('linestatus', 'lineitem', 'str'),
  ('by_user', 'event', 'customer'), ('at', 'event', 'ts'), ('event_type', 'event', 'str'), ('value', 'event', 'dbl'), ('language', 'document', 'str'), ('source', 'document', 'str'),
  ('n_chars', 'document', 'int'), ('text', 'document', 'lang'), ('quality', 'document', 'int'), ('toxic', 'document', 'int'), ('in_conversation', 'turn', 'conversation'), ('turn_no', 'turn', 'int'),
  ('role', 'turn', 'str'), ('said', 'turn', 'str'), ('url', 'page', 'str'), ('text', 'item', 'str')) v(predicate, domain, "range")"""


@query("n1_domains", f"SELECT * FROM {_CATALOG}")
def _n1(spark, sf_dir):
    return explore.domains(sales_graph(spark, sf_dir))


@query("n5_nary_relations", "SELECT unnest(['of_order', 'of_part', 'of_supplier']) AS predicate")
def _n5(spark, sf_dir):
    g = sales_graph(spark, sf_dir)
    return g.catalog().filter(F.col("domain").isin(*explore.intermediate(g)) & F.col("is_object")).select("predicate").distinct()


@query("n21_special_types", f"SELECT DISTINCT predicate, CASE WHEN \"range\" = 'ts' THEN 'TEMPORAL' WHEN \"range\" IN ('int', 'dbl') THEN 'QUANTITY' ELSE 'NORMAL' END AS special FROM {_CATALOG}")
def _n21(spark, sf_dir):
    return explore.special_type(sales_graph(spark, sf_dir))


# ---- A: results in the shapes of an endpoint
@query("a5_bindings", "SELECT 'kg:nation/' || n_nationkey AS n, 'uri' AS n_type, n_name AS label, 'literal' AS label_type, n_nationkey + 1 AS next, 'http://www.w3.org/2001/XMLSchema#integer' AS next_datatype FROM nation")
def _a5(spark, sf_dir):
    rows = access.bindings(engine(spark, sf_dir), "SELECT ?n ?label (xsd:integer(REPLACE(STR(?n), \"kg:nation/\", \"\")) + 1 AS ?next) WHERE { ?n :in_region ?r ; :name ?label }")
    return rows.select(F.col("n.value").alias("n"), F.col("n.type").alias("n_type"), F.col("label.value").alias("label"), F.col("label.type").alias("label_type"), F.col("next.value").cast("int").alias("next"), F.col("next.datatype").alias("next_datatype"))


@query("a4_ask_tuple", "SELECT 1 AS answer UNION ALL SELECT 0")
def _a4(spark, sf_dir):
    e = engine(spark, sf_dir)
    return access.tuples(e, "ASK { ?x a :nation }").unionByName(access.tuples(e, "ASK { ?x :in_region <kg:region/99> }"))


@query("a6_first_that_answers", "SELECT 'kg:region/' || r_regionkey AS r FROM region")
def _a6(spark, sf_dir):
    """The first text has no meaning here, the second no answer."""
    return access.first_that_answers(engine(spark, sf_dir), "SELECT ?r WHERE { ?r ?", "SELECT ?r WHERE { ?r :in_region <kg:region/0> ; a :region }", "SELECT ?r WHERE { ?r a :region }")


@query("a7_one_variable", "SELECT 'customer/' || c_custkey AS value FROM customer WHERE c_nationkey = 3")
def _a7(spark, sf_dir):
    return access.one_variable(engine(spark, sf_dir), "SELECT ?c ?m WHERE { ?c :of_nation <kg:nation/3> ; :mktsegment ?m }")


@query("a8_typed_values", "SELECT DISTINCT '\"' || p_size || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS value FROM part")
def _a8(spark, sf_dir):
    return access.typed_values(engine(spark, sf_dir), "SELECT ?z WHERE { ?p :size ?z }")


# ---- further language cases
sparql("b9_collections", "SELECT ?x WHERE { ?x :in_region (1 2) }", "SELECT '' AS x WHERE false")
sparql("i4_iri", "SELECT ?l (IRI(CONCAT(\"kg:name/\", ?l)) AS ?i) (ISIRI(IRI(?l)) AS ?k) WHERE { ?n a :region ; :name ?l }", "SELECT r_name AS l, 'kg:name/' || r_name AS i, true AS k FROM region")


@query("p6_stand_alone_parts", "SELECT 'kg:part/' || p_partkey AS p FROM part WHERE p_size > 40 AND p_brand = 'Brand#1'")
def _p6(spark, sf_dir):
    group, test = parse_patterns("?p :size ?s ; :brand \"Brand#1\""), parse_filter("FILTER(?s > 40)")
    return engine(spark, sf_dir).sparql(A.Query("SELECT", A.Group((*group.parts, A.Filter(test))), (A.Projected(A.Var("p"), A.Var("p")),)))


@query("g7_capped", "SELECT 'kg:customer/' || c_custkey AS c FROM customer ORDER BY 'kg:customer/' || c_custkey LIMIT 100")
def _g7(spark, sf_dir):
    return engine(spark, sf_dir).sparql(rewrites.capped(parse("SELECT ?c WHERE { ?c :mktsegment ?m } ORDER BY STR(?c)"), 100))


@query("g10_argsort", "SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(1, 9), lambda i: {'s': -embedding[i], 'i': i - 1})), lambda x: x.i), ',') AS places FROM embeddings")
def _g10(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(words.argsort_similar(F.slice("embedding", 1, 8)).cast("array<string>"), ",").alias("places"))


# ---- J: text of questions and graphs
_DECOMPOSITION = '[{"description": "parts of <IQ1>", "<IQ1>": [{"description": "suppliers in <IQ2>", "<IQ2>": [{"description": "nation 3"}]}]}, {"description": "that are small"}]'


def _decomposed(spark):
    return spark.createDataFrame([("1", "Which small parts?", _DECOMPOSITION), ("2", "Which nations?", "broken")], "qid string, question string, decomposition string")


@query("j9_branches", "SELECT * FROM (VALUES ('1', 'parts of <IQ1> > suppliers in <IQ2> > nation 3'), ('1', 'that are small')) v(qid, branch)")
def _j9(spark, sf_dir):
    rows = _decomposed(spark).select("qid", F.explode(questions.branches_column(F.col("decomposition"))).alias("b"))
    return rows.select("qid", F.array_join("b", " > ").alias("branch"))


@query("j11_operator_triggers", """SELECT doc_id, concat_ws(',', CASE WHEN contains(q, 'how many') THEN 'COUNT' END, CASE WHEN contains(q, 'max') OR contains(q, ' most') THEN 'ARGMAX' END, CASE WHEN contains(q, 'earliest') THEN 'ARGMIN' END, CASE WHEN contains(q, 'at most') THEN '<=,<' END, CASE WHEN contains(q, 'at least') THEN 'ARGMIN,>=,>' END) AS triggers
FROM (SELECT doc_id, ['how many rows', 'the max', 'the earliest', 'at most 5', 'at least 5', 'nothing'][1 + doc_id % 6] AS q FROM documents)""")
def _j11(spark, sf_dir):
    phrases = F.array(*(F.lit(p) for p in ("How many rows", "the max", "the EARLIEST", "at most 5", "at least 5", "nothing")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(phrases, (F.col("doc_id") % 6).cast("int")).alias("q"))
    return rows.select("doc_id", F.concat_ws(",", words.operator_triggers(F.col("q"))).alias("triggers"))


@query("j14_mapped_ids", "SELECT 'm.0' || c_custkey AS mid, '/m/0' || c_custkey AS global, c_custkey FROM customer")
def _j14(spark, sf_dir):
    """Ids of one graph as those of another and back, joined on the other's."""
    own = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/m/0"), F.col("c_custkey").cast("string")).alias("value"))
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("m.0"), F.col("c_custkey").cast("string")).alias("mid"))
    joined = asked.withColumn("global", words.to_global_id(F.col("mid"))).join(own, F.col("global") == F.col("value"))
    return joined.select(words.from_global_id(F.col("value")).alias("mid"), "global", "c_custkey")


@query("j17_literal_values", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '^^http://www.w3.org/2001/XMLSchema#date' AS bare, strftime(o_orderdate, '%Y-%m-%d') AS value, o_orderpriority AS word FROM orders""")
def _j17(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    dated = F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('-08:00"^^<http://www.w3.org/2001/XMLSchema#date>'))
    return o.select("o_orderkey", words.bare_literal(dated).alias("bare"), words.literal_value(dated).alias("value"), words.literal_value(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"@en'))).alias("word"))


@query("j18_naturalised", "SELECT 'SELECT ?x  that has maximum totalprice, ?x is a order,  ( ?x, placed_by, the customer ), ?x has orderdate that greater than \"2000\", ' AS text")
def _j18(spark, sf_dir):
    g = querygraph.QueryGraph("x", [("placed_by", "x", "kg:customer/1")], types={"x": ["order"]}, comparisons=[("orderdate", "x", ">", '"2000"')], arg=("totalprice", "x", True))
    return spark.createDataFrame([(g.naturalised({"kg:customer/1": "the customer"}),)], "text string")


# ---- K: batches and tables
@query("k3_capped_perturbation", "SELECT least(count(*), 50) AS n FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _k3(spark, sf_dir):
    return equivalence.apply_perturbation(engine(spark, sf_dir), _GOLD, {A.Iri("kg:nation/3"): "replace0"}, 50).agg(F.count("*").alias("n"))


@query("k8_suites", """SELECT 'a' AS qid, 'kg:nation/' || c_nationkey AS v, count(DISTINCT c_custkey) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey
UNION ALL SELECT 'b', 'kg:region/' || n_regionkey, count(*) FROM nation GROUP BY n_regionkey""")
def _k8(spark, sf_dir):
    golden = [("a", _GOLD, [A.Iri("kg:nation/3")]), ("b", "SELECT ?n WHERE { ?n :in_region <kg:region/1> }", [A.Iri("kg:region/1")]), ("c", "ASK { ?x a :nation }", [A.Iri("kg:region/1")])]
    return equivalence.build_suites(engine(spark, sf_dir), golden).select("qid", F.map_values("binding")[0].alias("v"), F.size("answers").cast("long").alias("n"))


@query("k18_score_table", f"""WITH m AS (SELECT level, method, avg(score) AS s FROM {_RATED} GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (PARTITION BY level ORDER BY round(s / 0.001)) AS k FROM m),
  c AS (SELECT level, method, CASE k WHEN 1 THEN '**' || format('{{:.3f}}', s) || '**' WHEN 2 THEN '<u>' || format('{{:.3f}}', s) || '</u>' ELSE format('{{:.3f}}', s) END AS cell FROM r)
SELECT method, coalesce(max(cell) FILTER (level = 'de'), '--') AS de, coalesce(max(cell) FILTER (level = 'en'), '--') AS en, coalesce(max(cell) FILTER (level = 'xx'), '--') AS xx FROM c GROUP BY 1""")
def _k18(spark, sf_dir):
    return reports.score_table(_rated(spark, sf_dir), "method", "level", "score", ["de", "en", "xx"])


@query("k14_tree_features", "SELECT 3 AS depth, 2 AS width, 'a/b|a/c/d' AS paths")
def _k14(spark, sf_dir):
    t = editdist.Tree("a", (editdist.Tree("b"), editdist.Tree("c", (editdist.Tree("d"),))))
    return spark.createDataFrame([(t.depth(), t.width(), "|".join("/".join(p) for p in t.paths()))], "depth int, width int, paths string")


# ---- L: rewrites that name what they change
rewritten("l2_update_leaf", "SELECT ?n WHERE { ?x :in_region <kg:region/1> ; :name ?n }", lambda q: rewrites.update_leaf(q, A.Iri("region/1"), A.Iri("kg:region/2")), "SELECT n_name AS n FROM nation WHERE n_regionkey = 2")
rewritten("l5_drop_projection", "SELECT ?n ?x WHERE { ?x :in_region <kg:region/1> ; :name ?n }", lambda q: rewrites.drop_projection(q, "x"), "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
rewritten("l10_split_direct", "SELECT DISTINCT ?s ?p WHERE { ?s <kg:direct> ?p ; :of_nation <kg:nation/3> }", lambda q: rewrites.rebuild_paths(q, "kg:direct", "^:of_supplier/:of_part"), "SELECT DISTINCT 'kg:supplier/' || l_suppkey AS s, 'kg:part/' || l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3")
rewritten("l17_for_test_suite", "SELECT ?c WHERE { { SELECT ?c WHERE { VALUES ?n { <kg:nation/3> } ?c :of_nation ?n ; :mktsegment ?m FILTER(?m = \"BUILDING\") } } }", lambda q: rewrites.for_test_suite(q, "target"), "SELECT DISTINCT 'kg:customer/' || c_custkey AS target FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")


rewritten(
    "l19_union_normal_form",
    "SELECT ?x ?n WHERE { { ?x :in_region <kg:region/1> } UNION { ?x :in_region <kg:region/2> } { ?x :name ?n } UNION { ?x :in_region ?r BIND(\"again\" AS ?n) } FILTER(?n != \"NATION_1\") }",
    rewrites.union_normal_form,
    "SELECT 'kg:nation/' || n_nationkey AS x, n AS n FROM nation, (SELECT unnest([0, 1]) AS k), LATERAL (SELECT CASE k WHEN 0 THEN n_name ELSE 'again' END AS n) WHERE n_regionkey IN (1, 2) AND n <> 'NATION_1'",
)


@query("l9_added_prefix", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
def _l9(spark, sf_dir):
    return engine(spark, sf_dir).sparql(rewrites.with_prefix("SELECT ?n WHERE { ?x fb:in_region <kg:region/1> ; fb:name ?n }", "fb", "kg:"))


# ---- M: dialects of logical forms
_STATEMENTS = sexpr.Dialect(statements="of_order", lexical=True, english=True)


@query("m6_statement_dialect", "SELECT DISTINCT 'kg:part/' || l_partkey AS x FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1) AND l_returnflag = 'R'")
def _m6(spark, sf_dir):
    """The parts of statements, marked R, of orders that have a statement with supplier 1."""
    form = '(JOIN (R ps:of_part) (AND (JOIN (R p:of_part) (JOIN p:of_part (JOIN pq:of_supplier supplier/1))) (JOIN pq:returnflag "R"@en)))'
    return engine(spark, sf_dir).sparql(sexpr.to_query(form, _STATEMENTS))


@query("m6_statement_count", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_partkey = 5")
def _m6c(spark, sf_dir):
    return engine(spark, sf_dir).sparql(sexpr.to_query("(COUNT (JOIN wdt:of_part part/5))", _STATEMENTS))


@query("m6_statement_arg", "SELECT 'kg:order/' || o_orderkey AS x FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1) ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _m6a(spark, sf_dir):
    return engine(spark, sf_dir).sparql(sexpr.to_query("(ARGMAX (JOIN p:of_part (JOIN pq:of_supplier supplier/1)) totalprice)", _STATEMENTS))


@query("m7_pairwise_apart", "SELECT DISTINCT 'kg:nation/' || a.n_nationkey AS x FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE b.n_name = 'NATION_3'")
def _m7(spark, sf_dir):
    form = '(JOIN in_region (JOIN (R in_region) (JOIN name "NATION_3")))'
    return engine(spark, sf_dir).sparql(sexpr.to_query(form, sexpr.Dialect(apart=True)))


@query("m8_from_query", "SELECT DISTINCT 'kg:part/' || l_partkey AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 1 AND p_size <= 20")
def _m8(spark, sf_dir):
    """A query as a logical form, and that as a query again."""
    form = sexpr.from_query(parse("SELECT DISTINCT ?x WHERE { ?l :of_part ?x ; :of_supplier <kg:supplier/1> . ?x :size ?z FILTER(?z <= 20) }"))
    return engine(spark, sf_dir).sparql(sexpr.to_query(form))


@query("m9_training_form", """SELECT '(AND (le m.size 20^^http://www.w3.org/2001/XMLSchema#integer) (JOIN m.name plain))' AS form""")
def _m9(spark, sf_dir):
    text = '(AND (LE m.size "20"^^<http://www.w3.org/2001/XMLSchema#integer>) (EQ m.name "plain"))'
    return spark.createDataFrame([(sexpr.for_training(text),)], "form string")


@query("m10_form_graphs", "SELECT * FROM (VALUES (0, 4, 4), (1, 3, 2), (2, NULL, NULL)) v(i, n_nodes, n_edges)")
def _m10(spark, sf_dir):
    """Nodes and edges of forms: with an ontology, of a count, and of one that has no graph."""
    rows = []
    for i, (form, how) in enumerate((("(JOIN of_nation nation/3)", {"roles": {"of_nation": ("customer", "nation")}, "reverse": {"of_nation": "has_customer"}}), ("(COUNT (JOIN of_nation nation/3))", {}), ("(TC (JOIN r m.0) a.from 2001)", {}))):
        try:
            g = editdist.form_graph(form, **how)
            rows.append((i, len(g.nodes), len(g.edges)))
        except ValueError:
            rows.append((i, None, None))
    return spark.createDataFrame(rows, "i int, n_nodes int, n_edges int")


@query("m11_graph_to_sexpr", "SELECT DISTINCT 'kg:customer/' || c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_acctbal > 1000")
def _m11(spark, sf_dir):
    g = querygraph.QueryGraph("x", [("of_nation", "x", "n"), ("in_region", "n", "kg:region/2")], types={"x": ["customer"]}, comparisons=[("acctbal", "x", ">", "1000")])
    return engine(spark, sf_dir).sparql(sexpr.to_query(g.to_sexpr()))


@query("m14_graph_form", """SELECT * FROM (VALUES (0, '(AND (JOIN type.object.type people.person) (JOIN r "3.0"^^<http://www.w3.org/2001/XMLSchema#float>))'), (1, '(JOIN r "x"@en)'), (2, '(JOIN r "1"^^<http://www.w3.org/2001/XMLSchema#integer>)')) v(i, form)""")
def _m14(spark, sf_dir):
    forms = ["(AND people.person (JOIN r 3))", '(JOIN r "x")', "(JOIN r 1^^http://www.w3.org/2001/XMLSchema#integer)"]
    return spark.createDataFrame([(i, sexpr.for_graph_distance(f)) for i, f in enumerate(forms)], "i int, form string")


# ---- N, O: ontology and search
@query("n8_reverse_property", "SELECT * FROM (VALUES ('in_region', 'has_nation'), ('has_nation', 'in_region')) v(relation, reverse)")
def _n8(spark, sf_dir):
    return files.both_ways(spark.createDataFrame([("in_region", "has_nation")], "relation string, reverse string"))


@query("o1_question_tree", """SELECT * FROM (VALUES ('1', 0, '<OUTQ>', NULL, 'parts of <IQ1>, that are small'), ('1', 1, '<IQ1>', '<OUTQ>', 'suppliers in <IQ2>'), ('1', 2, '<IQ2>', '<IQ1>', 'nation 3'), ('2', 0, '<OUTQ>', NULL, 'Which nations?')) v(qid, position, tag, parent, text)""")
def _o1(spark, sf_dir):
    return questions.sub_questions(_decomposed(spark), "qid", "question", "decomposition")


@query("o2_shrunk_tree", "SELECT * FROM (VALUES ('<OUTQ>', 'parts of suppliers in <IQ2>, that are small'), ('<IQ2>', 'nation 3')) v(tag, text)")
def _o2(spark, sf_dir):
    tree = questions.read_tree(_DECOMPOSITION, "")
    questions.shrink(tree.children[0])
    return spark.createDataFrame([(n.tag, n.text) for n in tree.walk()], "tag string, text string")


@query("o3_question_search", """SELECT 0 AS position, 'SELECT DISTINCT ?v1 WHERE { ?v0 kg:in_region <kg:region/1> . ?v1 kg:mktsegment "BUILDING" . ?v1 kg:of_nation ?v0 . }' AS query, 1.0::DOUBLE AS f1""")
def _o3(spark, sf_dir):
    e = engine(spark, sf_dir)
    answers = e.sparql("SELECT DISTINCT ?c WHERE { ?c :of_nation ?n ; :mktsegment \"BUILDING\" . ?n :in_region <kg:region/1> }")
    parts = [{"description": "customers of mktsegment BUILDING of nation <IQ1>", "<IQ1>": [{"description": "nation in region 1"}]}]
    found = treesearch.search(e, "Which customers of the segment BUILDING are in a nation of region 1?", answers, {"kg:region/1": "region 1", '"BUILDING"': "BUILDING"}, ["customer"], parts)
    return found.select("position", "query", "f1")


def _keys_of(spark, graphs):
    return spark.createDataFrame([(i, g.key()) for i, g in enumerate(graphs)], "i int, query string")


@query("o6_skeletons", "SELECT * FROM (VALUES (0, 'SELECT DISTINCT ?v0 WHERE { ?v0 kg:of_nation ?v1 . ?v2 kg:placed_by ?v0 . }'), (1, 'SELECT DISTINCT ?v1 WHERE { ?v0 kg:by_user ?v1 . ?v1 kg:of_nation ?v2 . }')) v(i, query)")
def _o6(spark, sf_dir):
    return _keys_of(spark, treesearch.skeletons("x", ["a", "b"], [["of_nation"], ["^placed_by", "^by_user"]]))


@query("o8_constants_near", "SELECT '^of_supplier/of_order' AS relation, count(DISTINCT l_suppkey) AS n_anchors, count(*) AS n_pairs FROM lineitem WHERE l_orderkey = 1 AND l_suppkey IN (SELECT s_suppkey FROM supplier)")
def _o8(spark, sf_dir):
    return explore.relations_to(sales_graph(spark, sf_dir), _suppliers(spark, sf_dir), "kg:order/1")


@query("o8_shared_neighbours", "SELECT 'kg:nation/' || n_nationkey AS item, n_name AS label FROM nation WHERE n_nationkey = 3")
def _o8n(spark, sf_dir):
    """What three customers of one nation have in common."""
    some = explore.sample_nodes(engine(spark, sf_dir).sparql("SELECT ?c WHERE { ?c :of_nation <kg:nation/3> ; :mktsegment ?m }"), 3)
    return explore.shared_neighbours(sales_graph(spark, sf_dir), some)


@query("o9_constant_structures", """SELECT * FROM (VALUES (0, 'SELECT DISTINCT ?v1 WHERE { ?v0 kg:of_part ?v1 . ?v0 kg:of_supplier <kg:supplier/1> . }'), (1, 'SELECT DISTINCT ?v1 WHERE { ?v0 kg:of_order <kg:order/2> . ?v0 kg:of_part ?v1 . }'),
  (2, 'SELECT DISTINCT ?v1 WHERE { ?v0 kg:of_order <kg:order/2> . ?v0 kg:of_part ?v1 . ?v0 kg:of_supplier <kg:supplier/1> . }')) v(i, query)""")
def _o9(spark, sf_dir):
    single, double = treesearch.constant_structures("x", {"kg:supplier/1": ["^of_part/of_supplier"], "kg:order/2": ["^of_part/of_order"]})
    return _keys_of(spark, single + double)


@query("o12_at_middle", "SELECT 0 AS i, 'SELECT DISTINCT ?v1 WHERE { ?v0 kg:of_order <kg:order/2> . ?v0 kg:of_part ?v1 . ?v0 kg:of_supplier ?v2 . }' AS query")
def _o12(spark, sf_dir):
    bone = querygraph.QueryGraph("x", querygraph.path_edges("x", "^of_part/of_supplier", "s", "m"))
    return _keys_of(spark, [bone.at_middle(querygraph.QueryGraph("x", querygraph.path_edges("x", "^of_part/of_order", "kg:order/2", "k")))])


@query("o13_compared_at_middle", "SELECT DISTINCT 'kg:part/' || l_partkey AS x FROM lineitem WHERE l_suppkey = 1 AND l_quantity >= 25")
def _o13(spark, sf_dir):
    g = querygraph.QueryGraph("x", querygraph.path_edges("x", "^of_part/of_supplier", "kg:supplier/1", "m"))
    return engine(spark, sf_dir).sparql(g.compared("^of_part/quantity", ">=", "25").to_query())


@query("o17_without_types", "SELECT false AS typed")
def _o17(spark, sf_dir):
    e = engine(spark, sf_dir)
    g = querygraph.QueryGraph("x", [("of_nation", "x", "kg:nation/3"), ("mktsegment", "x", '"BUILDING"')], types={"x": ["customer"]})
    run = treesearch.TreeSearch(e, "", e.sparql(g.to_query()), {})
    return spark.createDataFrame([(bool(treesearch.without_redundant_types(run, [g])[0].types),)], "typed boolean")


@query("o18_ranked", "SELECT 0 AS i, 'of_nation' AS predicate UNION ALL SELECT 1, 'mktsegment'")
def _o18(spark, sf_dir):
    graphs = [querygraph.QueryGraph("x", [(p, "x", c)]) for p, c in (("mktsegment", '"BUILDING"'), ("of_nation", "kg:nation/3"))]
    best = treesearch.rank_graphs(graphs, "customers of the nation France", {"kg:nation/3": "France"}, 2)
    return spark.createDataFrame([(i, g.edges[0][0]) for i, g in enumerate(best)], "i int, predicate string")


@query("o19_applied_choice", "SELECT * FROM (VALUES ('a', 2, 'y'), ('b', 1, 'z')) v(qid, position, query)")
def _o19(spark, sf_dir):
    candidates = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "qid string, position int, query string")
    return synthesis.apply_choice(candidates, spark.createDataFrame([("a", "I choose 2."), ("b", "none")], "qid string, reply string"))


# ---- files, bindings and reports
@query("a9_binding_values", "SELECT event_id, value AS number, NULL::VARCHAR AS text FROM events UNION ALL SELECT -event_id, NULL, event_type FROM events")
def _a9(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    typed = e.select("event_id", F.lit("typed-literal").alias("k"), F.col("value").cast("string").alias("v"), F.lit("http://www.w3.org/2001/XMLSchema#double").alias("dt"))
    plain = e.select(-F.col("event_id"), F.lit("literal"), "event_type", F.lit(None).cast("string"))
    cells = (F.col("k"), F.col("v"), F.col("dt"))
    return typed.union(plain).select("event_id", files.binding_number(*cells).alias("number"), files.binding_text(*cells).alias("text"))


@query("a13_roles", "SELECT 'nation' AS domain, 'in_region' AS relation, 'region' AS \"range\"")
def _a13(spark, sf_dir):
    return files.parse_roles(spark.createDataFrame([("nation  in_region\tregion",), ("",), ("short line",)], "value string"))


@query("a14_methods", "SELECT * FROM (VALUES ('/x/set_BEAM_gold.json', 'beam, gold links'), ('/x/beam.json', 'beam'), ('/x/other.json', 'plain')) v(path, method)")
def _a14(spark, sf_dir):
    rows = spark.createDataFrame([("/x/set_BEAM_gold.json",), ("/x/beam.json",), ("/x/other.json",)], "path string")
    return rows.select("path", files.method_of(F.col("path"), [("beam.*gold", "beam, gold links"), ("beam", "beam")], "plain").alias("method"))


@query("a15_markdown", "SELECT '| r_name | n |' AS value UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || r_name || ' | ' || count(*) || ' |' FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def _a15(spark, sf_dir):
    r = engine(spark, sf_dir).sparql("SELECT ?r_name (COUNT(?x) AS ?n) WHERE { ?x :in_region ?r . ?r :name ?r_name } GROUP BY ?r_name")
    return files.markdown_lines(r)


@query("a17_cached_results", "SELECT 'kg:nation/' || n_nationkey AS n FROM nation WHERE n_regionkey = 1")
def _a17(spark, sf_dir):
    cache = access.ResultCache(engine(spark, sf_dir), f"{shared_folder(spark)}/results-{uuid.uuid4().hex}")
    cache.get("SELECT ?n WHERE { ?n :in_region <kg:region/1> }")
    return cache.get("SELECT  ?n\nWHERE { ?n :in_region <kg:region/1> }")


@query("j5_syntax_constants", "SELECT * FROM (VALUES ('m.0a', '<kg:m.0a>', 'kg:m.0a'), ('\"5\"^^<http://www.w3.org/2001/XMLSchema#integer>', '\"5\"^^<http://www.w3.org/2001/XMLSchema#integer>', '\"5\"'), ('\"x\"@en', '\"x\"@en', '\"x\"')) v(c, text, value)")
def _j5(spark, sf_dir):
    rows = spark.createDataFrame([("m.0a",), ('"5"^^<http://www.w3.org/2001/XMLSchema#integer>',), ('"x"@en',)], "c string")
    return rows.select("c", words.syntax_text(F.col("c"), "kg:").alias("text"), words.syntax_value(F.col("c"), "kg:").alias("value"))


@query("k16_missing_is_zero", "SELECT round(avg(coalesce(s, 0.0)), 9) AS mean, count(*) - count(s) AS n_missing FROM documents LEFT JOIN (SELECT doc_id, max(quality / 2.0) AS s FROM labels GROUP BY 1) USING (doc_id)")
def _k16(spark, sf_dir):
    scores = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") / 2.0).alias("s"))
    return reports.per_gold_mean(scores, table(spark, sf_dir, "documents"), "doc_id", "s", 0.0, F.max).withColumn("mean", F.round("mean", 9))


@query("m4_edit_distance_form", "SELECT 'SELECT DISTINCT (?v1 AS ?v2) WHERE { ?v0 kg:of_part ?v1 . ?v0 kg:of_supplier kg:supplier/1 . }' AS query")
def _m4(spark, sf_dir):
    q = rewrites.for_edit_distance(sexpr.to_query("(JOIN (R of_part) (JOIN of_supplier supplier/1))"))
    return spark.createDataFrame([(show_query(q).replace("<kg:supplier/1>", "kg:supplier/1"),)], "query string")


@query("o5_ranked_relations", "SELECT * FROM (VALUES (0, 'of_supplier'), (1, 'of_part')) v(i, relation)")
def _o5(spark, sf_dir):
    best = treesearch.by_words("which supplier delivered it", ["of_part", "of_supplier", "quantity"], 2)
    return spark.createDataFrame(list(enumerate(best)), "i int, relation string")


@query("o14_superlatives", "SELECT * FROM (VALUES (0, 'totalprice', true), (1, 'totalprice', false), (2, 'orderdate', true), (3, 'orderdate', false)) v(i, predicate, descending)")
def _o14(spark, sf_dir):
    found = synthesis.superlatives(engine(spark, sf_dir), [querygraph.QueryGraph("x", [("placed_by", "x", "kg:customer/1")])], ["totalprice", "orderdate"])
    return spark.createDataFrame([(i, g.arg[0], g.arg[2]) for i, g in enumerate(found)], "i int, predicate string, descending boolean")


@query("o16_legal", "SELECT * FROM (VALUES (1.0::DOUBLE, 1.0::DOUBLE, true), (0.2, 1.0, true), (1.0, 0.5, false)) v(precision, recall, legal)")
def _o16(spark, sf_dir):
    return spark.createDataFrame([(p, r, synthesis.is_legal(p, r)) for p, r in ((1.0, 1.0), (0.2, 1.0), (1.0, 0.5))], "precision double, recall double, legal boolean")


# ---- text operators and scores over whole tables
@query("b29_kinds_of_keys", "SELECT c_custkey AS k, ['entity', 'class', 'quantity', 'time', 'string'][1 + c_custkey % 5] AS kind FROM customer")
def _b29t(spark, sf_dir):
    xsd, k = "http://www.w3.org/2001/XMLSchema#", F.col("c_custkey").cast("string")
    forms = F.array(F.concat(F.lit("m.0"), k), F.lit("people.person"), F.concat(F.lit('"'), k, F.lit(f'"^^<{xsd}integer>')), F.concat(F.lit('"'), k, F.lit(f'"^^<{xsd}gYear>')), F.concat(F.lit('"'), k, F.lit('"@en')))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), words.constant_kind(F.get(forms, (F.col("c_custkey") % 5).cast("int"))).alias("kind"))


@query("b30_compare_values", "SELECT l_quantity AS q, any_value(CASE WHEN abs(l_quantity - 25) < 0.001 THEN 'EQ,GE,LE' WHEN l_quantity < 25 THEN 'LE,LT' ELSE 'GE,GT' END) AS held, count(*) AS n FROM lineitem GROUP BY 1")
def _b30t(spark, sf_dir):
    held = metrics.holding_comparators(F.concat(F.lit('"'), F.col("l_quantity").cast("string"), F.lit('"')), F.lit('"25"'))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.array_join(F.array_sort(held), ",").alias("held"))
    return rows.groupBy("q").agg(F.min("held").alias("held"), F.count("*").alias("n"))


@query("b30_compare_times", "SELECT o_orderkey, CASE WHEN o_orderdate = TIMESTAMP '1998-01-01' THEN 'EQ,GE,LE' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'LE,LT' ELSE 'GE,GT' END AS held FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS o_orderdate FROM orders)")
def _b30d(spark, sf_dir):
    held = metrics.holding_comparators(F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"')), F.lit('"1998"'))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(held), ",").alias("held"))


@query("j6_rendered_values", """SELECT c_custkey, '"' || c_acctbal || '"^^<d>' AS number, '"' || c_mktsegment || '"@en' AS word, 'kg:customer/' || c_custkey AS node FROM customer""")
def _j6t(spark, sf_dir):
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        words.render(F.lit("typed-literal"), F.col("c_acctbal").cast("string"), F.lit("d"), none).alias("number"),
        words.render(F.lit("literal"), F.col("c_mktsegment"), none, F.lit("en")).alias("word"),
        words.render(F.lit("uri"), F.concat(F.lit("kg:customer/"), F.col("c_custkey").cast("string")), none, none).alias("node"),
    )


@query("j8_expanded_months", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS t, strftime(o_orderdate, '%Y-%m') || ',' || strftime(o_orderdate, '%Y-%m-01') || ',' || strftime(last_day(o_orderdate), '%Y-%m-%d') AS v FROM orders")
def _j8t(spark, sf_dir):
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").select(month.alias("t")).distinct().select("t", F.array_join(words.expand_time(F.col("t")), ",").alias("v"))


@query("j10_triggers_of_texts", "SELECT doc_id, ['COUNT', 'ARG', 'COMPARE', '', 'COMPARE,COUNT,ARG'][1 + doc_id % 5] AS triggers FROM documents")
def _j10t(spark, sf_dir):
    phrases = F.array(*(F.lit(p) for p in ("How many rows are there?", "Which has the maximum price?", "Which cost more than 5?", "Who placed it?", "How many cost at most 5?")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words.numeral_triggers(F.get(phrases, (F.col("doc_id") % 5).cast("int"))), ",").alias("triggers"))


@query("j12_hops_of_texts", "SELECT p_partkey, (p_partkey % 4 + p_partkey % 3 + 1)::INT AS hops FROM part")
def _j12t(spark, sf_dir):
    text = F.concat(F.lit("SELECT ?x { ?x wdt:P1 ?y . "), F.repeat(F.lit("?a ps:P2 ?b . "), (F.col("p_partkey") % 4).cast("int")), F.repeat(F.lit("FILTER(?y > 1) "), (F.col("p_partkey") % 3).cast("int")), F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", words.hops(text).cast("int").alias("hops"))


@query("j13_direct_forms", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '?x wdt:P' || p_size || ' ?y' ELSE '?x p:P' || p_size || '/ps:P0 ?y' END AS q FROM part")
def _j13t(spark, sf_dir):
    n = F.col("p_size").cast("string")
    text = F.concat(F.lit("?x p:P"), n, F.lit("/ps:P"), F.when(F.col("p_size") % 2 == 0, n).otherwise("0"), F.lit(" ?y"))
    return table(spark, sf_dir, "part").select("p_partkey", words.direct_form(text).alias("q"))


def _supplier_pairs(spark, sf_dir):
    """The query of each supplier's nation, and one that is equal, has a pattern more, or goes the other way."""
    iri = F.concat(F.lit("<kg:nation/"), F.col("s_nationkey").cast("string"), F.lit(">"))
    gold = F.concat(F.lit("SELECT ?x { ?x :of_nation "), iri, F.lit(" }"))
    more = F.concat(F.lit("SELECT ?x { ?x :of_nation "), iri, F.lit(" . ?x :b ?z }"))
    back = F.concat(F.lit("SELECT ?x { "), iri, F.lit(" :of_nation ?x }"))
    made = F.when(F.col("s_suppkey") % 3 == 0, F.regexp_replace(gold, r"\?x", "?y")).when(F.col("s_suppkey") % 3 == 1, more).otherwise(back)
    return table(spark, sf_dir, "supplier").select("s_suppkey", gold.alias("g"), made.alias("c"))


@query("k9_ted_of_pairs", "SELECT s_suppkey, [0.0::DOUBLE, 1 / 3.0::DOUBLE, 0.25::DOUBLE][1 + s_suppkey % 3] AS ted FROM supplier")
def _k9t(spark, sf_dir):
    return _supplier_pairs(spark, sf_dir).select("s_suppkey", editdist.tree_distance_column(F.col("c"), F.col("g")).alias("ted"))


@query("k11_ged_of_pairs", "SELECT s_suppkey, [0.0::DOUBLE, 0.4::DOUBLE, 2 / 3.0::DOUBLE][1 + s_suppkey % 3] AS ged, false AS gave_up FROM supplier")
def _k11t(spark, sf_dir):
    return _supplier_pairs(spark, sf_dir).select("s_suppkey", editdist.graph_distance_parts(F.col("c"), F.col("g")).alias("d")).select("s_suppkey", F.col("d.distance").alias("ged"), "d.gave_up")


@query("k13_matches_of_pairs", "SELECT s_suppkey, s_suppkey % 3 = 0 AS em FROM supplier")
def _k13t(spark, sf_dir):
    return _supplier_pairs(spark, sf_dir).select("s_suppkey", editdist.exact_match_column(F.col("c"), F.col("g")).alias("em"))


@query("o10_comparisons_of_catalog", f"SELECT predicate AS relation, c AS comparator, v AS literal FROM (SELECT DISTINCT predicate FROM {_CATALOG} WHERE \"range\" IN ('int', 'dbl')), (SELECT unnest(['>=', '>', '<=', '<']) AS c), (SELECT r_regionkey::VARCHAR AS v FROM region)")
def _o10t(spark, sf_dir):
    relations = explore.properties_of_type(sales_graph(spark, sf_dir), ["int", "dbl"]).select(F.col("predicate").alias("relation")).distinct()
    return synthesis.comparison_candidates(relations, table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("literal")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["c1_bgp_chain"](spark, sf_dir)
