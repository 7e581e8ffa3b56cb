"""Every registered query of the graph engine against its SQL."""

import math
import os

import duckdb
import pytest

from quillgraph import queries as Q


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    cur = duck.execute(Q.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def test_distances(spark, sf_dir):
    ted = {r.i: r.ted for r in Q.QUERIES["k9_ted"](spark, sf_dir).collect()}
    ged = {r.i: r.ged for r in Q.QUERIES["k11_ged"](spark, sf_dir).collect()}
    assert ted[0] == ged[0] == 0
    assert ted[3] == ged[3] == 1
    assert 0 < ted[1] < 1 and 0 < ged[1] < 1 and 0 < ged[2] < 1


def test_every_anchor_is_explored(spark, sf_dir):
    customers = {f"kg:customer/{r.c_custkey}" for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    orders = {f"kg:order/{r.o_orderkey}" for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()}
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    run = lambda name: Q.QUERIES[name](spark, sf_dir).collect()
    assert {r.node for r in run("n2_classes")} == customers | orders
    assert {r.anchor for r in run("n10_neighbors")} == customers
    assert {r.relation: r.n_anchors for r in run("n9_expand")}["acctbal"] == len(customers)
    assert {r.n_anchors for r in run("n9_expand_cvt")} == {suppliers}
    rows = run("c11_label_batch")
    assert sum(r.node.startswith("kg:order/") and r.label is None for r in rows) == len(orders) > 50


def test_documents_of_any_length_are_answers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert max(len(r.x) for r in Q.QUERIES["b32_answer_filter"](spark, sf_dir).collect()) == max(len(r.text) for r in docs if r.lang == "en") >= 400
    long = {f"kg:document/{r.doc_id}" for r in docs if r.lang == "fr" and r.n_chars >= 600}
    assert long and long <= {r.d for r in Q.QUERIES["i1_str_lang_datatype"](spark, sf_dir).collect()}


def test_plans_push_and_hash(spark, sf_dir):
    """A constant subject reaches the scan under any predicate; unbound variables bring no nested loop."""
    plan = lambda name: Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "EqualTo(c_custkey,1)" in plan("b22_namespace")
    assert "orders.parquet" not in plan("b22_namespace")
    assert "documents.parquet" not in plan("i14_kinds")
    for name in ("b18_values_undef_join", "c5_optional_chain", "c6_minus_unbound"):
        assert "NestedLoop" not in plan(name)


def with_table(sf_dir, folder, name, sql):
    """The tables of ``sf_dir`` below a new folder, one of them replaced by what a SELECT over ``t`` (the old one) gives."""
    for f in os.listdir(sf_dir):
        if f != f"{name}.parquet":
            os.symlink(f"{sf_dir}/{f}", f"{folder}/{f}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW t AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return str(folder), con


def test_both_zeros_are_one_node(spark, sf_dir, tmp_path):
    folder, con = with_table(sf_dir, tmp_path, "customer", "SELECT * REPLACE (CASE WHEN c_custkey % 2 = 0 THEN '-0.0'::DOUBLE ELSE c_acctbal END AS c_acctbal) FROM t")
    assert con.execute("SELECT count(*) FROM customer WHERE c_acctbal::VARCHAR = '-0.0'").fetchone()[0] > 0
    assert Q.QUERIES["e5_zero_length"](spark, folder).first()[0] == con.execute(Q.SQL["e5_zero_length"]).fetchone()[0]
