"""Exploration of a graph: its catalog, and what lies around anchors.

Anchors are DataFrames with a column ``node`` (the node's IRI), so one plan serves any number of them; where they
have a column ``grp`` as well, groups of nodes are counted as anchors, and not nodes.  They are parted by class, of which there are as many as the schema names, and each class's keys are joined as native
columns: every table is read once, and only the tables of classes that anchors have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import metrics
from quillgraph.functions.terms import text_of
from quillgraph.sources.registry import NS, Edge, Graph


def _iri(cls: str, key: Column) -> Column:
    return F.concat(F.lit(f"{NS}{cls}/"), key.cast("string"))


def _text(g: Graph, e: Edge) -> Column:
    return text_of(g.value(e), g.value_type(e))


def _present(g: Graph, e: Edge) -> Column:
    """Null where the edge has no value."""
    return F.expr(e.column)["lex"] if e.target == "lang" else g.value(e)


def key_of(g: Graph, iri: str, cls: str) -> Column | None:
    """The native key of a constant node, or None when it is of another class."""
    head = f"{NS}{cls}/"
    if not iri.startswith(head):
        return None
    key = iri.removeprefix(head)
    if not g.classes[cls].native:
        return F.lit(key)
    return F.lit(int(key)).cast("bigint") if key.lstrip("-").isdigit() else None


def classes_in(g: Graph, nodes: DataFrame) -> list[str]:
    """The classes that some anchor has: at most as many as the schema has."""
    cls = F.regexp_extract("node", f"^{NS}([^/]+)/", 1)
    return sorted(r[0] for r in nodes.select(cls.alias("c")).distinct().collect() if r[0] in g.classes)


def _keys(g: Graph, nodes: DataFrame, cls: str) -> DataFrame:
    """anchor_ (and grp_): the native keys of the anchors of a class."""
    head = f"{NS}{cls}/"
    text = F.expr(f"substring(node, {len(head) + 1})")
    group = [F.col("grp").alias("grp_")] if "grp" in nodes.columns else []
    mine = nodes.filter(F.startswith(F.col("node"), F.lit(head)))
    if not g.classes[cls].native:
        return mine.select(text.alias("anchor_"), *group)
    key = text.try_cast("bigint")
    return mine.filter(key.cast("string") == text).select(key.alias("anchor_"), *group)


def _around(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of a table whose ``key`` is an anchor, with the key, or the anchor's group, as column ``at_``."""
    if "grp_" in keys.columns:
        return df.join(keys.distinct(), key == F.col("anchor_")).withColumn("at_", F.col("grp_")).drop("grp_", "anchor_")
    return df.withColumn("at_", key).join(keys, F.col("at_") == F.col("anchor_"), "left_semi")


def _packed(df: DataFrame, key: Column, keys: DataFrame, cells: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """The rows around anchors, cut down to which of the cells they hold, as bits, before they are joined; and the cells read from these."""
    bits = {name: (f"m{i // 62}_", 1 << i % 62) for i, name in enumerate(cells)}
    words: dict[str, list[Column]] = {}
    for name, (word, bit) in bits.items():
        words.setdefault(word, []).append(F.when(cells[name].isNotNull(), F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    rows = df.select(key.alias("key0_"), *(reduce(lambda a, b: a.bitwiseOR(b), cs).alias(word) for word, cs in words.items()))
    return _around(rows, F.col("key0_"), keys).select("at_", *words), {name: F.when(F.col(word).bitwiseAND(F.lit(bit).cast("bigint")) != 0, True) for name, (word, bit) in bits.items()}


def _tables(edges: list[Edge]) -> list[list[Edge]]:
    """Edges by the table that holds them."""
    out: dict[tuple, list[Edge]] = {}
    for e in edges:
        out.setdefault((e.table, e.key, e.cls), []).append(e)
    return list(out.values())


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, empty) if parts else empty


def edge_table(g: Graph, e: Edge) -> DataFrame:
    """src, dst of one edge: IRIs, or a literal's text as dst."""
    return g.scan(e.table, e.key).filter(_present(g, e).isNotNull()).select(_iri(e.cls, F.col("key_")).alias("src"), _text(g, e).alias("dst"))


def domains(g: Graph) -> DataFrame:
    """predicate, domain, range of the whole catalog."""
    return g.catalog().select("predicate", "domain", "range").distinct()


def classes_of(g: Graph, anchors: DataFrame) -> DataFrame:
    """node, cls: the class of each anchor that exists."""
    parts = []
    for cls in classes_in(g, anchors):
        keys = _keys(g, anchors, cls)
        for es in _tables([e for e in g.edges if e.cls == cls]):
            nodes = _around(g.scan(es[0].table, es[0].key), F.col("key_"), keys)
            parts.append(nodes.select(_iri(cls, F.col("at_")).alias("node"), F.lit(cls).alias("cls")))
    return _union(parts, g.spark.createDataFrame([], "node string, cls string")).distinct()


def _value_of(g: Graph, nodes: DataFrame, cls: str, predicate: str, out: str) -> DataFrame | None:
    """at_ and the smallest value of a predicate of the anchors of a class; None if the class has no such predicate."""
    edges = [e for e in g.by_predicate(predicate) if e.cls == cls]
    if not edges:
        return None
    keys = _keys(g, nodes, cls)
    parts = [_around(g.scan(e.table, e.key), F.col("key_"), keys).select("at_", _text(g, e).alias(out)) for e in edges]
    return reduce(DataFrame.unionByName, parts).groupBy("at_").agg(F.min(out).alias(out))


def labels(g: Graph, anchors: DataFrame, fallback: str | None = None) -> DataFrame:
    """node, label: the name of each anchor, else the value of another predicate, else null."""
    nodes = anchors.select("node").distinct()
    seen = classes_in(g, nodes)
    parts = []
    for cls in seen:
        mine = nodes.filter(F.startswith(F.col("node"), F.lit(f"{NS}{cls}/")))
        out, label = mine, F.lit(None).cast("string")
        for predicate, column in (("name", "n_"), (fallback, "f_")):
            found = _value_of(g, mine, cls, predicate, column) if predicate else None
            if found is not None:
                found = found.select(_iri(cls, F.col("at_")).alias("k_" + column), column)
                out = out.join(found, F.col("node") == F.col("k_" + column), "left").drop("k_" + column)
                label = F.coalesce(label, F.col(column))
        parts.append(out.select("node", label.alias("label")))
    others = reduce(lambda c, cls: c & ~F.startswith(F.col("node"), F.lit(f"{NS}{cls}/")), seen, F.lit(True))
    return _union(parts, nodes.filter(others).select("node", F.lit(None).cast("string").alias("label")))


def intermediate(g: Graph) -> list[str]:
    """Classes of n-ary nodes: they have no name and join several things."""
    return [c.name for c in g.classes.values() if not c.named and sum(g.is_class(e.target) for e in g.edges if e.cls == c.name) >= 2]


def _together(g: Graph, edges: list[Edge]) -> DataFrame:
    """The nodes (key_) of one class that have all of some edges; edges of one table need no join."""
    tables = [g.scan(es[0].table, es[0].key).filter(reduce(lambda a, b: a & b, (_present(g, e).isNotNull() for e in es))) for es in _tables(edges)]
    first, *rest = tables
    for other in rest:
        first = first.join(other.select(F.col("key_").alias("other_")), F.col("key_") == F.col("other_"), "left_semi")
    return first


def meets(g: Graph, first: str, second: str) -> DataFrame:
    """cls: the intermediate classes at which two predicates meet on one node, in data and not by schema alone."""
    out = []
    for cls in intermediate(g):
        a = [e for e in g.by_predicate(first) if e.cls == cls]
        b = [e for e in g.by_predicate(second) if e.cls == cls]
        out += [_together(g, [x, y]).limit(1).select(F.lit(cls).alias("cls")) for x in a for y in b]
    return _union(out, g.spark.createDataFrame([], "cls string")).distinct()


def coexists(g: Graph, main: str, qualifier: str) -> DataFrame:
    """main, qualifier, existence: whether some statement has both, as one row."""
    found = meets(g, main, qualifier).agg((F.count("*") > 0).alias("existence"))
    return found.select(F.lit(main).alias("main"), F.lit(qualifier).alias("qualifier"), "existence")


def third_relations(g: Graph, first: str, second: str, kind: str = "S-S") -> DataFrame:
    """side, relation: what else leads from (S) or to (O) the intermediate nodes at which two predicates meet.

    ``kind`` says for each of the two whether the node is its subject or its object.
    """
    if kind not in ("S-S", "S-O", "O-S", "O-O"):
        raise ValueError(f"no such connection: {kind}")
    out = []
    for cls in intermediate(g):
        held: list[DataFrame] = []
        for predicate, role in zip((first, second), kind.split("-"), strict=True):
            if role == "S":
                edges = [e for e in g.by_predicate(predicate) if e.cls == cls]
                parts = [_together(g, [e]).select("key_") for e in edges]
            else:
                edges = [e for e in g.by_predicate(predicate) if e.target == cls]
                parts = [g.table(e.table).select(g.value(e).alias("key_")).filter("key_ is not null") for e in edges]
            held.append(reduce(DataFrame.unionByName, parts) if parts else None)
        if any(h is None for h in held):
            continue
        own = [e for e in g.edges if e.cls == cls]
        into = [e for e in g.edges if e.target == cls]
        nodes = held[0].select(F.col("key_").alias("anchor_")).join(held[1].select(F.col("key_").alias("b_")), F.col("anchor_") == F.col("b_"), "left_semi")
        for es in _tables(own):
            if kind == "S-S" and all(any(e.predicate == p for e in es) for p in (first, second)):
                near = _together(g, [next(e for e in es if e.predicate == p) for p in (first, second)])  # one scan
            else:
                near = _around(g.scan(es[0].table, es[0].key), F.col("key_"), nodes)
            counts = near.agg(*(F.count(_present(g, e)).alias(f"c{i}") for i, e in enumerate(es)))
            rows = F.explode(F.array(*(F.struct(F.lit("S").alias("side"), F.lit(e.predicate).alias("relation"), F.col(f"c{i}").alias("n")) for i, e in enumerate(es))))
            out.append(counts.select(rows.alias("r")).select("r.*").filter("n > 0").drop("n"))
        for e in into:
            near = _around(g.table(e.table), g.value(e), nodes).limit(1)
            out.append(near.select(F.lit("O").alias("side"), F.lit(e.predicate).alias("relation")))
    return _union(out, g.spark.createDataFrame([], "side string, relation string")).distinct()


def _counted(parts: list[tuple[DataFrame, dict[str, Column]]], spark) -> DataFrame:
    """relation, n_anchors, n_pairs of tables whose rows belong to an anchor, at_: one row an anchor is shuffled."""
    out = []
    for df, cells in parts:
        names = {f"c{i}": relation for i, relation in enumerate(cells)}
        each = df.groupBy("at_").agg(*(F.count(c).alias(n) for n, c in zip(names, cells.values(), strict=True)))
        whole = each.agg(*(F.struct(F.sum((F.col(n) > 0).cast("long")).alias("a"), F.sum(n).alias("p")).alias(n) for n in names))
        rows = F.explode(F.array(*(F.struct(F.lit(r).alias("relation"), F.col(f"{n}.a").alias("n_anchors"), F.col(f"{n}.p").alias("n_pairs")) for n, r in names.items())))
        out.append(whole.select(rows.alias("r")).select("r.*").filter("n_pairs > 0"))
    every = _union(out, spark.createDataFrame([], "relation string, n_anchors long, n_pairs long"))
    return every.groupBy("relation").agg(F.sum("n_anchors").alias("n_anchors"), F.sum("n_pairs").alias("n_pairs"))


def _ahead(g: Graph, cls: str, keys: DataFrame) -> list[tuple[DataFrame, dict[str, Column]]]:
    """The tables of a class around anchors, with a column for each of its predicates."""
    return [_packed(g.scan(es[0].table, es[0].key), F.col("key_"), keys, {e.predicate: _present(g, e) for e in es}) for es in _tables([e for e in g.edges if e.cls == cls])]


def _back(g: Graph, cls: str, keys: DataFrame, skip: set[str]) -> list[tuple[DataFrame, dict[str, Column]]]:
    return [(_around(g.table(e.table), g.value(e), keys), {f"^{e.predicate}": F.col("at_")}) for e in g.edges if e.target == cls and e.cls not in skip]


def _over(g: Graph, cls: str, keys: DataFrame, over: set[str], first: list[str] | None = None) -> list[tuple[DataFrame, dict[str, Column]]]:
    """Two hops over n-ary nodes, in one scan of their table for each first predicate."""
    out = []
    for e in g.edges:
        if e.target == cls and e.cls in over and (first is None or e.predicate in first):
            others = [x for x in g.edges if x.cls == e.cls and x.table == e.table and x.predicate != e.predicate]
            if others:
                out.append(_packed(g.scan(e.table, e.key), g.value(e), keys, {f"^{e.predicate}/{x.predicate}": _present(g, x) for x in others}))
    return out


def next_relations(g: Graph, anchors: DataFrame, through: bool = True) -> DataFrame:
    """relation, n_anchors, n_pairs: what leads on from the anchors.

    A relation is ``p`` or, against its direction, ``^p``; through an n-ary node it is ``^p/q``.  Distinct
    anchors are counted, so that ``n_anchors`` of all of them is the intersection over answers.  A predicate of
    one class is a column of one table.
    """
    skip = set(intermediate(g)) if through else set()
    parts = []
    for cls in classes_in(g, anchors):
        keys = _keys(g, anchors, cls)
        parts += [] if cls in skip else _ahead(g, cls, keys)
        parts += _back(g, cls, keys, skip) + _over(g, cls, keys, skip)
    return _counted(parts, g.spark)


def two_phase_relations(g: Graph, anchors: DataFrame, blacklist: tuple[str, ...] = (), limit: int = 10, similarity: DataFrame | None = None) -> DataFrame:
    """relation, n_anchors, n_pairs of two hops over n-ary nodes, the first hop chosen before the second is read.

    First hops whose name holds a blacklisted text are left out; of more than ``limit`` the most similar stay,
    where ``similarity`` (relation, similarity) is given, ties by name.  The choice is among the schema's predicates.
    """
    over = set(intermediate(g))
    classes = {cls: _keys(g, anchors, cls) for cls in classes_in(g, anchors)}
    first = [part for cls, keys in classes.items() for part in _back(g, cls, keys, set(g.classes) - over)]
    names = sorted(r.relation.lstrip("^") for r in _counted(first, g.spark).select("relation").collect())
    names = [n for n in names if not any(b in n for b in blacklist)]
    if len(names) > limit and similarity is not None:
        scores = {r.relation: r.similarity for r in similarity.filter(F.col("relation").isin(*names)).collect()}
        names = sorted(sorted(names, key=lambda n: (-scores.get(n, -1.0), n))[:limit])
    return _counted([part for cls, keys in classes.items() for part in _over(g, cls, keys, over, names)], g.spark)


def next_items(g: Graph, anchors: DataFrame, relation: str, with_label: bool = False) -> DataFrame:
    """anchor, item (and label): where a relation of ``next_relations`` leads from each anchor."""
    steps = relation.split("/")
    parts = []
    for cls in classes_in(g, anchors):
        keys = _keys(g, anchors, cls)
        anchor = _iri(cls, F.col("at_")).alias("anchor")
        if len(steps) == 2:
            for e in g.by_predicate(steps[0].lstrip("^")):
                for x in g.by_predicate(steps[1]):
                    if e.target == cls and x.cls == e.cls and x.table == e.table and e.cls in intermediate(g):
                        parts.append(_around(g.scan(e.table, e.key), g.value(e), keys).select(anchor, _text(g, x).alias("item")))
        elif relation.startswith("^"):
            for e in g.by_predicate(relation[1:]):
                if e.target == cls:
                    parts.append(_around(g.scan(e.table, e.key), g.value(e), keys).select(anchor, _iri(e.cls, F.col("key_")).alias("item")))
        else:
            for e in g.by_predicate(relation):
                if e.cls == cls:
                    parts.append(_around(g.scan(e.table, e.key), F.col("key_"), keys).select(anchor, _text(g, e).alias("item")))
    pairs = _union(parts, g.spark.createDataFrame([], "anchor string, item string")).filter("item is not null").distinct()
    if not with_label:
        return pairs
    named = labels(g, pairs.select(F.col("item").alias("node")))
    return pairs.join(named, F.col("item") == F.col("node"), "left").select("anchor", "item", "label")


def sample_nodes(answers: DataFrame, n: int = 3) -> DataFrame:
    """node: the first n distinct answers in the order of their text, as a local table of n rows."""
    name = answers.columns[0]
    first = answers.select(F.col(name).alias("node")).filter("node is not null").distinct().orderBy("node").limit(n)
    return answers.sparkSession.createDataFrame(first.collect(), "node string")


def common_relations(relations: DataFrame, answers: int) -> DataFrame:
    """The relations that every one of so many answers has."""
    return relations.filter(F.col("n_anchors") == answers).select("relation")


def properties_of_type(g: Graph, kinds: list[str]) -> DataFrame:
    """predicate, range of the predicates whose values are of these literal types."""
    return g.catalog().filter(F.col("range").isin(*kinds)).select("predicate", "range").distinct()


def special_type(g: Graph) -> DataFrame:
    """predicate, special: TEMPORAL, QUANTITY or NORMAL by the type of its values."""
    kind = F.when(F.col("range").isin("ts", "date"), "TEMPORAL").when(F.col("range").isin("int", "dbl", "dec"), "QUANTITY").otherwise("NORMAL")
    return g.catalog().select("predicate", kind.alias("special")).distinct()


def arg_relations(g: Graph, anchors: DataFrame) -> DataFrame:
    """relation, special, n_anchors: the relations that lead from anchors to times or quantities, direct or over n-ary nodes."""
    kinds = {e.predicate: e.target for e in g.edges if e.target in ("ts", "date", "int", "dbl", "dec")}
    rows = [(p, "TEMPORAL" if k in ("ts", "date") else "QUANTITY") for p, k in sorted(kinds.items())]
    typed = g.spark.createDataFrame(rows, "p_ string, special string")  # of the schema's size
    found = next_relations(g, anchors).filter(~F.col("relation").rlike(r"^\^[^/]*$"))
    last = F.element_at(F.split("relation", "/"), -1)
    return found.join(F.broadcast(typed), last == F.col("p_")).select("relation", "special", "n_anchors")


def paths_to_literal(g: Graph, anchors: DataFrame, literal: str) -> DataFrame:
    """relation, comparator: one-hop comparisons of an anchor's values with a literal that hold for some anchor."""
    parts = []
    for cls in classes_in(g, anchors):
        keys = _keys(g, anchors, cls)
        for es in _tables([e for e in g.edges if e.cls == cls and not g.is_class(e.target)]):
            near = _around(g.scan(es[0].table, es[0].key), F.col("key_"), keys)
            cells = F.array(*(F.struct(F.lit(e.predicate).alias("relation"), _text(g, e).alias("value")) for e in es))
            parts.append(near.select(F.explode(cells).alias("c")).select("c.*"))
    every = _union(parts, g.spark.createDataFrame([], "relation string, value string")).filter("value is not null")
    held = metrics.holding_comparators(F.col("value"), F.lit(literal))
    return every.select("relation", F.explode(held).alias("comparator")).distinct()


def paths_to_node(g: Graph, anchors: DataFrame, target: str) -> DataFrame:
    """anchor, relation: one-hop relations, in either direction, that join an anchor with a node."""
    out = []
    for cls in classes_in(g, anchors):
        keys = _keys(g, anchors, cls)
        for e in g.edges:
            key = key_of(g, target, e.target) if g.is_class(e.target) else None
            if e.cls == cls and key is not None:
                hit = _around(g.scan(e.table, e.key).filter(g.value(e) == key), F.col("key_"), keys)
                out.append(hit.select(_iri(cls, F.col("at_")).alias("anchor"), F.lit(e.predicate).alias("relation")))
            key = key_of(g, target, e.cls)
            if e.target == cls and key is not None:
                hit = _around(g.scan(e.table, e.key).filter(F.col("key_") == key), g.value(e), keys)
                out.append(hit.select(_iri(cls, F.col("at_")).alias("anchor"), F.lit("^" + e.predicate).alias("relation")))
    return _union(out, g.spark.createDataFrame([], "anchor string, relation string")).distinct()


def paths_from_nodes(g: Graph, anchors: DataFrame) -> DataFrame:
    """node, relation, n: the one-hop relations of each anchor that have a node at their other end, in either direction."""
    out = []
    for cls in classes_in(g, anchors):
        keys = _keys(g, anchors, cls)
        ahead = [(d, {r: c for r, c in cells.items() if any(g.is_class(e.target) for e in g.by_predicate(r) if e.cls == cls)}) for d, cells in _ahead(g, cls, keys)]
        for df, cells in [*((d, c) for d, c in ahead if c), *_back(g, cls, keys, set())]:
            each = df.groupBy("at_").agg(*(F.count(c).alias(f"c{i}") for i, c in enumerate(cells.values())))
            rows = F.explode(F.array(*(F.struct(F.lit(r).alias("relation"), F.col(f"c{i}").alias("n")) for i, r in enumerate(cells))))
            out.append(each.select(_iri(cls, F.col("at_")).alias("node"), rows.alias("r")).select("node", "r.*").filter("n > 0"))
    return _union(out, g.spark.createDataFrame([], "node string, relation string, n long"))


def statement_patterns(g: Graph, cls: str, constants: DataFrame | list[str]) -> DataFrame:
    """The predicates by which nodes of an n-ary class join some constants, one for each, and how many nodes do.

    ``constants`` is a list of IRIs, or a table with a column of IRIs for each place.  Gives the columns p0, p1, …
    in the order of the constants, and n; every permutation of the class's predicates is tried.
    """
    listed = isinstance(constants, list)
    places = range(len(constants) if listed else len(constants.columns))
    own = [e for e in g.edges if e.cls == cls and g.is_class(e.target)]
    out = []
    for chosen in _arrangements(own, len(places)):
        names = [F.lit(e.predicate).alias(f"p{i}") for i, e in enumerate(chosen)]
        df = g.scan(own[0].table, own[0].key)
        if listed:
            keys = [key_of(g, c, e.target) for c, e in zip(constants, chosen, strict=True)]
            if any(k is None for k in keys):
                continue
            hit = df.filter(reduce(lambda a, b: a & b, (g.value(e) == k for e, k in zip(chosen, keys, strict=True))))
        else:
            wanted = constants.distinct()
            for i, (e, c) in enumerate(zip(chosen, constants.columns, strict=True)):
                wanted = wanted.filter(F.startswith(F.col(c), F.lit(f"{NS}{e.target}/"))).withColumn(f"k{i}", F.expr(f"substring(`{c}`, {len(NS + e.target) + 2})").try_cast("bigint"))
            wanted = wanted.select(*(f"k{i}" for i in places))
            hit = df.join(wanted, reduce(lambda a, b: a & b, (g.value(e) == F.col(f"k{i}") for i, e in enumerate(chosen))), "left_semi")
        out.append(hit.agg(F.count("*").alias("n")).select(*names, "n"))
    schema = ", ".join([*(f"p{i} string" for i in places), "n long"])
    return _union(out, g.spark.createDataFrame([], schema)).filter("n > 0")


def _arrangements(items: list, k: int) -> list[tuple]:
    if k == 0:
        return [()]
    return [(x, *rest) for i, x in enumerate(items) for rest in _arrangements(items[:i] + items[i + 1 :], k - 1)]


def normalise_reverse(relations: DataFrame, reverse: DataFrame) -> DataFrame:
    """Relations against their direction as the named inverse, where one is known (relation, reverse)."""
    name = F.regexp_replace("relation", r"^\^", "")
    joined = relations.withColumn("bare_", name).join(reverse.select(F.col("relation").alias("r_"), F.col("reverse").alias("rev_")), F.col("bare_") == F.col("r_"), "left")
    return joined.withColumn("relation", F.when(F.startswith(F.col("relation"), F.lit("^")) & F.col("rev_").isNotNull(), F.col("rev_")).otherwise(F.col("relation"))).drop("bare_", "r_", "rev_")


def without_round_trips(relations: DataFrame) -> DataFrame:
    """Two-hop relations but for those that go there and straight back."""
    first, second = F.split("relation", "/")[0], F.get(F.split("relation", "/"), F.lit(1))
    undone = (F.concat(F.lit("^"), first) == second) | (first == F.concat(F.lit("^"), second))
    return relations.filter(~F.coalesce(undone, F.lit(False)))


def statement_steps(g: Graph, anchors: DataFrame, cls: str, subject: str, main: str) -> DataFrame:
    """relation, n_anchors of paths over statement nodes: a class whose nodes hang on a subject and have one main
    value, the other predicates being qualifiers.

    From a subject ``p:x/ps:x`` and ``p:x/pq:q``; between the values of one statement ``^ps:x/pq:q`` and the like,
    never back to the same predicate; from a value to its subject ``^ps:x/^p:x`` and ``^pq:q/^p:x``.  Where no
    anchor is a subject (or a value), its direct edges stand in, as ``p:e/ps:e`` (``^ps:e/^p:e``).
    """
    own = {e.predicate: e for e in g.edges if e.cls == cls}
    mark = {p: ("ps:" if p == main else "pq:") + p for p in own if p != subject}
    near, direct_near, values, direct_back = [], [], [], []
    for c in classes_in(g, anchors):
        keys = _keys(g, anchors, c)
        for p, e in own.items():
            if e.target != c:
                continue
            if p == subject:
                cells = {f"p:{main}/{mark[q]}": _present(g, own[q]) for q in mark}
            else:
                cells = {f"^{mark[p]}/{mark[q]}": _present(g, own[q]) for q in mark if q != p} | {f"^{mark[p]}/^p:{main}": _present(g, own[subject])}
            (near if p == subject else values).append(_packed(g.scan(e.table, e.key), g.value(e), keys, cells))
        direct_near += [(df, {f"p:{p}/ps:{p}": v for p, v in cells.items()}) for df, cells in _ahead(g, c, keys)]
        direct_back += [(df, {f"^ps:{p[1:]}/^p:{p[1:]}": v for p, v in cells.items()}) for df, cells in _back(g, c, keys, {cls})]

    def rows(parts: list) -> list[tuple[str, int]]:  # as many as the schema has relations; each table is counted once
        return [(r.relation, r.n_anchors) for r in _counted(parts, g.spark).collect()] if parts else []

    onward = rows(values)
    back = [r for r in onward if r[0].endswith(f"/^p:{main}")]
    ways = {"nn": rows(near) or rows(direct_near), "rn": [r for r in onward if r not in back], "rr": back or rows(direct_back)}
    return g.spark.createDataFrame([(way, *r) for way, found in ways.items() for r in found], "way string, relation string, n_anchors long")


def relations_to(g: Graph, anchors: DataFrame, constant: str) -> DataFrame:
    """relation, n_anchors, n_pairs: the relations of one step, or two over an n-ary node, that lead from anchors to a constant.

    The constant is a node's IRI, or a literal whose text is compared.
    """
    over = set(intermediate(g))
    node = constant.startswith(NS)
    lex = constant[1:].rpartition('"')[0] if constant.startswith('"') else constant

    def hit(e: Edge) -> Column | None:
        if g.is_class(e.target) != node:
            return None
        if not node:
            return _text(g, e) == lex
        key = key_of(g, constant, e.target)
        return None if key is None else g.value(e) == key

    parts = []
    for cls in classes_in(g, anchors):
        keys = _keys(g, anchors, cls)
        for e in g.edges:
            if e.cls == cls and hit(e) is not None:
                parts.append((_around(g.scan(e.table, e.key).filter(hit(e)), F.col("key_"), keys), {e.predicate: F.col("at_")}))
            key = key_of(g, constant, e.cls) if node else None
            if e.target == cls and key is not None:
                parts.append((_around(g.scan(e.table, e.key).filter(F.col("key_") == key), g.value(e), keys), {f"^{e.predicate}": F.col("at_")}))
            if e.target == cls and e.cls in over:
                for x in g.edges:
                    if x.cls == e.cls and x.table == e.table and x.predicate != e.predicate and hit(x) is not None:
                        parts.append((_around(g.scan(e.table, e.key).filter(hit(x)), g.value(e), keys), {f"^{e.predicate}/{x.predicate}": F.col("at_")}))
    return _counted(parts, g.spark)


def shared_neighbours(g: Graph, anchors: DataFrame) -> DataFrame:
    """item, label of the named nodes that every anchor has one step, or two over an n-ary node, away."""
    n = anchors.select("node").distinct().count()
    names = [r.relation for r in next_relations(g, anchors).select("relation").collect()]
    objects = {e.predicate for e in g.edges if g.is_class(e.target)}
    steps = [next_items(g, anchors, r) for r in sorted(names) if r.split("/")[-1].startswith("^") or r.split("/")[-1] in objects]
    if not steps:
        return g.spark.createDataFrame([], "item string, label string")
    common = reduce(DataFrame.unionByName, steps).groupBy("item").agg(F.countDistinct("anchor").alias("k")).filter(F.col("k") == n)
    return labels(g, common.select(F.col("item").alias("node"))).filter("label is not null").select(F.col("node").alias("item"), "label")
