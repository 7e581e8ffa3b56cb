"""Construction of queries along a question's decomposition, from its answers.

The sub-questions are taken from the top down.  Each extends the graphs found so far at its own variable:
skeletons lead to the variables of its sub-questions, constants are attached to them, to their middle nodes,
and comparisons last.  A graph stays while it has every answer; candidates of a step are judged together by
one DataFrame.  A sub-question that has no graph is put back into the one above it, and the search begins anew.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as words
from quillgraph.operators import explore, synthesis
from quillgraph.operators.questions import SubQuestion, read_tree, shrink
from quillgraph.plans import ast as A
from quillgraph.plans.compiler import Engine
from quillgraph.plans.querygraph import QueryGraph, path_edges
from quillgraph.sources.registry import NS

#: (text, candidates, k) -> the k candidates most like the text, best first.
Ranker = Callable[[str, list[str], int], list[str]]


@dataclass(frozen=True)
class TreeParams:
    """Limits of the search; these are its features, not limits on data."""

    sample_answers: int = 3
    skeleton_relations: int = 5
    constant_relations: int = 3
    compared_relations: int = 3
    neighbours: int = 5
    use_neighbours: bool = False
    max_degree: int = 3
    max_edges: int = 6
    graphs_inner: int = 20
    graphs_leaf: int = 10
    results: int = 10
    operators: tuple[str, ...] = (">=", ">", "<=", "<")


def by_words(text: str, candidates: list[str], k: int) -> list[str]:
    """The candidates whose words are most like a text's, by cosine; equal ones in the order of their text."""
    count = lambda t: Counter(w for w in re.findall(r"[a-z0-9]+", t.lower()) if w not in words.STOP_WORDS)
    own = count(text)

    def like(c: str) -> float:
        other = count(c)
        dot = sum(own[w] * n for w, n in other.items())
        return dot / math.sqrt(sum(n * n for n in own.values()) * sum(n * n for n in other.values())) if dot else 0.0

    return sorted(dict.fromkeys(candidates), key=lambda c: (-like(c), c))[:k]


def rank_graphs(graphs: list[QueryGraph], text: str, labels: dict[str, str], k: int, rank: Ranker = by_words) -> list[QueryGraph]:
    """The k graphs whose naturalised text is most like a question."""
    by_text: dict[str, QueryGraph] = {}
    for g in graphs:
        by_text.setdefault(g.naturalised(labels), g)
    return [by_text[t] for t in rank(text, list(by_text), k)]


def skeletons(center: str, targets: list[str], relations: list[list[str]]) -> list[QueryGraph]:
    """Graphs with a relation from the centre to each target: every choice of one of each target's relations."""
    out = []
    for chosen in itertools.product(*relations):
        edges = [e for i, (t, r) in enumerate(zip(targets, chosen, strict=True)) for e in path_edges(center, r, t, f"{center}_s{i}")]
        out.append(QueryGraph(center, edges))
    return out


def constant_structures(center: str, relations: dict[str, list[str]]) -> tuple[list[QueryGraph], list[QueryGraph]]:
    """(graphs of one constant, graphs of two constants at one middle node) from each constant's relations."""
    mid = f"{center}_m"
    single = [QueryGraph(center, path_edges(center, r, c, mid)) for c, rs in relations.items() for r in rs]
    double = []
    for c, d in itertools.combinations(relations, 2):
        for r, s in itertools.product(relations[c], relations[d]):
            if "/" in r and "/" in s and r.split("/")[0] == s.split("/")[0]:
                double.append(QueryGraph(center, list(dict.fromkeys(path_edges(center, r, c, mid) + path_edges(center, s, d, mid)))))
    return single, double


def without_redundant_types(search: TreeSearch, graphs: list[QueryGraph]) -> list[QueryGraph]:
    """Graphs without their classes where these change nothing in their F1."""
    bare = [replace(g, types={}) for g in graphs]
    with_, without = search.scores(graphs), search.scores(bare)
    return [b if g.types and g.edges and math.isclose(x[2], y[2]) else g for g, b, x, y in zip(graphs, bare, with_, without, strict=True)]


class TreeSearch:
    """One question: its answers, its linked items (constant: label) and classes."""

    def __init__(self, engine: Engine, question: str, answers: DataFrame, items: dict[str, str], classes: list[str] = (), rank: Ranker = by_words, params: TreeParams = TreeParams()):
        self.engine, self.graph, self.spark = engine, engine.graph, engine.graph.spark
        self.question, self.answers, self.items, self.classes = question, answers.toDF("answer"), dict(items), list(classes)
        self.rank, self.params = rank, params
        self.sample = [r.node for r in explore.sample_nodes(self.answers, params.sample_answers).collect()]
        self.triggers = set(self.spark.createDataFrame([(question,)], "q string").select(words.numeral_triggers(F.col("q")).alias("t")).first().t)
        self.special = {r.predicate: r.special for r in explore.special_type(self.graph).collect()}

    # ---- judging
    def scores(self, graphs: list[QueryGraph]) -> list[tuple[float, float, float]]:
        """(precision, recall, f1) of each graph, in one aggregation."""
        if not graphs:
            return []
        rows = {r.id: (r.precision, r.recall, r.f1) for r in synthesis.scored(synthesis.hits(self.engine, dict(enumerate(graphs)), self.answers)).collect()}
        return [rows[i] for i in range(len(graphs))]

    def legal(self, graphs: list[QueryGraph], previous: QueryGraph | None) -> list[bool]:
        """Whether each graph, joined to what was found before, still has every answer."""
        whole = [self.joined(previous, g) for g in graphs]
        some = [w for w in whole if w.size() or w.types]
        found = iter(self.scores(some))
        return [synthesis.is_legal(*next(found)[:2]) if w.size() or w.types else True for w in whole]

    @staticmethod
    def joined(previous: QueryGraph | None, graph: QueryGraph) -> QueryGraph:
        return graph if previous is None else previous.attach(graph, graph.center)

    # ---- neighbourhood
    def anchors(self, previous: QueryGraph | None, center: str) -> DataFrame:
        """node, grp: for each sampled answer (its place) the nodes that the centre can be."""
        rows = self.spark.createDataFrame([(a, i) for i, a in enumerate(self.sample)], "node string, grp int")
        if previous is None:
            return rows
        x, y = A.Var(previous.center), A.Var(center)
        given = A.Values((x,), tuple((A.Iri(a),) for a in self.sample))
        found = self.engine.sparql(A.Query("SELECT", A.Group((given, *previous.group().parts)), (A.Projected(x, x), A.Projected(y, y)), distinct=True))
        found = found.select(F.col(previous.center).alias("a_"), F.col(center).cast("string").alias("to_"))
        return found.join(F.broadcast(rows.toDF("from_", "grp")), F.col("a_") == F.col("from_")).select(F.col("to_").alias("node"), "grp")

    def common(self, relations: DataFrame) -> list[str]:
        """The relations that every sampled answer has."""
        return sorted(r.relation for r in explore.common_relations(relations, len(self.sample)).collect()) if self.sample else []

    def kind(self, relation: str) -> str:
        last = relation.split("/")[-1]
        if last.startswith("^") or any(self.graph.is_class(e.target) for e in self.graph.by_predicate(last)):
            return "NODE"
        return self.special.get(last, "NORMAL")

    # ---- one sub-question
    def extend(self, sub: SubQuestion, previous: QueryGraph | None) -> list[QueryGraph]:
        """The graphs around a sub-question's variable that, joined to the previous one, have every answer."""
        p, center, text = self.params, sub.variable(), f"{sub.tag} is {sub.text}"
        targets = [c.variable() for c in sub.children]
        near = self.anchors(previous, center)
        relations = self.common(explore.next_relations(self.graph, near))
        nodes = [r for r in relations if self.kind(r) == "NODE"]
        bones = skeletons(center, targets, [self.rank(text, nodes, p.skeleton_relations) for _ in targets])
        if previous is None and self.classes:
            typed = [QueryGraph(center, [], types={center: [c]}) for c in self.classes]
            usable = [g.types for g, ok in zip(typed, self.legal(typed, None), strict=True) if ok]
            bones = [replace(b, types=usable[0]) for b in bones] if usable else bones
        reach = self.reachable(near, text, leaf=not targets)
        single, double = constant_structures(center, reach)
        good = [b for b, ok in zip(bones, self.legal(bones, previous), strict=True) if ok]
        out = [*good, *self.attached(good, double + single, previous)]
        out += self.at_middles(out, [g for g in single if g.middle_nodes()], previous)
        if "COMPARE" in self.triggers:
            out += self.compared(out, relations, text, previous)
        if not targets:
            out = [g for g in out if g.size() or g.types]
        return rank_graphs(out, text, self.items, p.graphs_inner if targets else p.graphs_leaf, self.rank)

    def reachable(self, near: DataFrame, text: str, leaf: bool) -> dict[str, list[str]]:
        """The best relations to each linked item that all sampled answers reach; at a leaf also to neighbours whose label the text names."""
        items = dict(self.items)
        if leaf and self.params.use_neighbours:
            shared = [explore.shared_neighbours(self.graph, near.filter(F.col("grp") == i).select("node")) for i in range(len(self.sample))]
            sets = [{(r.item, r.label) for r in s.filter(words.has_token_overlap(F.col("label"), F.lit(text))).collect()} for s in shared]
            found = dict(set.intersection(*sets)) if sets else {}
            best = set(self.rank(text, list(found.values()), self.params.neighbours))
            items |= {i: label for i, label in found.items() if label in best}
            self.items |= items
        out = {}
        for c in items:
            relations = self.common(explore.relations_to(self.graph, near, c))
            if relations:
                out[c] = self.rank(text, relations, self.params.constant_relations)
        return out

    def attached(self, bones: list[QueryGraph], structures: list[QueryGraph], previous: QueryGraph | None) -> list[QueryGraph]:
        """The bones with sets of structures, by size; sets that hold one that is illegal for the bone are not tried."""
        illegal: dict[int, list[frozenset[int]]] = {i: [] for i in range(len(bones))}
        degrees = [sum(b.center in e[1:] for e in b.edges) for b in bones]
        out = []
        for size in range(1, self.params.max_degree - min(degrees, default=0) + 1):
            sets = [frozenset(s) for s in itertools.combinations(range(len(structures)), size)]
            tried = [(i, s) for i in range(len(bones)) if degrees[i] + size <= self.params.max_degree for s in sets if not any(bad <= s for bad in illegal[i])]
            graphs = []
            for i, s in tried:
                g = bones[i]
                for k in sorted(s):
                    g = g.attach(structures[k])
                graphs.append(g)
            for (i, s), g, ok in zip(tried, graphs, self.legal(graphs, previous), strict=True):
                if not ok:
                    illegal[i].append(s)
                elif len(g.edges) <= self.params.max_edges:
                    out.append(g)
        return out

    def at_middles(self, graphs: list[QueryGraph], structures: list[QueryGraph], previous: QueryGraph | None) -> list[QueryGraph]:
        """The graphs with a structure's constant at one of their own middle nodes."""
        made = [m for g in graphs for s in structures if (m := g.at_middle(s)) is not None and len(m.edges) <= self.params.max_edges]
        return [m for m, ok in zip(made, self.legal(made, previous), strict=True) if ok]

    def compared(self, graphs: list[QueryGraph], relations: list[str], text: str, previous: QueryGraph | None) -> list[QueryGraph]:
        """The graphs with a comparison of a number or a time with a linked literal."""
        literals = [c for c in self.items if not c.startswith(NS)]
        made = []
        for kind in ("QUANTITY", "TEMPORAL"):
            best = self.rank(text, [r for r in relations if self.kind(r) == kind], self.params.compared_relations)
            timed = [c for c in literals if bool(re.match(r'^"?\d{4}(-|"|$)', c)) or kind == "QUANTITY"]
            made += [g.compared(r, op, c) for g in graphs if g.size() or g.types for r, c, op in itertools.product(best, timed, self.params.operators)]
        return [m for m, ok in zip(made, self.legal(made, previous), strict=True) if ok]

    # ---- the whole question
    def run(self, decomposition: str | list | None) -> list[tuple[QueryGraph, float]]:
        """(graph, f1) of the best graphs: those that have the answers and no others, else those of the highest F1."""
        tree = read_tree(decomposition, self.question)
        while True:
            graphs, failed = self.down(tree)
            final = [g for g in graphs if g.arg or g.comparisons or any(x.startswith((NS, '"')) for e in g.edges for x in e[1:])]
            if "ARG" in self.triggers and final:
                numeric = [r for r in self.common(explore.next_relations(self.graph, self.anchors(None, tree.variable()))) if self.kind(r) in ("QUANTITY", "TEMPORAL") and "/" not in r]
                final += [replace(g, arg=(r, g.center, most)) for g, r, most in itertools.product(final, numeric, (True, False))]
            f1 = [s[2] for s in self.scores(final)]
            best = max(f1, default=0.0)
            if math.isclose(best, 1) or failed is None:
                break
            shrink(failed)
        top = without_redundant_types(self, [g for g, f in zip(final, f1, strict=True) if math.isclose(f, best)]) if best else []
        return [(g, best) for g in rank_graphs(top, self.question, self.items, self.params.results, self.rank)]

    def down(self, tree: SubQuestion) -> tuple[list[QueryGraph], SubQuestion | None]:
        """The graphs after the last sub-question, and the sub-question to put back should they not do."""
        previous: list[QueryGraph | None] = [None]
        last = tree
        for sub in tree.walk():
            last = sub
            previous = [self.joined(g, more) for g in previous for more in self.extend(sub, g)]
            if not previous:
                break
        return previous, None if last.parent is None else last


def search(engine: Engine, question: str, answers: DataFrame, items: dict[str, str], classes: list[str] = (), decomposition: str | list | None = None, rank: Ranker = by_words, params: TreeParams = TreeParams()) -> DataFrame:
    """position, query, text, f1 of the best queries of a question."""
    found = TreeSearch(engine, question, answers, items, classes, rank, params).run(decomposition)
    rows = [(i, g.key(), g.naturalised(items), f1) for i, (g, f1) in enumerate(found)]
    return engine.graph.spark.createDataFrame(rows, "position int, query string, text string, f1 double")
