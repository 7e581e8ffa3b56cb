"""Decomposed questions: trees of sub-questions, read from JSON.

A decomposition is a list of parts; a part has a ``description`` and, under tags like ``<IQ1>``, the lists
of the sub-questions that its description names.  Descriptions side by side are one question.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tags that stand for sub-questions (fixed values), and that of the whole question.
TAG = re.compile(r"<(IQ|iq)[1-5]>")
ROOT = "<OUTQ>"


@dataclass
class SubQuestion:
    tag: str
    text: str
    children: list[SubQuestion] = field(default_factory=list)
    parent: SubQuestion | None = None

    def walk(self) -> Iterator[SubQuestion]:
        """This question and all below it, level by level."""
        level = [self]
        while level:
            yield from level
            level = [c for n in level for c in n.children]

    def variable(self) -> str:
        return self.tag.strip("<>")


def read_tree(decomposition: str | list | None, question: str) -> SubQuestion:
    """The tree of a decomposition; the question alone where it cannot be read."""

    def build(parts: list[dict], tag: str, parent: SubQuestion | None) -> SubQuestion:
        node = SubQuestion(tag, ", ".join(p["description"] for p in parts), parent=parent)
        below = {k: v for p in parts for k, v in p.items() if k != "description"}
        node.children = [build(v, k, node) for k, v in below.items()]
        return node

    try:
        parts = json.loads(decomposition) if isinstance(decomposition, str) else decomposition
        if not parts:
            raise ValueError("nothing to read")
        return build(parts, ROOT, None)
    except (ValueError, TypeError, KeyError, AttributeError):
        return SubQuestion(ROOT, question)


def shrink(node: SubQuestion) -> SubQuestion:
    """Puts a sub-question back into the one above it, which takes its text and its sub-questions; gives that one."""
    up = node.parent
    if up is None:
        raise ValueError("the whole question has none above it")
    at = up.children.index(node)
    up.children[at : at + 1] = node.children
    for c in node.children:
        c.parent = up
    up.text = up.text.replace(node.tag, node.text)
    return up


def branches(decomposition: str | list | None) -> list[list[str]]:
    """The descriptions from each part of the decomposition down to each of its leaves."""
    try:
        parts = json.loads(decomposition) if isinstance(decomposition, str) else decomposition
    except ValueError:
        return []

    def down(part: dict, above: list[str]) -> list[list[str]]:
        here = [*above, part["description"]]
        below = [b for tag, kids in part.items() if TAG.fullmatch(tag) for kid in kids for b in down(kid, here)]
        return below or [here]

    return [b for part in parts or [] for b in down(part, [])]


def branches_column(decomposition: Column) -> Column:
    """:func:`branches` of a column of JSON texts."""

    @F.arrow_udf("array<array<string>>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([branches(t) for t in texts.to_pylist()], pa.list_(pa.list_(pa.string())))

    return split(decomposition)


def sub_questions(rows: DataFrame, qid: str, question: str, decomposition: str) -> DataFrame:
    """qid, position, tag, parent, text of every sub-question, level by level; the whole question has no parent."""
    shape = "array<struct<position:int,tag:string,parent:string,text:string>>"
    kind = pa.list_(pa.struct([("position", pa.int32()), ("tag", pa.string()), ("parent", pa.string()), ("text", pa.string())]))

    @F.arrow_udf(shape)
    def nodes(texts: pa.Array, questions: pa.Array) -> pa.Array:
        trees = [read_tree(t, q or "") for t, q in zip(texts.to_pylist(), questions.to_pylist(), strict=True)]
        return pa.array([[{"position": i, "tag": n.tag, "parent": n.parent.tag if n.parent else None, "text": n.text} for i, n in enumerate(t.walk())] for t in trees], kind)

    return rows.select(qid, F.explode(nodes(decomposition, question)).alias("n")).select(qid, "n.*")
