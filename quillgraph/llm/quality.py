"""Repetition rules: how much of a text lies inside n-grams and lines that it repeats.

Rolling hashes of several n-gram lengths are taken over the words of many texts at once in numpy.  A
window is repeated when its hash occurs at two or more places of the same text; what counts is the share of the
text's characters that windows after the first cover, so overlapping windows are not counted twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgraph.llm import text as tx
from quillgraph.llm.runtime import in_task, prepare, unclash

_NEWLINE = tx.byte_class(b"\n")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "dup_line_chars", "n_chars_counted",
)


@dataclass(frozen=True)
class RepetitionRules:
    """Upper bounds on shares of a text's characters or lines, and on symbols a word; the usual published values.

    The covered shares leave out the first copy of what repeats.
    """

    base_n: int = 3
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    covered: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    dup_lines: float = 0.30
    dup_line_chars: float = 0.20
    symbols_per_word: float = 0.10
    min_words: int = 50


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which keys occur more than once; for each run of equal keys its first place, and its length."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(k)))
    many = np.zeros(len(k), bool)
    many[order] = np.repeat(size > 1, size)
    return many, order[begin], size


def measure(data: np.ndarray, off: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts and the largest share found for each rule, for every text of a group."""
    n_docs = len(off) - 1
    w = tx.find_words(data, off, tx.SPACED)
    per = w.counts
    doc, room, h = w.doc(), w.room(), tx.hash_words(data, w)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[w.ends] - points[w.starts]
    by_doc = lambda of, value: np.bincount(of, value, n_docs).astype(np.int64)
    total = by_doc(doc, chars)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])

    out = {"n_words": per, "word_chars": total, "n_symbols": symbols[off[1:]] - symbols[off[:-1]]}
    salt = tx.mix(doc.astype(tx.U) + tx.U(1))
    at = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=at[1:])
    floor = np.maximum(total, 1)
    excess = np.zeros(n_docs)  # the largest of share / bound

    def windows(n: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of repeated n-word windows, out of the places ``among``: all of them, and all but the first."""
        among = among[room[among] >= n]
        many, place, size = _repeated(tx.mix(grams[n][among] ^ salt[among]))
        later = many.copy()
        later[place] = False
        if n in rules.top and len(among):
            head, size = among[place[size > 1]], size[size > 1]
            best = np.zeros(n_docs)
            np.maximum.at(best, doc[head], size * (at[head + n] - at[head]))
            np.maximum(excess, best / floor / rules.top[n], out=excess)
        return among[many], among[later]

    def cover(n: int, starts: np.ndarray) -> np.ndarray:
        delta = np.zeros(len(doc) + 1, np.int64)
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + n, -1)
        return np.cumsum(delta[:-1]) > 0

    lengths = sorted({rules.base_n, *rules.top, *rules.covered})
    grams = {n: tx.gram_hash(h, n) for n in lengths if len(h)} or {n: h for n in lengths}
    # a longer window repeats only where each shorter one that starts there does
    places = np.arange(len(doc))
    for n in lengths:
        places, later = windows(n, places)
        if n == rules.base_n:
            out["n_repeat_words"] = by_doc(doc[cover(n, places)], None)
        if n in rules.covered:
            inside = cover(n, later)
            np.maximum(excess, by_doc(doc[inside], chars[inside]) / floor / rules.covered[n], out=excess)

    lines = tx.find_words(data, off, _NEWLINE)
    worded = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    line_doc, line_hash = lines.doc()[worded], tx.hash_words(data, lines)[worded]
    line_chars = (points[lines.ends] - points[lines.starts])[worded]
    _, place, _ = _repeated(tx.mix(line_hash ^ tx.mix(line_doc.astype(tx.U) + tx.U(7))))
    again = np.ones(len(line_doc), bool)
    again[place] = False  # the first of each run of equal lines: the sort is stable
    out["n_lines"] = by_doc(line_doc, None)
    out["n_dup_lines"] = by_doc(line_doc[again], None)
    out["dup_line_chars"] = by_doc(line_doc[again], line_chars[again])
    out["n_chars_counted"] = by_doc(line_doc, line_chars)
    np.maximum(excess, out["n_dup_lines"] / np.maximum(out["n_lines"], 1) / rules.dup_lines, out=excess)
    np.maximum(excess, out["dup_line_chars"] / np.maximum(out["n_chars_counted"], 1) / rules.dup_line_chars, out=excess)
    np.maximum(excess, out["n_symbols"] / np.maximum(per, 1) / rules.symbols_per_word, out=excess)

    out["base_failed"] = (per < rules.min_words) | (100 * out["n_repeat_words"] > 50 * per)
    out["excess"] = excess
    out["kept"] = ~out["base_failed"] & (excess <= 1)
    return out


def score(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default: all) and the measures.

    Null and empty texts have no words and fail the base rules.  Repeated rows are judged each for
    itself.  A measure whose name is taken gets trailing underscores.  Every text is measured whole.
    """
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    docs = docs.select(*{c: None for c in [*keep, text_col]})
    names = [*MEASURES, "base_failed", "excess", "kept"]
    kinds = {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "excess": T.DoubleType()}
    final = unclash(docs.select(*keep), *names)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f, kinds.get(n, T.LongType())) for n, f in zip(names, final, strict=True)])

    def run(batches):
        for batch in batches:
            parts = [measure(data, off, rules) for _, _, data, off in tx.rounds(batch.column(text_col))]
            if parts:
                cols = [pa.array(np.concatenate([p[n] for p in parts])) for n in names]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cols, names=[*keep, *final])

    return docs.mapInArrow(in_task(run), schema)


def filter_quality(docs: DataFrame, text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns alone.

    Null, empty and blank texts fail the base rules and go; rows that repeat are judged each for itself; an
    empty table stays one; names of columns do not matter.
    """
    columns = docs.columns
    scored = score(docs, text_col, rules=rules)
    kept = scored.columns[-1]
    return scored.filter(scored[kept]).select(*columns)
