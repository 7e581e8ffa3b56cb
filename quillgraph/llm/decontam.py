"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z in lower case, words joined by single spaces, with a
space at both ends.  A window is ``window`` consecutive item words; an item of fewer words is one window.

The automaton holds, between spaces, every short item and of longer ones the grams of just over half a window
that begin at every second half: each window holds one of them whole, so the automaton is about as large as the
items and not ``window`` times as large.  A text is normalised in numpy with a map from its normalised bytes to
its original ones, and scanned once; where a gram occurs, the words around it are compared with the item's, as
far as a window can reach.

The automaton is built once, by a task, and stored in the shared folder, from which each worker loads it.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.llm import text as tx
from quillgraph.llm.runtime import cut, discard, file_system, fresh, held, in_task, prepare, unclash

#: Bytes of benchmark text in one automaton: about 200 MB of memory.  A larger benchmark takes several, each
#: scanned after the other and adding to its hits.
PART_BYTES = 4 << 20


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tx.Words]:
    """Normalised bytes of a group of texts, their offsets, the word at each space, and the words.

    Each word is followed by one space and each text begins with one more.
    """
    low = tx.FOLD[data]
    w = tx.find_words(low, off, tx.ALNUM)
    size = w.ends - w.starts + 1
    place = np.concatenate([[0], np.cumsum(size)])  # of each word, were there no leading spaces
    n_docs = len(off) - 1
    new = place[w.first] + np.arange(n_docs + 1)
    out = np.full(int(new[-1]), 32, np.uint8)
    to = np.repeat(place[:-1] + w.doc() + 1 - w.starts, size - 1)
    take = tx.ALNUM[low]
    src = np.flatnonzero(take)
    out[src + to] = low[src]
    return out, new, place, w


class Matcher:
    """The automaton of some items, a list of (item id, text)."""

    def __init__(self, payload: list[tuple], window: int):
        import ahocorasick

        self.ids = [item for item, _ in payload]
        self.window = window
        self.gram = (window + 1) // 2
        raw = [text.encode() for _, text in payload]
        low, _, _, w = normalise(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        words = [x for x in low.tobytes().decode("latin-1").split(" ") if x]
        self.first, self.hashes = w.first, tx.hash_words(tx.FOLD[np.frombuffer(b"".join(raw), np.uint8)], w)
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            n = self.gram if b - a >= window else b - a
            for q in range(a, b - n + 1, window - self.gram + 1) if n else ():
                found.setdefault(f" {' '.join(words[q : q + n])} ", []).append((i, q))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.grams: list[tuple[int, int, list[tuple[int, int]]]] = []
        for g, places in found.items():
            self.machine.add_word(g, len(self.grams))
            self.grams.append((len(g), g.count(" ") - 1, places))
        if found:
            self.machine.make_automaton()

    def scan(self, data: np.ndarray, off: np.ndarray, norm: np.ndarray, new_off: np.ndarray, place: np.ndarray, w: tx.Words):
        """(text, first word, end word, item) of each run of words that windows of an item cover."""
        if not self.grams:
            return
        reach, at_hand = self.window - self.gram, -1
        for end, k in self.machine.iter(norm.tobytes().decode("latin-1")):
            size, n, places = self.grams[k]
            at = end - size + 1
            d = int(np.searchsorted(new_off, at, "right")) - 1
            first = int(np.searchsorted(place, at - d))  # the word after this space
            for i, q in places:
                a, b = int(self.first[i]), int(self.first[i + 1])
                if b - a < self.window:
                    yield d, first, first + n, i
                    continue
                if d != at_hand:  # words are hashed only of texts with hits
                    at_hand, begin, stop = d, int(w.first[d]), int(w.first[d + 1])
                    own = tx.Words(w.starts[begin:stop] - off[d], w.ends[begin:stop] - off[d], np.array([0, stop - begin]))
                    hashes = tx.hash_words(tx.FOLD[data[off[d] : off[d + 1]]], own)
                at_word = first - begin
                back, ahead = min(reach, q - a, at_word), min(reach, b - q - n, stop - first - n)
                left = _same(hashes[at_word - back : at_word][::-1], self.hashes[q - back : q][::-1])
                right = _same(hashes[at_word + n : at_word + n + ahead], self.hashes[q + n : q + n + ahead])
                if left + n + right >= self.window:
                    yield d, first - left, first + n + right, i


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two arrays have in common from their beginning on."""
    other = np.flatnonzero(a != b)
    return int(other[0]) if len(other) else len(a)


def _load(path: str) -> Matcher:
    fs, place = file_system(path)
    with fs.open_input_stream(place, compression=None) as f:
        return pickle.loads(f.read())


def store_automata(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list[str]:
    """Builds the automata of a benchmark in tasks; gives their files, one for each PART_BYTES of text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    where = fresh(spark, "automata")

    def build(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, item, text in zip(*(batch.column(c).to_pylist() for c in ("part", "item", "text")), strict=True):
                held.setdefault(part, []).append((item, text))
        for rows in held.values():
            fs, base = file_system(where)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.automaton"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(pickle.dumps(Matcher(rows, window)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{where}/{name}"])], names=["path"])

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts))).select("part", "item", "text").repartition("part")
    made = cut(dealt.mapInArrow(in_task(build), "path string"), "automata-list")
    paths = sorted(r.path for r in made.collect())  # one row for each part
    discard(made)
    return paths


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default: all), then ``n_words``, ``n_hit``,
    ``n_items``, ``items`` (array of item ids in the order of their strings) and ``hits`` (array of
    structs start, end: byte spans in the UTF-8 of the original text, maximal runs of hit words).

    Null texts have no words; items with a null id or text are left out; repeated items count once;
    repeated rows are judged each for itself.  A new column whose name is taken gets underscores.
    """
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    docs = docs.select(*{c: None for c in [*keep, text_col]})
    extra = [c for c in docs.columns if c not in keep]
    names = unclash(docs, "n_words", "n_hit", "n_items", "items", "hits")
    final = unclash(docs.select(*keep), "n_words", "n_hit", "n_items", "items", "hits")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(benchmark.schema[item_id].dataType), span]
    out = docs
    for i, path in enumerate(store_automata(benchmark, item_id, item_text, window) or [None]):
        out = _scan(out, text_col, [*keep, *extra], dict(zip(names, kinds, strict=True)), path, i > 0)
    return out.select(*keep, *(F.col(n).alias(f) for n, f in zip(names, final, strict=True)))


def _scan(docs: DataFrame, text_col: str, through: list[str], new: dict[str, T.DataType], path: str | None, again: bool) -> DataFrame:
    """Adds the hits of a stored automaton to each row, and to those of earlier ones if ``again``."""
    names = list(new)
    schema = T.StructType([docs.schema[c] for c in through] + [T.StructField(n, k) for n, k in new.items()])
    arrow = [to_arrow_type(k) for k in new.values()]

    def judge(data, off, before):
        norm, new_off, place, w = normalise(data, off)
        n_docs = len(off) - 1
        delta = np.zeros(len(w.starts) + 1, np.int64)
        items: dict[int, set] = {}
        for d, (old_items, old_spans) in enumerate(before):
            if old_items:
                items[d] = set(old_items)
            for x in old_spans or ():
                delta[np.searchsorted(w.starts, off[d] + x["start"])] += 1
                delta[np.searchsorted(w.starts, off[d] + x["end"])] -= 1
        if path is not None:
            m = held(path, lambda: _load(path))  # once for each Python worker
            for d, first, end, i in m.scan(data, off, norm, new_off, place, w):
                delta[first] += 1
                delta[end] -= 1
                items.setdefault(d, set()).add(m.ids[i])
        hit = np.cumsum(delta[:-1]) > 0
        n_hit = np.bincount(w.doc()[hit], minlength=n_docs)
        rows = []
        for d, n_words in enumerate(w.counts.tolist()):
            spans = []
            if d in items:
                a, b = w.first[d], w.first[d + 1]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]]))).reshape(-1, 2)
                spans = [{"start": int(w.starts[a + s] - off[d]), "end": int(w.ends[a + e - 1] - off[d])} for s, e in edges]
            rows.append((n_words, int(n_hit[d]), len(items.get(d, ())), sorted(items.get(d, ()), key=str), spans))
        return rows

    def run(batches):
        for batch in batches:
            rows = []
            for lo, hi, data, off in tx.rounds(batch.column(text_col)):
                before = zip(*(batch.column(c).slice(lo, hi - lo).to_pylist() for c in names[3:]), strict=True) if again else ()
                rows += judge(data, off, before)
            if rows:
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in through] + cols, names=[*through, *names])

    return docs.mapInArrow(in_task(run, path), schema)


def is_contaminated(n_hit, n_words, share: int = 20):
    """At least one word in ``share`` is hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int | None = None, **how) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with its own columns alone.

    A leaked passage spoils a long document as well as a short one, so any hit drops the row; with
    ``share`` only rows go of whose words at least one in ``share`` is hit.  Null and empty texts stay;
    repeated rows are judged each for itself; an empty benchmark drops nothing.
    """
    columns = docs.columns
    found = contamination(docs, benchmark, text_col, **how)
    n_words, n_hit = found.columns[len(columns) : len(columns) + 2]
    gone = F.col(n_hit) > 0 if share is None else is_contaminated(F.col(n_hit), F.col(n_words), share)
    return found.filter(~gone).select(*columns)


def items_digest(items: list) -> str:
    return hashlib.sha256(",".join(map(str, items)).encode()).hexdigest()
