"""Stupid-backoff language-model scores of every document against the rest of the corpus.

S(w | h) = f(h w) / f(h) where the n-gram h w occurs outside the document, else alpha * S(w | shorter h);
f are counts over all documents less those of the document itself, or each text would be known to its own
model.  Relationally:

* documents are dealt into blocks; a block's distinct n-grams of each order, with their counts, are packed
  into rows by hash: one for each of FAN ranges, so a frequent n-gram is one entry a block;
* where the corpus needs more ranges than that, the rows of one range and of FAN neighbouring blocks are
  joined and dealt over FAN smaller ranges, and so on: at every level a row holds thousands of n-grams,
  and rows grow in number with the corpus alone;
* the rows of a final range together are that part of the n-gram count table: totals by hash, summed;
* the totals go back the same way, in the order of the n-grams, to the blocks that asked, and are joined to
  the exploded n-grams there; logarithms are summed for each document.

Blocks and ranges grow in number with the corpus, not in size.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as tx
from quillgraph.llm.runtime import prepare

#: Bytes of text in a block, and n-grams of all blocks in a final range (about).
BLOCK_BYTES = 8 << 20
BUCKET_GRAMS = 2 << 20
#: Bits of the ranges into which one level divides; blocks are joined by as many.
FAN_BITS = 8
#: Bits of a hash that are kept below its final range.
REST_BITS = 40
#: Count that a word has which occurs in no other document.
FLOOR = 0.5


def _codes(texts: pa.ChunkedArray | pa.Array, order: int, bits: int):
    """For each order 1..n: (document, hash of so many bits) arrays of all n-grams; and the words of each document."""
    docs, grams, counts = [[] for _ in range(order)], [[] for _ in range(order)], []
    for lo, _hi, data, off in tx.rounds(texts):
        w = tx.find_words(data, off, tx.SPACED)
        counts.append(w.counts)
        if not len(w.starts):
            continue
        h, doc, room = tx.hash_words(data, w), w.doc() + lo, w.room()
        for n in range(1, order + 1):
            ok = room >= n
            docs[n - 1].append(doc[ok])
            grams[n - 1].append((tx.gram_hash(h, n) if n > 1 else h)[ok] >> tx.U(64 - bits))
    join = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
    return [(join(d, np.int64), join(g, tx.U)) for d, g in zip(docs, grams, strict=True)], join(counts, np.int64)


_ROW = pa.schema([("prefix", pa.int64()), ("grp", pa.int64()), ("n", pa.int32()), ("blocks", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ROW_DDL = "prefix long, grp long, n int, blocks binary, sizes binary, hashes binary, counts binary"


def pack(values: np.ndarray, first: np.ndarray) -> bytes:
    """Ascending runs of unsigned integers, which begin at ``first``, as differences of as few bytes as they need."""
    diff = values.copy()
    diff[1:] -= values[:-1]
    diff[first] = values[first]
    width = max(1, (int(diff.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(diff).view(np.uint8).reshape(-1, 8)[:, :width].T
    top = zlib.compress(np.ascontiguousarray(planes[-1]).tobytes(), 1)  # the other bytes are as good as random
    return bytes([width]) + len(top).to_bytes(4, "little") + top + np.ascontiguousarray(planes[:-1]).tobytes()


def unpack(raw: bytes, sizes: np.ndarray) -> np.ndarray:
    """The values of :func:`pack`, given the length of each run."""
    n = int(sizes.sum())
    width, end = raw[0], 5 + int.from_bytes(raw[1:5], "little")
    diff = np.zeros((n, 8), np.uint8)
    diff[:, width - 1] = np.frombuffer(zlib.decompress(raw[5:end]), np.uint8)
    diff[:, : width - 1] = np.frombuffer(raw, np.uint8, offset=end).reshape(width - 1, n).T
    diff = diff.view(tx.U).reshape(-1)
    total = np.cumsum(diff, dtype=tx.U)
    first = np.cumsum(sizes) - sizes
    return total - np.repeat(total[first[sizes > 0]] - diff[first[sizes > 0]], sizes[sizes > 0])


def _numbers(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype("<u4" if int(a.max(initial=0)) < 1 << 32 else "<u8").tobytes(), 1)


def _read_numbers(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8").astype(np.int64)


def _batches(rows: list[tuple], schema: pa.Schema):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _row(prefix: int, grp: int, n: int, blocks: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple:
    return (prefix, grp, n, blocks.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), pack(hashes, (np.cumsum(sizes) - sizes)[sizes > 0]), _numbers(counts))


def _ask(bits: int, whole: int, order: int):
    """Rows of a block's distinct n-grams, by hashes of ``whole`` bits, one for each of 2**bits ranges; a partition comes sorted by block."""

    def block_rows(block: int, texts: pa.Array):
        coded, _ = _codes(texts, order, whole)
        for n, (_, g) in enumerate(coded, 1):
            distinct, count = np.unique(g, return_counts=True)
            rest = tx.U(whole - bits)
            edges = np.append(np.searchsorted(distinct, np.arange(1 << bits, dtype=tx.U) << rest), len(distinct))
            one = np.array([block])
            rows = [_row(p, block, n, one, np.array([e - s]), distinct[s:e] & ((tx.U(1) << rest) - tx.U(1)), count[s:e]) for p, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if e > s]
            yield from _batches(rows, _ROW)

    def run(batches):
        yield from _per_block(batches, block_rows)

    return run


def _deal(batches, bits: int, rest: int):
    """Joins the rows of one range, order and parent group, sorted by (prefix, parent, n, grp), and deals them over 2**bits smaller ranges."""
    for (prefix, parent, n), rows in groupby(_tuples(batches), lambda r: (r[0], r[7], r[2])):
        blocks, sizes, hashes, counts = [], [], [], []
        for r in rows:
            size = np.frombuffer(r[4], "<i4")
            blocks.append(np.frombuffer(r[3], "<i8"))
            sizes.append(size)
            hashes.append(unpack(r[5], size))
            counts.append(_read_numbers(r[6], int(size.sum())))
        blocks, sizes, hashes, counts = (np.concatenate(c) for c in (blocks, sizes, hashes, counts))
        low = tx.U(rest - bits)
        at = (hashes >> low).astype(np.int64)
        run = np.repeat(np.arange(len(blocks)), sizes)
        order = np.argsort(at, kind="stable")  # within a range still by block, ascending
        edges = np.searchsorted(at[order], np.arange((1 << bits) + 1))
        out = []
        for p in np.flatnonzero(np.diff(edges)).tolist():
            mine = order[edges[p] : edges[p + 1]]
            size = np.bincount(run[mine], minlength=len(blocks))
            out.append(_row((prefix << bits) | p, parent, n, blocks[size > 0], size[size > 0], hashes[mine] & ((tx.U(1) << low) - tx.U(1)), counts[mine]))
        yield from _batches(out, _ROW)


def _tuples(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_BACK = pa.schema([("prefix", pa.int64()), ("grp", pa.int64()), ("n", pa.int32()), ("blocks", pa.binary()), ("sizes", pa.binary()), ("totals", pa.binary())])
_BACK_DDL = "prefix long, grp long, n int, blocks binary, sizes binary, totals binary"


def _total(batches):
    """Adds up the rows of each (prefix, n), which come sorted, and answers each with the totals of its n-grams."""
    for (prefix, n), rows in groupby(_tuples(batches), lambda r: (r[0], r[2])):
        held = [(r[1], r[3], r[4], np.frombuffer(r[4], "<i4"), r[5], r[6]) for r in rows]
        hashes = np.concatenate([unpack(h, size) for _, _, _, size, h, _ in held])
        counts = np.concatenate([_read_numbers(c, int(size.sum())) for _, _, _, size, _, c in held])
        _, at = np.unique(hashes, return_inverse=True)
        total = np.bincount(at, counts).astype(np.int64)[at]
        ends = np.cumsum([int(size.sum()) for _, _, _, size, _, _ in held])
        out = [(prefix, grp, n, blocks, sizes, _numbers(part)) for (grp, blocks, sizes, *_), part in zip(held, np.split(total, ends[:-1]), strict=True)]
        yield from _batches(out, _BACK)


def _gather(batches, bits: int, down: int):
    """The way back of :func:`_deal`: joins the totals of 2**bits ranges, sorted by (parent prefix, grp, n, prefix),
    into rows of the parent range for each group of ``down`` blocks."""
    for (parent, _, n), rows in groupby(_tuples(batches), lambda r: (r[0] >> bits, r[1], r[2])):
        parts: dict[int, list] = {}
        for r in rows:
            size = np.frombuffer(r[4], "<i4")
            total = _read_numbers(r[5], int(size.sum()))
            for block, part in zip(np.frombuffer(r[3], "<i8").tolist(), np.split(total, np.cumsum(size)[:-1]), strict=True):
                parts.setdefault(block, []).append(part)
        out = []
        for grp, blocks in groupby(sorted(parts), lambda b: b // down):
            blocks = list(blocks)
            whole = [np.concatenate(parts[b]) for b in blocks]
            out.append((parent, grp, n, np.array(blocks, "<i8").tobytes(), np.array([len(w) for w in whole], "<i4").tobytes(), _numbers(np.concatenate(whole))))
        yield from _batches(out, _BACK)


def _per_block(batches, make):
    block, held = None, []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = np.flatnonzero(np.diff(blocks)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
            if e == s:
                continue
            if blocks[s] != block:
                if held:
                    yield from make(block, pa.chunked_array(held))
                block, held = int(blocks[s]), []
            held.append(batch.column("text").slice(s, e - s))
    if held:
        yield from make(block, pa.chunked_array(held))


def score_block(coded, words: np.ndarray, totals: list[np.ndarray], corpus_words: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log S, n-grams of the highest order found elsewhere) of each document of a block."""
    n_docs = len(words)
    order = len(coded)
    # for each n-gram occurrence its count in other documents
    other: list[np.ndarray] = []
    for (doc, g), total in zip(coded, totals, strict=True):
        _, at = np.unique(g, return_inverse=True)
        pair = doc * max(len(total), 1) + at
        _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
        other.append(total[at] - own[back])
    first = np.concatenate([[0], np.cumsum(words)])
    doc1 = coded[0][0]
    elsewhere = np.maximum(corpus_words - words, 1)
    out = np.log(np.maximum(other[0], FLOOR) / elsewhere[doc1])
    level = (other[0] > 0).astype(np.int64)
    for n in range(2, order + 1):
        doc = coded[n - 1][0]
        if not len(doc):
            break
        # the k-th n-gram of a document ends at its word k + n - 1, and its history is (n - 1)-gram k
        k = np.arange(len(doc)) - np.searchsorted(doc, doc)
        last = first[doc] + k + n - 1
        history = np.searchsorted(coded[n - 2][0], doc) + k
        seen = other[n - 1] > 0
        out[last] = np.where(seen, np.log(np.maximum(other[n - 1], 1) / np.maximum(other[n - 2][history], 1)), np.log(alpha) + out[last])
        level[last[seen]] = n
    sums = np.bincount(doc1, out, n_docs)
    return sums, np.bincount(doc1, level == order, n_docs).astype(np.int64)


def _levels(bits: int) -> list[int]:
    """The bits of each level: as even as they can be, at most FAN_BITS each."""
    n = max(1, -(-bits // FAN_BITS))
    return [bits // n + (i < bits % n) for i in range(n)]


def _tables(asked: DataFrame, levels: list[int], whole: int) -> DataFrame:
    """The rows of every block with the totals of their n-grams (prefix, grp: the block, n, blocks, sizes, totals)."""
    rows, rest, span = asked, whole - levels[0], 1
    spans = [1]
    for bits in levels[1:]:
        span <<= FAN_BITS
        spans.append(span)
        up = F.expr(f"grp div {1 << FAN_BITS}")
        dealt = rows.withColumn("parent", up).repartition("prefix", "parent").sortWithinPartitions("prefix", "parent", "n", "grp")
        rows = dealt.mapInArrow(lambda b, bits=bits, rest=rest: _deal(b, bits, rest), _ROW_DDL)
        rest -= bits
    back = rows.repartition("prefix").sortWithinPartitions("prefix", "n", "grp").mapInArrow(_total, _BACK_DDL)
    for bits, down in zip(reversed(levels[1:]), reversed(spans[:-1]), strict=True):
        parent = F.shiftright("prefix", bits)
        dealt = back.repartition(parent, F.col("grp")).sortWithinPartitions(parent, "grp", "n", "prefix")
        back = dealt.mapInArrow(lambda b, bits=bits, down=down: _gather(b, bits, down), _BACK_DDL)
    return back


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4) -> DataFrame:
    """``id_col``, n_words, log_score (sum of natural logarithms), per_word (its mean) and n_known (words
    whose whole n-gram occurs in another document), for each row of ``docs``.

    Words are what stands between ASCII white space.  Null and empty texts have no words, log_score 0 and
    a null per_word.  Repeated rows are documents of their own, and know each other's n-grams.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sizes(batches):
        size = words = rows = 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, off in tx.rounds(batch.column("text")):
                size += len(data)
                words += len(tx.find_words(data, off, tx.SPACED).starts)
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([words]), pa.array([rows])], names=["size", "words", "docs"])

    r = src.mapInArrow(sizes, "size long, words long, docs long").agg(F.sum("size"), F.sum("words"), F.sum("docs")).first()
    size, corpus_words = r[0] or 0, r[1] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    levels = _levels(max(0, (corpus_words // BUCKET_GRAMS).bit_length()))
    whole = min(64, sum(levels) + REST_BITS)
    # copies of a text go apart by their ids
    dealt = src.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "id", F.xxhash64("text"))
    tables = _tables(dealt.mapInArrow(_ask(levels[0], whole, order), _ROW_DDL), levels, whole)
    tables = tables.select(F.col("grp").alias("block"), "n", "prefix", "sizes", "totals")

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        coded, words = _codes(left.column("text"), order, whole)
        rows = sorted(zip(*(right.column(c).to_pylist() for c in ("n", "prefix", "sizes", "totals")), strict=True))
        totals = [np.zeros(0, np.int64)] * order
        for n in range(1, order + 1):
            raw = [_read_numbers(t, int(np.frombuffer(s, "<i4").sum())) for m, _, s, t in rows if m == n]
            if raw:
                totals[n - 1] = np.concatenate(raw)
        total, known = score_block(coded, words, totals, corpus_words, alpha)
        mean = pa.array(total / np.maximum(words, 1), mask=words == 0)
        return pa.table([left.column("id"), pa.array(words), pa.array(total), mean, pa.array(known)], names=["id", "n_words", "log_score", "per_word", "n_known"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = dealt.groupBy("block").cogroup(tables.groupBy("block")).applyInArrow(finish, f"id {id_type}, n_words long, log_score double, per_word double, n_known long")
    return out.withColumnRenamed("id", id_col)
