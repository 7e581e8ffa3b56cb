"""Exact Jaccard self-join of shingle sets, as a metric-space join around pivots.

Jaccard distance is a metric, so a document's distances to a few pivots bound its distance to others.
Far documents are all at distance 1, which makes pivots useless on a whole corpus; they work among
documents that share content.  So:

1. A table of hashed counters over all shingles (bounded, summed over the corpus) orders shingles from
   rare to frequent.  Two sets that are similar enough share a shingle among the rarest quarter of each,
   so the holders of such a shingle form a bucket, and every link lies inside a bucket.
2. A small bucket (at most ``SMALL`` sets) is compared directly.  A larger one takes its most central set
   as pivot, and every member is compared with that pivot alone.  The buckets of one pivot are its region.
3. A region that still holds two components is joined further.  One of bounded size is joined in memory:
   central sets first, each pivot is compared with all others through an inverted index, until every set
   that is left lies in one component.  A larger one takes more pivots: each member belongs to the Voronoi
   region of its nearest pivot; members whose distances put them within the triangle-inequality window of
   another region are replicated there, and those far from all pivots form a region of their own.  These
   are joined in the same way, pivots being done.

A pair is first held against parity sketches (a bit for each hash value modulo the sketch's length, set when an
odd number of shingles falls on it): the bits in which two sketches differ are at most the shingles in which
the sets differ, so a pair with too many of them is no link, and only the others bring their sets together.
Distances are set intersections of 64-bit hashes.  Equal sets (by 128 bits) are one component at once,
before any comparison.

No key is bound to one task: tokens that may be frequent are dealt by token and id and take their pivot from an
aggregate, and joins on a key that many rows share spread these rows (see :mod:`.spread`).
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as tx
from quillgraph.llm.bitmap import bitmap, may_hold, present
from quillgraph.llm.graph import connected
from quillgraph.llm.runtime import cut, discard, in_task, prepare, unclash
from quillgraph.llm.spread import frequent, spread_join

#: Sets of a bucket that are compared with each other directly.
SMALL = 8
#: Pivots of a region that is too large for memory; each next recursion takes twice as many.
PIVOTS = 8
#: Shingles of a region that one task joins in memory: 32 MB of hashes.
REGION = 4 << 20
#: Counters for the rarity of shingles, and the pieces in which they are summed.
COUNTERS = 1 << 21
PIECES = 64
#: A token is taken for frequent when its counter holds at least one in FREQUENT of all rows.
FREQUENT = 256
#: Marks a frequent token's row, above centrality and size.
_HOT = 1 << 62
#: Signatures that a task remembers to leave out further copies of a set.
MEMORY = 1 << 18


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of each text, and where each text's begin."""
    low = tx.FOLD[data]
    w = tx.find_words(low, off, tx.SPACED)
    n_docs = len(off) - 1
    if not len(w.starts):
        return np.zeros(0, tx.U), np.zeros(n_docs + 1, np.int64)
    h = tx.hash_words(low, w)
    grams = tx.gram_hash(h, k)
    doc, ok = w.doc(), w.room() >= k
    counts = w.counts
    doc, grams = doc[ok], grams[ok]
    for n in range(1, min(k, int(counts.max()) + 1)):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = tx.mix(tx.gram_hash(h, n)[w.first[short]] ^ tx.U(0xA5A5 + n))
            doc, grams = np.concatenate([doc, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(n_docs + 1))


def signatures(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    out = []
    for salt in (0x1234567, 0x7654321):
        total = np.zeros(len(grams) + 1, tx.U)
        np.cumsum(tx.mix(grams ^ tx.U(salt)), out=total[1:], dtype=tx.U)
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def sketches(grams: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """The parity sketch of each set: 1 to 2 bits a shingle, a power of two; none for an empty set."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a == b:
            out.append(None)
            continue
        bits = max(64, 1 << (b - a - 1).bit_length())
        odd = np.bincount((grams[a:b] & tx.U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has."""
    p, q = (x, y) if len(x) <= len(y) else (y, x)
    n = int.from_bytes(q, "big")
    size = len(q)
    while size > len(p):  # shingles modulo half the length: both halves, added modulo 2
        size //= 2
        n = (n >> (8 * size)) ^ (n & ((1 << (8 * size)) - 1))
    return (n ^ int.from_bytes(p, "big")).bit_count()


def _survey(src: DataFrame, k: int) -> DataFrame:
    """Per row id, h1, h2, n, sketch; and, with a piece number, packed counters of all shingles of a task."""

    def run(batches):
        counters = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            ids = batch.column("id")
            for lo, hi, data, off in tx.rounds(batch.column("text")):
                grams, first = shingle_sets(data, off, k)
                counters += np.bincount((grams % tx.U(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
                h1, h2 = signatures(grams, first)
                none = pa.nulls(hi - lo)
                made = pa.array(sketches(grams, first), pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(h1), pa.array(h2), pa.array(np.diff(first)), made, none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for p, part in enumerate(np.split(counters, PIECES)):
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(1, pa.binary()), pa.array([p], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=names)

    names = ["id", "h1", "h2", "n", "sketch", "piece", "counts"]
    return src.mapInArrow(in_task(run), "id long, h1 long, h2 long, n long, sketch binary, piece int, counts binary")


def _rarity(survey: DataFrame) -> np.ndarray:
    """The corpus totals of the counters: COUNTERS numbers, whatever the size of the corpus."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column("piece").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_py()), np.uint32).astype(np.uint64)
                total[p] = total[p] + part if p in total else part
        for p, part in total.items():
            packed = zlib.compress(np.minimum(part, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed])], names=["piece", "counts"])

    rows = survey.filter("piece is not null").select("piece", "counts").repartition("piece").mapInArrow(in_task(add), "piece int, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    step = COUNTERS // PIECES
    for r in rows.collect():  # at most PIECES rows
        out[r.piece * step : (r.piece + 1) * step] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint32)
    return out


def _postings(src: DataFrame, k: int, share: int, rarity, rows: int) -> DataFrame:
    """(token, id, rank) for the rarest shingles of each set; rank holds its centrality above its size, and
    ``_HOT`` where the token may be frequent among ``rows`` rows."""

    def run(batches):
        table = rarity.value
        seen: set = set()
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo, hi, data, off in tx.rounds(batch.column("text")):
                grams, first = shingle_sets(data, off, k)
                if not len(grams):
                    continue
                size = np.diff(first)
                fresh = np.zeros(hi - lo, bool)
                for d, sig in enumerate(zip(*(s.tolist() for s in signatures(grams, first)), strict=True)):
                    if size[d] and sig not in seen:
                        if len(seen) >= MEMORY:
                            seen.clear()
                        seen.add(sig)
                        fresh[d] = True
                doc = np.repeat(np.arange(hi - lo), size)
                load = table[(grams % tx.U(COUNTERS)).astype(np.int64)].astype(np.int64)
                mean = np.bincount(doc, load, hi - lo) / np.maximum(size, 1)
                rank = (np.minimum(mean * 16, (1 << 30) - 1).astype(np.int64) << 32) + size
                order = np.lexsort((grams, load, doc))
                place = np.arange(len(doc)) - first[doc]
                take = fresh[doc] & (place < (size - (share * size + 99) // 100 + 1)[doc])
                of = doc[take]
                marked = rank[of] | np.where(load[order][take] * FREQUENT >= max(rows, FREQUENT * SMALL), _HOT, 0)
                yield pa.RecordBatch.from_arrays([pa.array(grams[order][take].view(np.int64)), pa.array(ids[lo:hi][of]), pa.array(marked)], names=["token", "id", "rank"])

    return src.filter("id is not null and text is not null").mapInArrow(in_task(run), "token long, id long, rank long")


_BUCKET_OUT = "a long, b long, token long, rank long"
_NAMES = ["a", "b", "token", "rank"]


def _batch(a, b=None, token=None, rank=None):
    cols = [pa.nulls(len(a), pa.int64()) if c is None else pa.array(np.asarray(c, np.int64)) for c in (a, b, token, rank)]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _size_ok(r1: np.ndarray, r2: np.ndarray, share: int) -> np.ndarray:
    n1, n2 = r1 & 0xFFFFFFFF, r2 & 0xFFFFFFFF
    return 100 * np.minimum(n1, n2) >= share * np.maximum(n1, n2)


def _buckets(batches, share: int):
    """Streams postings sorted by (token, rank descending, id); those of frequent tokens pass as they are.

    Gives pairs (a, b) to compare, b coming before a in that order: all of a small bucket, else each member
    with the first, its pivot; and the members of large buckets but for their pivots, with the pivot as token: its region.
    """
    hold = [np.zeros(0, np.int64)] * 3
    open_token = pivot = None

    def star(ids, ranks, p):
        ok = (ids != p[0]) & _size_ok(ranks, np.full(len(ranks), p[1]), share)
        yield _batch(ids[ok], np.full(int(ok.sum()), p[0]))
        rest = ids != p[0]
        yield _batch(ids[rest], None, np.full(int(rest.sum()), p[0]), ranks[rest])

    def close(token, ids, ranks, last):
        nonlocal open_token, pivot
        if open_token is not None and len(token) and token[0] == open_token:
            n = int(np.searchsorted(token != open_token, True)) if token[-1] != open_token else len(token)
            yield from star(ids[:n], ranks[:n], pivot)
            token, ids, ranks = token[n:], ids[n:], ranks[n:]
        if not len(token):
            return
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(head, len(token)))
        for s in range(2, SMALL + 1):
            at = head[size == s]
            if len(at):
                i, j = (np.array(c) for c in zip(*itertools.combinations(range(s), 2), strict=True))
                x, y = (at[:, None] + i).reshape(-1), (at[:, None] + j).reshape(-1)
                ok = (ids[x] != ids[y]) & _size_ok(ranks[x], ranks[y], share)
                yield _batch(ids[y[ok]], ids[x[ok]])
        for at, s in zip(head[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            p = (ids[at], ranks[at])
            yield from star(ids[at : at + s], ranks[at : at + s], p)
            if not last and at + s == len(token):
                open_token, pivot = token[at], p

    for batch in batches:
        new = [batch.column(c).to_numpy() for c in ("token", "id", "rank")]
        hot = new[2] >= _HOT
        if hot.any():
            yield _batch(new[1][hot], None, new[0][hot], new[2][hot])
            new = [c[~hot] for c in new]
        cols = [np.concatenate([h, c]) for h, c in zip(hold, new, strict=True)]
        if not len(cols[0]):
            continue
        cut_at = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
        if len(cols[0]) - cut_at > 100_000:
            cut_at = len(cols[0])  # a hot one: its pivot is known, the rest will stream past it
        hold = [c[cut_at:] for c in cols]
        yield from close(*(c[:cut_at] for c in cols), False)
    if len(hold[0]):
        yield from close(*hold, True)


def _texts(src: DataFrame, needs: DataFrame) -> DataFrame:
    """The rows of ``needs`` (id and others) with the texts of their ids; other texts are mostly not shuffled."""
    marked = src.sparkSession.sparkContext.broadcast(bitmap(needs.select("id").distinct()))  # of bounded size

    def sift(batches):
        for batch in batches:
            yield batch.filter(pa.array(present(batch.column("id").to_numpy(), marked.value)))

    likely = src.filter("id is not null and text is not null").mapInArrow(in_task(sift), "id long, text string")
    return likely.join(needs.hint("merge"), "id")


def _sets(batch: pa.RecordBatch, k: int):
    """The shingle set of each text of a batch."""
    for _, _, data, off in tx.rounds(batch.column("text")):
        grams, first = shingle_sets(data, off, k)
        yield from (grams[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True))


def _likely(pairs: DataFrame, sketched: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out; none that is a link is lost."""

    def run(batches):
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(batch.column(c) for c in ("na", "nb", "sa", "sb")), strict=True):
                # a link's sets differ in at most (1 - s) / (1 + s) of the sum of their sizes
                ok.append((100 + share) * sketch_distance(x.as_py(), y.as_py()) <= (100 - share) * (n.as_py() + m.as_py()))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sketched.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("rep").alias("ra"))
    right = sketched.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("rep").alias("rb"))
    both = spread_join(spread_join(pairs, left, "a", pairs, "b"), right, "b", pairs, "a").filter("ra <> rb")
    return both.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "na", "nb", "sa", "sb").mapInArrow(in_task(run), "a long, b long").distinct()


def _overlaps(src: DataFrame, k: int, pairs: DataFrame) -> DataFrame:
    """a < b, inter, uni: the exact sizes of intersection and union of each stored pair (a, b).

    Each text goes to the hubs, b, that it is to be compared with; a hub's set is held while the others pass.
    A hub with many partners is repeated, and they are dealt over its copies.
    """
    hot = frequent(pairs, "b")
    with_share = pairs.withColumn("share", F.lit(0))
    if hot:
        listed = F.broadcast(pairs.sparkSession.createDataFrame(hot, "b long, shares int"))  # a bounded list
        with_share = pairs.join(listed, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("shares")), F.lit(0)).cast("int").alias("share"))
    needs = with_share.select(F.col("a").alias("id"), F.col("b").alias("hub"), "share")
    needs = needs.union(with_share.select("b", "b", "share").distinct())
    dealt = _texts(src, needs).repartition("hub", "share").sortWithinPartitions("hub", "share", F.col("id") != F.col("hub"))

    def run(batches):
        at, held, marks = None, [], set()
        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("id", "hub", "share")), strict=True)
            for (i, hub, part), own in zip(keys, _sets(batch, k), strict=True):
                if (hub, part) != at:
                    at, held, marks = (hub, part), [], set()
                if i == hub:  # several only where rows repeat an id
                    mark = signatures(own, np.array([0, len(own)]))
                    mark = (int(mark[0][0]), int(mark[1][0]))
                    if mark not in marks:
                        marks.add(mark)
                        held.append(own)
                    continue
                for other in held:
                    place = np.searchsorted(other, own)
                    place[place == len(other)] = 0
                    same = int(np.count_nonzero(other[place] == own)) if len(other) else 0
                    out.append((min(i, hub), max(i, hub), same, len(own) + len(other) - same))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "inter", "uni"])

    return dealt.mapInArrow(in_task(run), "a long, b long, inter long, uni long")


def sketch_region(ids: list[int], comps: list[int], sizes: list[int], marks: list[bytes], share: int, most: int) -> list[tuple[int, int]] | None:
    """The pairs of a region in different components whose sketches allow a link; None if above ``most``."""
    order = np.argsort(np.array(sizes), kind="stable")
    ids_, comp, size = (np.array(c, np.int64)[order] for c in (ids, comps, sizes))
    width = np.array([len(marks[i]) // 8 for i in order])
    # sketches of one length are a matrix; the next length up is folded once to be compared with it
    heads = np.flatnonzero(np.concatenate([[True], width[1:] != width[:-1]])).tolist() + [len(width)]
    parts = {int(width[a]): (a, np.frombuffer(b"".join(marks[i] for i in order[a:b]), np.uint64).reshape(b - a, -1)) for a, b in itertools.pairwise(heads)}
    folded = {w // 2: (a, m[:, : w // 2] ^ m[:, w // 2 :]) for w, (a, m) in parts.items() if w > 1}
    out: list[tuple[int, int]] = []
    last = np.searchsorted(size * share, size * 100, "right")
    for i in range(len(size)):
        w = int(width[i])
        own = parts[w][1][i - parts[w][0]]
        for source in (parts, folded):
            a, m = source.get(w, (0, None))
            if m is None:
                continue
            lo, hi = max(i + 1, a), min(int(last[i]), a + len(m))
            if lo >= hi:
                continue
            js = lo + np.flatnonzero(comp[lo:hi] != comp[i])
            if not len(js):
                continue
            apart = np.bitwise_count(m[js - a] ^ own).sum(axis=1, dtype=np.int64)
            ok = js[(100 + share) * apart <= (100 - share) * (size[js] + size[i])]
            out += [(int(ids_[i]), int(ids_[j])) for j in ok if ids_[j] != ids_[i]]
        if len(out) > most:
            return None
    return out


#: Sets of a region whose sketches are all compared, and pairs a set that may come of it; else the region's texts are joined.
SKETCHED, LIKELY = 1 << 14, 8


def _sketch_small(batches, share: int):
    """Streams (token, id, comp, n, sketch) sorted by token.  Gives the pairs (a, b) of each region that may be
    links, or its token alone where they are too many."""
    token, held = None, []

    def done():
        if len(held) < 2:
            return
        found = sketch_region(*(list(c) for c in zip(*held, strict=True)), share, LIKELY * len(held)) if len(held) <= SKETCHED else None
        if found is None:
            yield _batch([0], None, [token])
        elif found:
            yield _batch(*zip(*found, strict=True))

    for batch in batches:
        for t, i, c, n, x in zip(*(batch.column(y) for y in ("token", "id", "comp", "n", "sketch")), strict=True):
            t = t.as_py()
            if t != token:
                yield from done()
                token, held = t, []
            held.append((i.as_py(), c.as_py(), n.as_py(), x.as_py()))
    yield from done()


def _central(batches, k: int):
    """The first k rows of each token (by rank descending, id) that this task sees."""
    held: dict[int, list] = {}
    for batch in batches:
        for t, r, i in zip(*(batch.column(c).to_pylist() for c in ("token", "rank", "id")), strict=True):
            best = held.setdefault(t, [])
            if len(best) < k or (-r, i) < best[-1]:
                if (-r, i) not in best:
                    bisect.insort(best, (-r, i))
                    del best[k:]
    rows = [(t, -r, i) for t, best in held.items() for r, i in best]
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 10_000], strict=True)], names=["token", "rank", "id"])


def _pivots(members: DataFrame, k: int) -> DataFrame:
    """token, pivot: the k most central members of each region, picked in two steps."""
    ddl = "token long, rank long, id long"
    near = members.select("token", "rank", "id").mapInArrow(lambda b: _central(b, k), ddl)
    return near.repartition("token").mapInArrow(lambda b: _central(b, k), ddl).select("token", F.col("id").alias("pivot"))


def join_region(ids: list[int], comps: list[int], sets: list[np.ndarray], share: int) -> list[tuple[int, int, int, int]]:
    """Links (a, b, intersection, union) that join the components of a region as its sets demand.

    Each pivot is compared with every set.  A pair is left out only when both already share a component
    or one of them was a pivot, so the components come out exact.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(n), size)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    holders, first = doc[order], np.concatenate([[0], np.cumsum(df)])
    bounds = np.concatenate([[0], np.cumsum(size)])
    central = np.bincount(doc, df[code], n) / np.maximum(size, 1)
    _, comp = np.unique(np.array(comps), return_inverse=True)
    left = np.ones(n, bool)
    out = []
    by_centre = np.argsort(-central, kind="stable")
    while True:
        open_comps = np.bincount(comp[left], minlength=1)
        if (open_comps > 0).sum() < 2:
            return out
        # after the first, sets outside the largest component: few are, once a centre has been found
        main = int(np.argmax(open_comps))
        at = next(i for i in by_centre if left[i] and (not out or comp[i] != main))
        left[at] = False
        mine = code[bounds[at] : bounds[at + 1]]
        shared = np.bincount(np.concatenate([holders[first[c] : first[c + 1]] for c in mine]) if len(mine) else [], minlength=n)
        union = size + size[at] - shared
        for j in np.flatnonzero((100 * shared >= share * union) & (comp != comp[at])):
            if comp[j] != comp[at]:
                out.append((ids[at], ids[j], int(shared[j]), int(union[j])))
                comp[comp == comp[j]] = comp[at]


def _join_small(batches, k: int, share: int):
    """Streams (token, id, comp, text) sorted by token; joins each region in memory."""
    token, held = None, []

    def done():
        rows = [(min(a, b), max(a, b), i, u) for a, b, i, u in join_region(*(list(c) for c in zip(*held, strict=True)), share)] if len(held) > 1 else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "inter", "uni"])

    for batch in batches:
        keys = zip(*(batch.column(x).to_pylist() for x in ("token", "id", "comp")), strict=True)
        for (t, i, c), own in zip(keys, _sets(batch, k), strict=True):
            if t != token:
                yield from done()
                token, held = t, []
            held.append((i, c, own))
    yield from done()


def _stars(hot: DataFrame, share: int) -> DataFrame:
    """Of frequent tokens' postings (token, id, rank): a, b (the pivot), token, rank as :func:`_buckets` gives
    them, in one row each; b is null where the sizes forbid a link."""
    best = hot.groupBy("token").agg(F.max(F.struct("rank", (-F.col("id")).alias("less"))).alias("top"))
    pivots = best.select("token", (-F.col("top.less")).alias("pivot"), F.col("top.rank").alias("top"))
    near = spread_join(hot, pivots, "token", hot, "id").filter("id <> pivot")
    n, m = (F.col(c).bitwiseAND(0xFFFFFFFF) for c in ("rank", "top"))
    pair = F.when(100 * F.least(n, m) >= share * F.greatest(n, m), F.col("pivot"))
    return near.select(F.col("id").alias("a"), pair.alias("b"), F.col("pivot").alias("token"), "rank")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: int = 75) -> DataFrame:
    """id, n_shingles, component_id for each row of ``docs`` (the last two as stated in the query contract).

    Sets are compared whole.  Null and empty texts have no shingles and link with nothing; a row whose id
    is null has no component.  Rows that repeat an id are one node: their links are joined.  Ids are taken
    as 64-bit integers; an id that is none raises.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = _source(docs, id_col, text_col)
    survey = cut(_survey(src, k), "survey")
    rarity = spark.sparkContext.broadcast(_rarity(survey))  # COUNTERS numbers of 4 bytes: 8 MB always
    signed = survey.filter("piece is null").select("id", "h1", "h2", "n", "sketch")
    named = signed.filter("n > 0 and id is not null")
    same = named.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").select("h1", "h2", "rep")
    # equal sets stand for each other: rep has the smallest id
    known_sets = cut(spread_join(named, same, ["h1", "h2"], named.select("h1", "h2"), "id", "left").select("id", "n", "sketch", F.coalesce("rep", "id").alias("rep")), "signatures")
    copies = known_sets.filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    dealt = _postings(src, k, share, rarity, signed.count())
    dealt = dealt.repartition(F.when(F.col("rank") >= _HOT, F.xxhash64("token", "id")).otherwise(F.col("token"))).sortWithinPartitions("token", F.desc("rank"), "id")
    first = cut(dealt.mapInArrow(in_task(lambda b: _buckets(b, share)), _BUCKET_OUT), "buckets")
    hot = first.filter(F.col("rank") >= _HOT).select("token", F.col("a").alias("id"), F.col("rank").bitwiseXOR(_HOT).alias("rank"))
    stars = cut(_stars(hot, share), "stars")
    pairs = cut(first.filter("token is null").union(stars.filter("b is not null")).select("a", "b").distinct(), "pairs")
    grouped = first.filter(F.col("token").isNotNull() & (F.col("rank") < _HOT)).union(stars).groupBy("token", F.col("a").alias("id"))
    members = cut(grouped.agg(F.max("rank").alias("rank")), "members")
    asked = cut(_likely(pairs, known_sets, share), "likely")
    known = [cut(_overlaps(src, k, asked), "overlaps")]
    discard(first, stars, pairs, asked)
    comps = cut(connected(_links(known, share).unionByName(copies)), "comps")
    if not members.isEmpty():
        comps = _join_regions(src, k, known_sets, members, known, comps, share)
    node = comps.select(F.col("node").alias("id"), "comp")
    labelled = signed.select("id", "n").join(node.hint("merge"), "id", "left")
    out = cut(labelled.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id")), "components")
    discard(survey, known_sets, members, comps, *known)
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _links(known: list[DataFrame], share: int) -> DataFrame:
    return _all(known).filter(f"100 * inter >= {share} * uni").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _join_regions(src: DataFrame, shingle: int, known_sets: DataFrame, members: DataFrame, known: list[DataFrame], comps: DataFrame, share: int) -> DataFrame:
    """Joins the regions until none holds two components that might link."""
    eps, tiny = 1 - share / 100, 1e-9
    k = PIVOTS

    def again(old: DataFrame) -> DataFrame:
        """The components with the latest links; they stand for all links before."""
        links = _links(known[-1:], share)
        if links.isEmpty():
            return old
        new = cut(connected(links.unionByName(old.select(F.col("node").alias("u"), F.col("comp").alias("v")))), "comps")
        discard(old)
        return new

    while True:
        at = members.join(comps.select(F.col("node").alias("id"), "comp").hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        size = F.sum(F.col("rank").bitwiseAND(0xFFFFFFFF))
        state = at.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), size.alias("size")).filter("c0 <> c1").select("token", "size")
        live = cut(spread_join(at, state, "token", members, "id"), "regions")
        small, large = live.filter(F.col("size") <= REGION), live.filter(F.col("size") > REGION)
        if live.isEmpty():
            break
        # a small region has at most REGION shingles; its sketches come to one task, and its texts only if they decide little
        marked = small.join(known_sets.select("id", "n", "sketch").hint("merge"), "id").select("token", "id", "comp", "n", "sketch")
        dealt = marked.repartition("token").sortWithinPartitions("token", "id")
        sketched = cut(dealt.mapInArrow(in_task(lambda b: _sketch_small(b, share)), _BUCKET_OUT), "sketched")
        asked = cut(sketched.filter("token is null").select("a", "b").distinct(), "asked")
        known.append(cut(_overlaps(src, shingle, asked), "overlaps"))
        comps = again(comps)
        unclear = sketched.filter("token is not null").select("token")
        if not unclear.isEmpty():
            texts = _texts(src, small.join(unclear.hint("merge"), "token").select("id", "token", "comp"))
            dealt = texts.repartition("token").sortWithinPartitions("token", "id")
            known.append(cut(dealt.mapInArrow(lambda b: _join_small(b, shingle, share), "a long, b long, inter long, uni long"), "overlaps"))
            comps = again(comps)
        discard(sketched, asked)
        if large.isEmpty():
            break

        pivots = cut(_pivots(large, k), "pivots")
        big = large.select("token", "id", "rank")
        near = cut(spread_join(big, pivots, "token", big, "id").withColumns({"a": F.least("id", "pivot"), "b": F.greatest("id", "pivot")}), "near")
        asked = near.filter("a <> b").groupBy("a", "b").agg(F.min("pivot").alias("hub"))
        for old in known:
            asked = asked.join(old.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        asked = cut(asked.select((F.col("a") + F.col("b") - F.col("hub")).alias("a"), F.col("hub").alias("b")), "asked")
        known.append(cut(_overlaps(src, shingle, asked), "overlaps"))
        comps = again(comps)

        # several texts under one id: the nearest counts
        apart = _all(known).groupBy("a", "b").agg(F.min(1 - F.col("inter") / F.col("uni")).alias("d"))
        done = near.filter("a = b").select("token", "id").distinct()
        others = near.join(done.hint("merge"), ["token", "id"], "left_anti")
        far_off = cut(others.join(apart.hint("merge"), ["a", "b"]).select("token", "id", "rank", "pivot", "d"), "distances")
        home = far_off.groupBy("token", "id", "rank").agg(F.min("d").alias("r"))
        inner = far_off.join(home.hint("merge"), ["token", "id", "rank"]).filter((F.col("r") <= 2 * eps + tiny) & (F.col("d") <= F.least(F.lit(3 * eps), F.col("r") + 2 * eps) + tiny))
        inner = inner.select(F.xxhash64("token", "pivot").alias("token"), "id", "rank")
        far = home.filter(F.col("r") > eps - tiny).select(F.xxhash64("token", F.lit("far")).alias("token"), "id", "rank")
        then = cut(inner.unionByName(far), "members")
        discard(members, live, pivots, asked, near, far_off)
        members, k = then, 2 * k
    discard(members, live)
    return comps


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest id, with all its columns.

    Rows with a null id, and null, empty and blank texts, stay.  Rows that repeat an id that stays all stay,
    but of those with the same text only that whose columns, as JSON, come first.  Only rows whose id may go
    or is repeated (by a bitmap of at most 128 MB) are shuffled.
    """
    spark = docs.sparkSession
    found = components(docs, id_col, text_col, **how)
    key, gone = unclash(docs, "key_", "gone_")
    ids = found.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias(key), (F.col(id_col) != F.col("component_id")).alias(gone))
    marked = cut(ids.groupBy(key).agg(F.max(gone).alias(gone), F.count("*").alias("n")).filter(F.col(gone) | (F.col("n") > 1)).drop("n"), "marked")
    may = may_hold(spark, bitmap(marked.select(key)))
    named = F.col(id_col).isNotNull()
    clear = docs.filter(~named | ~may(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))))
    rest = docs.filter(named).withColumn(key, F.col(id_col).cast("long")).filter(may(F.col(key)))
    left = spread_join(rest, marked, key, ids, text_col, "left")
    free = left.filter(F.col(gone).isNull()).select(*docs.columns)
    whole = F.struct(*docs.columns)
    again = left.filter(~F.col(gone)).groupBy(key, F.col(text_col).alias(gone + "t")).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return clear.unionByName(free).unionByName(again)
