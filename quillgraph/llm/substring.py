"""Exact substring deduplication by Rabin-Karp window hashes.

Every window of ``width`` consecutive words has a rolling hash.  Two equal windows hold equal anchors: of
the short grams inside a window, the one with the smallest hash, leftmost of equal ones.  Windows of a
text that follow each other mostly share their anchor, so Spark shuffles one row for each anchor with the
packed hashes of its windows, and the windows of one anchor are counted together, documents ascending: a
window is removed when a smaller document has shown it before.  Consecutive removed windows are merged
into intervals before they leave the counting task, and once more for each document.

Windows of frequent anchors are not brought together: the smallest document of each is an aggregate that is
combined within tasks first, and these go to as many shares as an anchor's rows are dealt over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as tx
from quillgraph.llm.runtime import cut, discard, in_task, prepare, unclash

#: Words in an anchor gram.
ANCHOR = 8
#: Bytes kept of a window's hash; the 8 bytes of its anchor's hash must be equal as well.
HASH_BYTES = 6
#: Window hashes that the counting task holds for one anchor; beyond it the anchor is split by hash.
STATE = 1 << 21
#: Of these, those that stay Python numbers in a set, at some 90 bytes each; the others are arrays of 8 bytes each.
RECENT = 1 << 16
#: Parts into which such an anchor is split.
SPLIT = 64
#: Counters that find frequent anchors, and the share of all rows (one in FREQUENT) that makes a counter frequent.
SLOTS = 1 << 14
FREQUENT = 512
#: Windows of frequent anchors that a task holds before it combines them.
COMBINE = 1 << 20
#: The share of rows whose anchor is not frequent.
_ONE = -1


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its smallest value, the leftmost of equal ones."""
    n = len(h) - width + 1
    best = np.arange(len(h))
    have = 1
    while have < width:  # doubling: windows of `have` values joined two by two, overlapping at the end
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        have += step
    return best[:n]


def runs(data: np.ndarray, off: np.ndarray, width: int):
    """(text, first window, anchor hash, hash bytes) arrays of maximal runs of windows with one anchor."""
    w = tx.find_words(data, off, tx.SPACED)
    if len(w.starts) < width:
        return None
    h = tx.hash_words(data, w)
    doc, room = w.doc(), w.room()
    # Rabin-Karp: the windows of all texts from one cumulative sum of weighted word hashes
    weight = tx.powers(len(h))
    total = np.zeros(len(h) + 1, tx.U)
    np.cumsum(h * weight, out=total[1:], dtype=tx.U)
    n = len(h) - width + 1
    raw = (total[width:] - total[:-width]) * tx.inverse_powers(len(h))[:n]
    window = tx.mix(raw)
    anchor_hash = tx.gram_hash(h, ANCHOR)[: len(h) - ANCHOR + 1]
    anchor = sliding_argmin(anchor_hash, width - ANCHOR + 1)
    ok = np.flatnonzero(room[:n] >= width)
    if not len(ok):
        return None
    a = anchor[ok]
    head = np.ones(len(ok), bool)
    head[1:] = (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1) | (doc[ok][1:] != doc[ok][:-1])
    begin = np.flatnonzero(head)
    first = ok[begin]
    packed = np.ascontiguousarray(window[ok]).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    offsets = np.append(begin, len(ok)).astype(np.int64) * HASH_BYTES
    return doc[first], first - w.first[doc[first]], anchor_hash[a[begin]].view(np.int64), np.ascontiguousarray(packed).reshape(-1), offsets


def _unpack(raw: bytes) -> np.ndarray:
    a = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    a[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return a.view(np.uint64).reshape(-1)


_IN = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("share", pa.int32()), ("id", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("hashes", pa.binary()), ("least", pa.binary())])
_IN_DDL = "anchor long, part int, share int, id long, digest long, start long, hashes binary, least binary"
_OUT = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("anchor", pa.int64()), ("part", pa.int32()), ("hashes", pa.binary())])
_OUT_DDL = "id long, digest long, start long, stop long, anchor long, part int, hashes binary"


def _rows(out: list[tuple], schema: pa.Schema):
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _spans(gone: np.ndarray, start: int, width: int) -> list[tuple[int, int]]:
    """The words of consecutive windows that go."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
    return [(start + int(a), start + int(b) - 1 + width) for a, b in edges]


class _Seen:
    """A set of window hashes: the latest in a set, the others in sorted arrays, each over twice as long as the next."""

    def __init__(self):
        self.latest, self.arrays = set(), []

    def __len__(self) -> int:
        return len(self.latest) + sum(map(len, self.arrays))

    def _stored(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for a in self.arrays:
            at = np.searchsorted(a, hashes)
            at[at == len(a)] = 0
            found |= a[at] == hashes
        return found

    def add(self, hashes: np.ndarray) -> None:
        for lo in range(0, len(hashes), RECENT):
            part = hashes[lo : lo + RECENT]
            self.latest.update((part[~self._stored(part)] if self.arrays else part).tolist())
            if len(self.latest) > RECENT:
                self.arrays.append(np.sort(np.fromiter(self.latest, np.uint64, len(self.latest))))
                self.latest = set()
                while len(self.arrays) > 1 and 2 * len(self.arrays[-1]) >= len(self.arrays[-2]):
                    both = np.concatenate([self.arrays.pop(), self.arrays.pop()])
                    both.sort()
                    self.arrays.append(both)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.fromiter(map(self.latest.__contains__, hashes.tolist()), bool, len(hashes))
        return found | self._stored(hashes) if self.arrays else found

    def empty(self) -> np.ndarray:
        """All hashes, which are no longer held."""
        every = np.concatenate([*self.arrays, np.fromiter(self.latest, np.uint64, len(self.latest))])
        self.latest, self.arrays = set(), []
        return every


class _Anchor:
    """One anchor's windows, its documents ascending: a window goes when an earlier document has shown it.

    Where there are more than ``state`` windows, those seen so far (id null) and the remaining rows come
    back, with their hashes, to be dealt again.
    """

    def __init__(self, key: tuple, width: int, state: int):
        self.key, self.width, self.state = key, width, state
        self.current, self.seen, self.new, self.spilt = None, _Seen(), [], False

    def take(self, i, digest, start, raw, _least) -> list[tuple]:
        again = (i, digest, start, None, *self.key[:2], raw)
        if self.spilt:
            return [again]
        if i != self.current and self.new:
            for old in self.new:
                self.seen.add(_unpack(old))
            self.new = []
            if len(self.seen) > self.state:
                self.spilt = True
                every = self.seen.empty().view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                return [*((None, None, None, None, *self.key[:2], every[j : j + (1 << 16)].tobytes()) for j in range(0, len(every), 1 << 16)), again]
        self.current = i
        if i is None:  # seen in an earlier pass
            self.seen.add(_unpack(raw))
            return []
        self.new.append(raw)
        if not self.seen:
            return []
        gone = self.seen.holds(_unpack(raw))
        return [(i, digest, a, b, self.key[0], None, None) for a, b in _spans(gone, start, self.width)] if gone.any() else []


class _Share:
    """A share of a frequent anchor's rows: first its repeated windows with their smallest documents (id null)."""

    def __init__(self, key: tuple, width: int):
        self.key, self.width, self.held, self.hashes = key, width, [], None

    def take(self, i, digest, start, raw, least) -> list[tuple]:
        if i is None:
            self.held.append((_unpack(raw), np.frombuffer(least, "<i8")))
            return []
        if self.hashes is None:
            h, ids = (np.concatenate([np.zeros(0, t), *(x[k] for x in self.held)]) for k, t in ((0, np.uint64), (1, np.int64)))
            order = np.argsort(h)
            self.hashes, self.ids, self.held = h[order], ids[order], []
        if not len(self.hashes):
            return []
        own = _unpack(raw)
        at = np.searchsorted(self.hashes, own)
        at[at == len(self.hashes)] = 0
        gone = (self.hashes[at] == own) & (self.ids[at] < i)
        return [(i, digest, a, b, self.key[0], None, None) for a, b in _spans(gone, start, self.width)]


def _count(batches, width: int, state: int):
    """Streams rows sorted by (anchor, part, share, id, digest, start); gives intervals of removed words (hashes
    null), and what is to be dealt again."""
    group = None
    for batch in batches:
        near = batch.column("anchor").to_numpy()
        alone = np.zeros(len(near), bool)  # an anchor that only one row has cannot repeat
        alone[1:-1] = (near[1:-1] != near[:-2]) & (near[1:-1] != near[2:])
        batch = batch.filter(pa.array(~alone))
        out = []
        for anchor, part, share, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group is None or group.key != (anchor, part, share):
                group = _Anchor((anchor, part, share), width, state) if share == _ONE else _Share((anchor, part, share), width)
            out += group.take(*row)
        yield from _rows(out, _OUT)


def removals(docs: DataFrame, id_col: str, text_col: str, width: int, state: int = STATE) -> DataFrame:
    """id, digest (of the text), spans: for each text the maximal intervals [start, stop) of words to remove."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("digest")).filter("id is not null and text is not null")
    hot, windows = _frequent(src, width)
    least, shares, parts = _least(src, width, hot, windows, state) if hot.any() else (None, {}, 1)

    def explode(batches):
        for batch in batches:
            ids, digests = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "digest"))
            for lo, hi, data, off in tx.rounds(batch.column("text")):
                got = runs(data, off, width)
                if got is None:
                    continue
                doc, start, anchor, packed, offsets = got
                own_id, own_digest, common = ids[lo:hi][doc], digests[lo:hi][doc], hot[anchor & (SLOTS - 1)]
                hashes = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).cast(pa.binary())
                n = len(doc)
                cols = [pa.array(anchor), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, _ONE, np.int32)), pa.array(own_id), pa.array(own_digest), pa.array(start.astype(np.int64)), hashes, pa.nulls(n, pa.binary())]
                whole = pa.RecordBatch.from_arrays(cols, schema=_IN)
                yield whole.filter(pa.array(~common)) if common.any() else whole
                yield from _rows([r for k in np.flatnonzero(common).tolist() for r in _shared(int(anchor[k]), int(own_id[k]), int(own_digest[k]), int(start[k]), hashes[k].as_py(), shares, parts)], _IN)

    rows = src.mapInArrow(in_task(explode), _IN_DDL)
    if least is not None:
        rows = rows.unionByName(_known(least, shares, parts))
    done, tables = None, [] if least is None else [least]
    while True:
        dealt = rows.repartition("anchor", "part", "share").sortWithinPartitions("anchor", "part", "share", F.col("id").asc_nulls_first(), "digest", "start")
        found = cut(dealt.mapInArrow(in_task(lambda b: _count(b, width, state)), _OUT_DDL), "windows")
        tables.append(found)
        part = found.filter("hashes is null").select("id", "digest", "start", "stop")
        done = part if done is None else done.unionByName(part)
        rest = found.filter("hashes is not null")
        if rest.isEmpty():
            break
        rows = rest.select("anchor", "part", "id", "digest", "start", "hashes").mapInArrow(in_task(_split), _IN_DDL)
    # the spans of one text are bounded by its own length
    out = cut(done.groupBy("id", "digest").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    discard(*tables)
    return out


def _frequent(src: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """For each of SLOTS hash values of anchors whether at least one in FREQUENT of all rows has it; and all windows."""

    def count(batches):
        slots, windows = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, off in tx.rounds(batch.column("text")):
                got = runs(data, off, width)
                if got is not None:
                    at = got[2] & (SLOTS - 1)
                    slots += np.bincount(at, minlength=SLOTS)
                    windows += np.bincount(at, np.diff(got[4]) // HASH_BYTES, SLOTS).astype(np.int64)
        at = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(slots[at]), pa.array(windows[at])], names=["slot", "n", "windows"])

    counted = cut(src.select("text").mapInArrow(in_task(count), "slot int, n long, windows long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows")), "slots")
    total, windows = counted.agg(F.sum("n"), F.sum("windows")).first()
    hot = np.zeros(SLOTS, bool)
    if (total or 0) > FREQUENT:
        for r in counted.filter(F.col("n") * FREQUENT >= total).collect():  # at most FREQUENT rows
            hot[r.slot] = True
    discard(counted)
    return hot, windows or 0


def _least(src: DataFrame, width: int, hot: np.ndarray, windows: int, state: int) -> tuple[DataFrame, dict[int, int], int]:
    """The repeated windows of frequent anchors with the smallest document of each; the shares over which the rows
    of some anchors are dealt; and the parts over which the windows of each are, so that one fits in memory."""

    def gather(batches):
        """Each task's windows of frequent anchors, combined before they are shuffled."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo, hi, data, off in tx.rounds(batch.column("text")):
                got = runs(data, off, width)
                if got is None:
                    continue
                doc, _, anchor, packed, offsets = got
                n = np.diff(offsets) // HASH_BYTES
                take = np.repeat(hot[anchor & (SLOTS - 1)], n)
                if take.any():
                    own = np.repeat(ids[lo:hi][doc], n)[take]
                    held.append((np.repeat(anchor, n)[take], _unpack(packed.tobytes()).view(np.int64)[take], own, own, np.ones(len(own), np.int64)))
                    size += len(own)
                    if size > COMBINE:
                        held = [_combined(held)]
                        size = len(held[0][0])
                        if 2 * size > COMBINE:
                            yield _table(held[0])
                            held, size = [], 0
        if held:
            yield _table(_combined(held))

    each = src.select("id", "text").mapInArrow(in_task(gather), "anchor long, hash long, least long, most long, n long")
    found = cut(each.groupBy("anchor", "hash").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")), "least")
    of = found.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.when(F.col("least") < F.col("most"), 1)).alias("kept"))
    # an anchor has several shares when it holds over one in FREQUENT of all windows: at most FREQUENT do
    shares = {r.anchor: -(-r.n * FREQUENT // windows) for r in of.filter(F.col("n") * FREQUENT > windows).collect()}
    parts = max(1, -(-(of.agg(F.max("kept")).first()[0] or 1) // state))
    return found, shares, parts


def _combined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One entry for each anchor and hash: least and most id, and how many."""
    anchor, hashes, low, high, n = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((hashes, anchor))
    anchor, hashes = anchor[order], hashes[order]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (hashes[1:] != hashes[:-1])]))
    return anchor[head], hashes[head], np.minimum.reduceat(low[order], head), np.maximum.reduceat(high[order], head), np.add.reduceat(n[order], head)


def _table(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "hash", "least", "most", "n"])


def _known(least: DataFrame, shares: dict[int, int], parts: int) -> DataFrame:
    """The repeated windows of each frequent anchor and part, packed, once for each share."""

    def pack(batches):
        for batch in batches:
            anchor, hashes, ids = (batch.column(c).to_numpy() for c in ("anchor", "hash", "least"))
            where = hashes % parts
            heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (where[1:] != where[:-1])])) if len(anchor) else np.zeros(0, int)
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(anchor)], strict=True):
                packed = _packed(hashes[a:b].view(np.uint64)), ids[a:b].astype("<i8").tobytes()
                yield from _rows([(int(anchor[a]), int(where[a]), s, None, None, None, *packed) for s in range(shares.get(int(anchor[a]), 1))], _IN)

    ranges = least.filter("least < most").select("anchor", "hash", "least", F.pmod("hash", F.lit(parts)).alias("part"))
    return ranges.repartition("anchor", "hash").sortWithinPartitions("anchor", "part").select("anchor", "hash", "least").mapInArrow(in_task(pack), _IN_DDL)


def _packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _shared(anchor: int, i: int, digest: int, start: int, raw: bytes, shares: dict[int, int], parts: int) -> list[tuple]:
    """The row of a frequent anchor at its share, its windows by part; consecutive windows stay together."""
    share = int(tx.mix(np.array([i, start], np.int64).view(tx.U)).sum(dtype=tx.U) % tx.U(shares.get(anchor, 1)))
    if parts == 1:
        return [(anchor, 0, share, i, digest, start, raw, None)]
    h = _unpack(raw)
    where = (h % tx.U(parts)).astype(np.int64)
    return [(anchor, int(where[g[0]]), share, i, digest, start + int(g[0]), _packed(h[g]), None) for g in np.split(np.arange(len(h)), np.flatnonzero(np.diff(where)) + 1)]


def _split(batches):
    """Deals the windows of each row over SPLIT times as many parts, by hash; equal windows stay together."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            h = _unpack(r["hashes"])
            to = tx.mix(h ^ tx.U(r["part"] + 1)) % tx.U(SPLIT)
            for s in np.unique(to):
                mine = np.flatnonzero(to == s)
                # rows keep runs of consecutive windows, so that intervals still start at their place
                for group in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1):
                    out.append((r["anchor"], r["part"] * SPLIT + int(s) + 1, _ONE, r["id"], r["digest"], None if r["start"] is None else r["start"] + int(group[0]), _packed(h[group]), None))
        yield from _rows(out, _IN)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, keep: list[str] | None = None, state: int = STATE) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default: all), then ``n_words``, ``n_removed``,
    ``kept_text`` (the words left, joined by one space) and ``removed`` (array of [start, stop) words).

    A word goes when a window over it also starts in a row with a smaller id; windows are judged on the
    input.  Rows with a null id have no order: they lose nothing and cause no loss.  Null and empty
    texts have no words.  Rows with the same id do not remove each other's words.  Ids are taken as 64-bit
    integers; an id that is none raises.
    """
    keep = docs.columns if keep is None else keep
    base = docs.select(*{c: None for c in [*keep, id_col, text_col]})
    key, dig, spans = unclash(base, "id_", "digest_", "spans_")
    names = unclash(docs.select(*keep), "n_words", "n_removed", "kept_text", "removed")
    found = removals(docs, id_col, text_col, width, state)
    found = found.select(F.col("id").alias(key), F.col("digest").alias(dig), F.col("spans").alias(spans))
    tagged = base.withColumn(key + "l", F.col(id_col).cast("long")).withColumn(dig + "l", F.xxhash64(F.col(text_col)))
    joined = tagged.join(found, (F.col(key + "l") == F.col(key)) & (F.col(dig + "l") == F.col(dig)), "left").select(*base.columns, spans)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    pair = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([base.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.LongType(), T.StringType(), pair), strict=True)])
    arrow_pair = to_arrow_type(pair)

    def run(batches):
        for batch in batches:
            texts, rows = batch.column(text_col), []
            cuts = batch.column(spans)
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["stop"]) for x in cuts[i].as_py() or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                left, at = [], 0
                for s, e in merged:
                    left += words[at:s]
                    at = e
                left += words[at:]
                rows.append((len(words), len(words) - len(left), b" ".join(left).decode(), [{"start": s, "stop": e} for s, e in merged]))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), arrow_pair), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cols, names=[*keep, *names])

    return joined.mapInArrow(in_task(run), schema)
