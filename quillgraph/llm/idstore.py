"""Token ids in binary shards with constant-time access by document key.

A shard holds the raw ids of its documents one after another, then an index: a minimal perfect hash gives
every key a slot of its own in 0..n-1, and the slot holds the key's fingerprint, the place of its first id
and the number of its ids.  A key that was never stored is refused when its fingerprint differs.

Layout of a shard (little endian)::

    ids            n_ids x 2 or 4 bytes
    keys           n x i8     in the order of the ids (0 for a null key)
    copy           n x u4     0, 1, 2 ... of rows with the same key; 2**31 is added for a null key
    fingerprint    n x u4     by slot
    start          n x i8     by slot, in ids from the start of the shard
    count          n x u4     by slot
    levels         bit arrays of the hash, 64-bit words
    footer         JSON, then its length (u4) and the magic QGID
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as tx
from quillgraph.llm.chunks import ChunkEncoder, spelled_out
from quillgraph.llm.runtime import cut, file_system, fresh, held, in_task, prepare

MAGIC = b"QGID"
NULL = 1 << 31


def key_hash(keys: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return tx.mix(tx.mix(keys.astype(np.int64).view(tx.U)) + copy.astype(tx.U))


class PerfectHash:
    """Cascade of bit arrays: at each level the keys that hit a bit alone keep it, the others go on."""

    GAMMA = 2

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [len(x) * 64 for x in levels]
        ones = [np.bitwise_count(x).astype(np.int64) for x in levels]
        self.rank, base = [], 0
        for o in ones:
            self.rank.append(base + np.cumsum(o) - o)
            base += int(o.sum())

    @staticmethod
    def place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tx.mix(h + tx.U(level * 0x9E3779B9 + 1)) % tx.U(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        if len(np.unique(h)) != len(h):
            raise ValueError("two keys have the same 64-bit hash")
        levels, rest = [], h
        while len(rest):
            size = max(64, -(-cls.GAMMA * len(rest) // 64) * 64)
            at = cls.place(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for one that hits no bit."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if not len(left):
                break
            at = self.place(h[left], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.rank[level][at[hit] >> 6] + below
            left = left[~hit]
        return out


def write_index(sink, n_ids: int, width: int, keys: np.ndarray, copy: np.ndarray, counts: np.ndarray) -> None:
    """Ends a shard whose ids are written."""
    h = key_hash(keys, copy)
    mph = PerfectHash.build(h)
    slot = mph.slots(h)
    starts = np.cumsum(counts) - counts
    by_slot = lambda a, t: (lambda out: (out.__setitem__(slot, a), out)[1])(np.zeros(len(slot), t))
    sections = [keys.astype("<i8"), copy.astype("<u4"), by_slot(h & tx.U(0xFFFFFFFF), "<u4"), by_slot(starts, "<i8"), by_slot(counts, "<u4"), *mph.levels]
    for s in sections:
        sink.write(np.ascontiguousarray(s).tobytes())
    footer = json.dumps({"n": len(keys), "n_ids": n_ids, "width": width, "levels": [len(x) for x in mph.levels]}).encode()
    sink.write(footer + struct.pack("<I", len(footer)) + MAGIC)


@dataclass
class Shard:
    """A shard open for reading: the index in memory, ids read where they are asked for."""

    uri: str

    def __post_init__(self):
        fs, path = file_system(self.uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(8, size - 8)
        if tail[4:] != MAGIC:
            raise ValueError(f"not a shard of token ids: {self.uri}")
        length = struct.unpack("<I", tail[:4])[0]
        meta = json.loads(self.file.read_at(length, size - 8 - length))
        self.width, self.n, self.n_ids = meta["width"], meta["n"], meta["n_ids"]
        at = self.n_ids * self.width
        raw, here = self.file.read_at(size - 8 - length - at, at), 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal here
            a = np.frombuffer(raw, kind, n, here)
            here += a.nbytes
            return a

        self.keys, self.copy, self.finger, self.start, self.count = (take(t, self.n) for t in ("<i8", "<u4", "<u4", "<i8", "<u4"))
        self.mph = PerfectHash([take("<u8", m) for m in meta["levels"]])

    def locate(self, keys: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """The slot of each (key, copy); -1 for one that is not stored."""
        h = key_hash(keys, copy)
        slot = self.mph.slots(h)
        known = slot >= 0
        known[known] = self.finger[slot[known]] == (h[known] & tx.U(0xFFFFFFFF)).astype(np.uint32)
        return np.where(known, slot, -1)

    def ids(self, slot: int) -> np.ndarray:
        raw = self.file.read_at(int(self.count[slot]) * self.width, int(self.start[slot]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def get(self, key: int | None, copy: int = 0) -> np.ndarray | None:
        slot = self.locate(np.array([key or 0]), np.array([copy + (NULL if key is None else 0)]))[0]
        return None if slot < 0 else self.ids(slot)


#: The split of byte-level tokenizers, and the characters that it takes for white space (fixed values).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids are held; as with chunks, twice as many at most.
PIECES = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Marks that end a word and are a piece of their own.
_STOPS = frozenset(".,;:!?")


class _Pieces:
    """Ids of chunks from those of their pieces, which the library's model makes."""

    def __init__(self, tokenizer_json: str, width: int):
        import regex
        from tokenizers import Tokenizer

        form = json.loads(tokenizer_json)
        pre = form.get("pre_tokenizer") or {}
        if form.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without a normaliser or a prefix space is needed")
        self.whole = Tokenizer.from_str(tokenizer_json)
        self.model = self.whole.model
        self.marks = [t["content"] for t in form.get("added_tokens", [])]
        self.code = "H" if width == 2 else "I"
        self.split = regex.compile(spelled_out(BYTE_LEVEL)).findall
        self.letters = byte_letters()
        self.space = self.letters[0x20]
        self.wordy = any(m.isalpha() for m in self.marks)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        a = array(self.code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def piece(self, p: str) -> bytes:
        out = self.old.get(p)
        if out is None:
            # ASCII letters stand for themselves, and a space can only come first
            plain = self.space + p[1:] if p[0] == " " and p.isascii() and p[1:].isalpha() else p.encode().decode("latin-1").translate(self.letters)
            out = self.pack([t.id for t in self.model.tokenize(plain)])
        if len(p) < 64:
            if len(self.known) >= PIECES:
                self.known, self.old = {}, self.known
            self.known[p] = out
        return out

    def chunk(self, c: str) -> bytes:
        if c[:1] == " " and not self.wordy:
            known, body = self.known, c[1:]
            if body.isalpha():  # one piece: a space and letters
                return known.get(c) or self.piece(c)
            if body[-1:] in _STOPS and body[:-1].isalpha():  # two: the mark is one of its own
                head, stop = c[:-1], body[-1]
                return (known.get(head) or self.piece(head)) + (known.get(stop) or self.piece(stop))
        if any(m in c for m in self.marks):  # a special token's own text
            return self.pack(self.whole.encode(c, add_special_tokens=False).ids)
        known = self.known
        return b"".join([known.get(p) or self.piece(p) for p in self.split(c)])

    def many(self, chunks: list[str]) -> list[bytes]:
        return [self.chunk(c) for c in chunks]


def _tokenizer(tokenizer_json: str, width: int) -> ChunkEncoder:
    """A cached encoder of the tokenizers library, for byte-level vocabularies without a normaliser."""
    return held(_key(tokenizer_json, width), lambda: ChunkEncoder(_Pieces(tokenizer_json, width).many))


def _key(tokenizer_json: str, width: int) -> str:
    return f"{zlib.crc32(tokenizer_json.encode())}-{len(tokenizer_json)}-{width}"


def write_shards(docs: DataFrame, tokenizer_json: str, where: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encodes every whole text and writes shards below ``where`` in ascending key order.

    Gives shard (its place in the order), path, n_docs, n_ids.  A null text is empty; null keys come
    first; rows that repeat a key are kept as copies 0, 1, 2 ... of it.  Each attempt of a task writes
    a file of its own, and only files of attempts that ended are listed, so a lost executor does no harm.
    Keys are taken as 64-bit integers; one that is none raises.  An empty table has no shards.
    """
    spark = docs.sparkSession
    prepare(spark)
    ids_max = max(max(json.loads(tokenizer_json)["model"]["vocab"].values()), end_id, *(t["id"] for t in json.loads(tokenizer_json).get("added_tokens", [{"id": 0}])))
    width = 2 if ids_max < 1 << 16 else 4
    shared = spark.sparkContext.broadcast(tokenizer_json)  # one tokenizer: a fixed size
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # rows with equal keys are ordered by their text
    dealt = src.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches):
        sink = None
        keys, nulls, counts = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                tok = _tokenizer(shared.value, width)
                fs, base = file_system(where)
                fs.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.ids"
                sink = fs.open_output_stream(f"{base}/{name}")
            ids = batch.column("id")
            keys.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
            texts = batch.column("text")
            for lo in range(0, batch.num_rows, 64):
                for packed in tok.encode([t or "" for t in texts.slice(lo, 64).to_pylist()]):
                    sink.write(packed + end)
                    counts.append(len(packed) // width + 1)
        if sink is None:
            return
        k, z, c = np.concatenate(keys), np.concatenate(nulls), np.array(counts, np.int64)
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (z[1:] != z[:-1])
        begin = np.flatnonzero(head)
        copy = np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k)))) + np.where(z, NULL, 0)
        write_index(sink, int(c.sum()), width, k, copy, c)
        sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([f"{where}/{name}"]), pa.array([len(k)]), pa.array([int(c.sum())])], names=["shard", "path", "n_docs", "n_ids"])

    return cut(dealt.mapInArrow(in_task(run, _key(tokenizer_json, width)), "shard long, path string, n_docs long, n_ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, copy, start (ids of all documents before it), n_tokens, ids_crc32 of every stored document.

    Each document is found through its shard's index, its fingerprint checked.
    """
    spark = manifest.sparkSession
    rows = manifest.orderBy("shard").collect()  # one row for a shard of many megabytes
    base, listed = 0, []
    for r in rows:
        listed.append((r.path, base))
        base += r.n_ids
    if not listed:
        return spark.createDataFrame([], "doc_id long, copy long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for uri, before in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(uri)
                for lo in range(0, shard.n, 4096):
                    keys, copy = shard.keys[lo : lo + 4096], shard.copy[lo : lo + 4096]
                    slots = shard.locate(keys, copy)
                    if (slots < 0).any():
                        raise ValueError(f"{uri}: a stored key is not found")
                    crc = [zlib.crc32(shard.ids(s).tobytes()) for s in slots.tolist()]
                    none = copy >= NULL
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=none), pa.array(np.where(none, copy - np.uint32(NULL), copy).astype(np.int64)), pa.array(before + shard.start[slots]), pa.array(shard.count[slots].astype(np.int64)), pa.array(crc, pa.int64())],
                        names=["doc_id", "copy", "start", "n_tokens", "ids_crc32"],
                    )

    paths = spark.createDataFrame(listed, "path string, base long").repartition(len(listed))
    return paths.mapInArrow(run, "doc_id long, copy long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer_json: str, where: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(manifest, documents read back) of the shards written below ``where`` (default: the shared folder)."""
    manifest = write_shards(docs, tokenizer_json, where or fresh(docs.sparkSession, "ids"), **how)
    return manifest, read_shards(manifest)
