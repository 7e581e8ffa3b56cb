"""Byte-level BPE from rank files, in time linear in the text.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds
every token that ends at each place of a piece.  Encoding goes left to right with the longest token, and
steps back when it cannot stand next to the one before: two tokens are compatible when merging their
joined bytes by rank gives just these two.  A sequence of tokens whose neighbours are all compatible is
the one that merging the whole piece gives.  Compatibility is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgraph.llm.chunks import ChunkEncoder, spelled_out
from quillgraph.llm.runtime import held, in_task, prepare, unclash

#: Entries of each memo, which starts anew when it is full, and chunks of a generation: some 110 MB in all.
MEMO, CHUNKS = 200_000, 250_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.split = regex.compile(spelled_out(pattern)).findall
        self.trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.trie.add_word(token.decode("latin-1"), (i, len(token)))
        self.trie.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.whole: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks = ChunkEncoder(self._encode_chunks, CHUNKS)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of a short byte string by repeated merging of the pair of lowest rank, the leftmost first."""
        ranks, parts = self.ranks, [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if key not in self.pairs:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            self.pairs[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self.pairs[key]

    def reachable(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token; some vocabularies hold others."""
        if token not in self.whole:
            self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        return self.whole[token]

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        if token not in self.shorter:
            raw = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.ranks), None)
        return self.shorter[token]

    def encode_piece(self, raw: bytes) -> list[int]:
        """The ids of one match of the split pattern."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        longest: list[int] = [-1] * len(raw)
        for end, (i, n) in self.trie.iter(raw.decode("latin-1")):
            longest[end - n + 1] = i  # ends come in ascending order, so the last is the longest
        dead = bytearray(len(raw) + 1)  # places from which no compatible way on is left
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(raw):
            while token is not None:
                end = at + len(self.bytes_of[token])
                if not dead[end] and self.reachable(token) and (not out or self.compatible(out[-1], token)):
                    break
                token = self.prefix(token)
            if token is None:
                dead[at] = 1
                last = out.pop()
                at -= len(self.bytes_of[last])
                token = self.prefix(last)
            else:
                out.append(token)
                at = end
                token = longest[at] if at < len(raw) else None
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        pieces, split, out = self.pieces, self.split, []
        for c in chunks:
            packed = []
            for p in split(c):
                ids = pieces.get(p)
                if ids is None:
                    ids = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
                    if len(p) < 64:
                        if len(pieces) >= MEMO:
                            pieces.clear()
                        pieces[p] = ids
                packed.append(ids)
            out.append(b"".join(packed))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.chunks.encode(texts)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _map_text(docs: DataFrame, text_col: str, rank_file: bytes, pattern: str, keep: list[str], new: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    prepare(docs.sparkSession)
    base = docs.select(*{c: None for c in [*keep, text_col]})
    names = unclash(docs.select(*keep), *(n for n, _, _ in new))
    schema = T.StructType([base.schema[c] for c in keep] + [T.StructField(n, k) for n, (_, k, _) in zip(names, new, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)  # one vocabulary: a fixed size
    key = hashlib.sha1(rank_file + pattern.encode()).hexdigest()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                rows = make(held(key, lambda: Bpe(read_ranks(shared.value), pattern)), batch.column(text_col))
                cols = [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), new, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cols, names=[*keep, *names])

    return base.mapInArrow(in_task(run, key), schema)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row: the columns ``keep`` (default: all) and ``token_ids`` (array of int) of the whole text.

    Null and empty texts have no ids.  Text that spells a special token is ordinary text.
    """

    def make(bpe, texts):
        return [(np.frombuffer(p, "<u4").astype(np.int32),) for p in bpe.encode([t or "" for t in texts.to_pylist()])]

    keep = docs.columns if keep is None else keep
    return _map_text(docs, text_col, rank_file, pattern, keep, [("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], make)


def decode(docs: DataFrame, rank_file: bytes, pattern: str, ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """One row per row: the columns ``keep`` (default: all) and ``decoded`` (binary) of the ids; null gives empty bytes."""

    def make(bpe, ids):
        return [(bpe.decode(x or ()),) for x in ids.to_pylist()]

    keep = docs.columns if keep is None else keep
    return _map_text(docs, ids_col, rank_file, pattern, keep, [("decoded", T.BinaryType(), pa.binary())], make)


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes and decodes each whole text: the columns ``keep``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Null and empty texts have no ids, and the digests of no bytes; rows that repeat are encoded each for itself;
    a new column whose name is taken gets underscores.
    """

    def make(bpe, texts):
        rows = []
        for packed in bpe.encode([t or "" for t in texts.to_pylist()]):
            ids = np.frombuffer(packed, "<u4").tolist()
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return rows

    keep = docs.columns if keep is None else keep
    new = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _map_text(docs, text_col, rank_file, pattern, keep, new, make)


def encode_checked(docs: DataFrame, rank_file: bytes, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, ``n_tokens``, ``token_ids`` (little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` of the bytes that the ids decode to.

    Null and empty texts have no ids; rows that repeat are encoded each for itself; a new column whose name is
    taken gets underscores.
    """

    def make(bpe, texts):
        rows = []
        for packed in bpe.encode([t or "" for t in texts.to_pylist()]):
            ids = np.frombuffer(packed, "<u4").tolist()
            rows.append((len(ids), packed, hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return rows

    keep = docs.columns if keep is None else keep
    new = [("n_tokens", T.LongType(), pa.int64()), ("token_ids", T.BinaryType(), pa.binary()), ("decoded_sha256", T.StringType(), pa.string())]
    return _map_text(docs, text_col, rank_file, pattern, keep, new, make)
