"""Encoding of texts by cached chunks.

The split patterns of byte-level BPE begin a new piece at every space that a non-space character follows,
and let no piece end with such a space.  So a text may be cut there, and each chunk be encoded by itself
with its leading space.  Natural text repeats its chunks, and a chunk's ids are cached as packed bytes.
"""

from __future__ import annotations

from collections.abc import Callable

#: Chunks of the young generation: when it is full it becomes the old one, from which chunks come back that
#: are met again.  Both together hold some 200 MB at most.
CAPACITY = 600_000

#: The characters with the property White_Space, which split patterns mean by \\s (fixed values).
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def spelled_out(pattern: str) -> str:
    """A split pattern with its white space as a list of characters, whatever a library counts as such."""
    for short, full in ((r"[^\s", f"[^{WHITE}"), (r"\s", f"[{WHITE}]"), (r"\S", f"[^{WHITE}]")):
        pattern = pattern.replace(short, full)
    return pattern


def cut_points(text: str) -> list[str]:
    """The chunks of a text; all but the first lack the space they begin with."""
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(p)
        else:  # inside a longer run of white space
            out[-1] += " " + p
    return out


class ChunkEncoder:
    """Encodes texts with ``encode_many``, which gives packed ids for each of a list of chunks."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], capacity: int = CAPACITY):
        self.encode_many = encode_many
        self.capacity = capacity
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Makes the ids of chunks known."""
        back = {c: self.old[c] for c in chunks if c in self.old}
        self.known.update(back)
        fresh = list(chunks - back.keys())
        self.known.update(zip(fresh, self.encode_many([" " + c for c in fresh]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.capacity:
            self.known, self.old = {}, self.known
        known = self.known
        heads, tails = [], []
        for t in texts:
            head, *tail = t.split(" ")
            heads.append(head)
            tails.append(tail)
        # chunks that begin with white space, or are empty, are never known under such a key
        new = set().union(*tails).difference(known)
        odd = {c for c in new if not c or c[0].isspace()}
        if odd:
            for i, tail in enumerate(tails):
                if not odd.isdisjoint(tail):
                    heads[i], *tails[i] = cut_points(texts[i])
            new = set().union(*tails).difference(known)
        self.learn(new)
        get = known.__getitem__
        return [head + b"".join(map(get, tail)) for head, tail in zip(self.encode_many(heads), tails, strict=True)]
