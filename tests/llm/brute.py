"""The operators' contracts in plain Python, without hashing or Spark."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import re
import struct
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def decontamination(docs, items, n=13):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for d, text in docs:
        w = ALNUM.findall(low(text))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                g = tuple(w[i : i + size])
                if g in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def warc(pages):
    first = {}
    for p, html in pages:
        k = html or ""
        first[k] = min(first.get(k, p), p)
    out = []
    for p, html in pages:
        raw = (html or "").encode()
        own = first[html or ""] == p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""]))
    return out


def quality(docs):
    out = []
    for d, text in docs:
        t = text or ""
        w = SPACED.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return out


def token_ids(docs, tokenizer_json):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_str(tokenizer_json), 0, []
    for d, text in sorted(docs):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def backoff(docs, alpha=0.4, order=3):
    words = [SPACED.findall(t or "") for _, t in docs]
    grams = lambda ws, n: collections.Counter(zip(*(ws[i:] for i in range(n)), strict=False))
    every = {n: sum((grams(ws, n) for ws in words), collections.Counter()) for n in range(1, order + 1)}
    corpus, out = sum(every[1].values()), []
    for (d, _), ws in zip(docs, words, strict=True):
        own = {n: grams(ws, n) for n in every}
        other = lambda g, own=own: every[len(g)][g] - own[len(g)][g]
        score = known = 0
        for i in range(len(ws)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(ws[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log(max(other(g), 0.5) / max(corpus - len(ws), 1))
                    known += order == 1 and other(g) > 0
                elif other(g) > 0:
                    score += math.log(other(g) / max(other(g[:-1]), 1))
                    known += n == order
                    break
                else:
                    score += math.log(alpha)
        out.append((d, len(ws), score, score / len(ws) if ws else None, known))
    return out


def bpe(docs, rank_file, pattern):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, text in docs:
        ids = enc.encode_ordinary(text or "")
        out.append((d, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or "")))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return total % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(docs):
    out = []
    for d, text in docs:
        spans, counts = [], []
        for kind, pattern in BASE.items():
            n = 0
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                    continue
                if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                    continue
                if kind == "phone" and not 8 <= len(digits) <= 15:
                    continue
                n += 1
                spans.append(f"{kind}:{m.start()}:{m.end()}")
            counts.append(n)
        out.append((d, *counts, sha(",".join(spans))))
    return out


def jaccard(docs, k=5, share=75):
    sets = []
    for _, text in docs:
        w = SPACED.findall(low(text))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = {d: d for d, _ in docs}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            s, t = sets[i], sets[j]
            if s and t and 100 * len(s & t) >= share * len(s | t):
                x, y = root(a), root(docs[j][0])
                comp[max(x, y)] = min(x, y)
    return [(d, len(s), root(d)) for (d, _), s in zip(docs, sets, strict=True)]


def substring(docs, width=50):
    words = [(d, SPACED.findall(t or "")) for d, t in docs]
    low_id = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            low_id[g] = min(low_id.get(g, d), d)
    out = []
    for d, w in words:
        gone = {k for i in range(len(w) - width + 1) if low_id[tuple(w[i : i + width])] < d for k in range(i, i + width)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def sharding(rows, ends, owner, shards):
    """(id, size, crc) and place on the ring -> shard, slot, one key at a time: home first, then clockwise."""
    arcs = [[] for _ in ends]
    for place, key in rows:
        at = next((i for i, e in enumerate(ends) if place <= e), 0)
        arcs[at].append((place, key))
    for a in arcs:
        a.sort(key=lambda r: (r[0], (r[1][0] is not None, r[1][0]), *r[1][1:]))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    out, used, over = [], [0] * shards, []

    def give(key, s):
        out.append((*key, s, used[s]))
        used[s] += 1
        room[s] -= 1

    for i, a in enumerate(arcs):
        for _, key in a:
            give(key, owner[i]) if room[owner[i]] else over.append((i, key))
    for i, key in over:
        while not room[owner[(i + 1) % len(ends)]]:
            i += 1
        give(key, owner[(i + 1) % len(ends)])
    return out
