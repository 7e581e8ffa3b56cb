"""Corpus operators against brute force, on the small tables and on awkward rows."""

import collections
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import backoff, bpe, decontam, graph, idstore, jaccard, pii, quality, queries, ring, runtime, substring, text, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    """Null, empty, blank, very long, tied, repeated and near-equal texts."""
    rng = random.Random(11)
    base, passage = prose(rng, 300), prose(rng, 70)
    near = base.split()
    near[40], near[200] = "changed", "other"
    far = base.split()
    for i in range(0, 300, 12):
        far[i] = f"z{i}"
    texts = [
        None, "", "  \n\t ", "one", "One", "two words", base, base, " ".join(near), " ".join(far), base + " " + passage, passage, "x " * 30 + passage + " tail", prose(rng, 30000),
        "a" * 5000, "1" * 4000, "ü é 漢字 🙂 " * 20, "mail a.b@c.de, x@y, +1 (234) 555-0199, 4111 1111 1111 1111, 10.0.0.256 and 192.168.1.1.7", "a@b.co@d.ef_x@g.hi 4111-1111-1111-1112",
        "line\nline\nline\nother\n" * 4, "tab\tsep\x0bvt\x0cff\rcr\x1cfs\x85nel　wide", "  lead  and   gaps  ", "###" * 30, "0123456789 " * 500, "it's we'll I'd 12345 ٣٤ _under_",
    ]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def frame(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA)


def small(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d, [tuple(r) for r in d.collect()]


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def items(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_warc", "op3_quality", "op4_token_ids", "op5_backoff", "op7_bpe", "op8_pii", "op9_jaccard_join", "op10_substring"])
def test_query_on_small_tables(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    _, docs = small(spark, sf_dir)
    want = {
        "op1_decontamination": lambda: brute.decontamination(docs, items(spark, sf_dir)),
        "op2_warc": lambda: brute.warc([(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]),
        "op3_quality": lambda: brute.quality(docs),
        "op4_token_ids": lambda: brute.token_ids(docs, queries.tokenizer_file("byte_bpe_50k.json").decode()),
        "op5_backoff": lambda: brute.backoff(docs),
        "op7_bpe": lambda: brute.bpe(docs, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()),
        "op8_pii": lambda: brute.pii(docs),
        "op9_jaccard_join": lambda: brute.jaccard(docs),
        "op10_substring": lambda: brute.substring(docs),
    }[name]()
    if name == "op3_quality":
        df = df.drop("kept")
    if name == "op5_backoff":
        return same_scores(df.collect(), want)
    if name == "op8_pii":
        df = df.drop("spans")
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    assert got == sorted(want, key=lambda r: r[0])


def test_awkward_rows(spark, frame, awkward, sf_dir):
    bench = spark.createDataFrame([(1, awkward[11][1]), (1, awkward[11][1]), (2, None), (None, "two words"), (3, "two words"), (4, "")], "item_id long, text string")
    got = decontam.contamination(frame, bench, keep=["doc_id"])
    want = brute.decontamination(awkward, [(1, awkward[11][1]), (3, "two words"), (4, "")])
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items") == [w[:4] for w in want]
    for r in got.filter("n_hit > 0").collect():
        raw = (awkward[r.doc_id][1] or "").encode()
        assert sum(len(brute.ALNUM.findall(brute.low(raw[h.start : h.end].decode()))) for h in r.hits) == r.n_hit
    assert [w[:6] for w in brute.quality(awkward)] == rows(quality.score(frame, keep=["doc_id"]), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ranks, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    assert rows(bpe.round_trip(frame, ranks, pattern, keep=["doc_id"]), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.bpe(awkward, ranks, pattern)
    same_scores(backoff.score(frame).collect(), brute.backoff(awkward))
    base = F.filter("s", lambda x: x["base"])
    found = pii.detect(frame, out="s").select("doc_id", F.sha2(pii.spell(base).cast("binary"), 256).alias("h"))
    assert rows(found, "doc_id", "h") == [(r[0], r[5]) for r in brute.pii(awkward)]
    assert rows(jaccard.components(frame), "doc_id", "n_shingles", "component_id") == brute.jaccard(awkward)
    cut = substring.dedup_substrings(frame, keep=["doc_id"])
    assert rows(cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")), "doc_id", "n_words", "n_removed", "h") == brute.substring(awkward)
    tok = queries.tokenizer_file("byte_bpe_50k.json").decode()
    _, back = idstore.store(frame, tok)
    assert rows(back, "doc_id", "start", "n_tokens", "ids_crc32") == brute.token_ids([(d, t or "") for d, t in awkward], tok)


def test_windows_of_any_width_and_parts(spark, monkeypatch):
    """Windows narrower and wider than usual, a benchmark in many parts, letters whose bytes look like spaces."""
    rng = random.Random(4)
    words = ["à", "Ã\x85", "b", "c", "D", "é\xa0", "x1"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, line(rng.randrange(1, 30))) for i in range(40)] + [(3, line(20)), (41, "")]
    docs = [(i, line(rng.randrange(60)) + " " + rng.choice(bench)[1] + ", " + line(9)) for i in range(60)]
    df, items_ = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    for size in (1 << 20, 200):
        monkeypatch.setattr(decontam, "PART_BYTES", size)
        for n in (1, 2, 5, 13) if size > 200 else (13,):
            got = decontam.contamination(df, items_, window=n, keep=["doc_id"])
            assert rows(got, "doc_id", "n_words", "n_hit", "n_items") == [w[:4] for w in brute.decontamination(docs, bench, n)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    ranks, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    tok = queries.tokenizer_file("byte_bpe_50k.json").decode()
    for df in (
        decontam.contamination(none, bench), quality.score(none), bpe.round_trip(none, ranks, pattern), backoff.score(none), pii.detect(none), jaccard.components(none), jaccard.keep_one(none),
        substring.dedup_substrings(none), idstore.store(none, tok)[1], ring.assign(none), warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0


def test_clashing_columns_and_null_ids(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("n_words", T.StringType()), ("Kept", T.StringType()), ("id", T.StringType()), ("pii_spans", T.StringType()), ("spans_", T.StringType()), ("n_hit", T.StringType()), ("shard", T.StringType()), ("tags", T.ArrayType(T.StringType())))])
    long = "word " * 60
    data = [(1, long, "a", "b", "c", "d", "e", "f", "g", ["x"]), (1, long, "a", "b", "c", "d", "e", "f", "g", None), (None, long, *([None] * 8)), (2, None, *([None] * 8)), (3, "me@x.org", *([None] * 8))]
    df = spark.createDataFrame(data, schema)
    bench = spark.createDataFrame([(7, "word word")], "item_id long, text string")
    ranks, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    for out in (decontam.contamination(df, bench), quality.score(df), pii.detect(df), pii.redact(df), substring.dedup_substrings(df), ring.assign(df), bpe.encode(df, ranks, pattern)):
        assert out.count() == 5
        assert out.columns[: len(df.columns)] == df.columns
        assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert pii.redact(df).filter("doc_id = 3").first()["text"] == "<EMAIL>"
    comps = jaccard.components(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in comps), key=str) == sorted([(1, 1, 1), (1, 1, 1), (None, 1, None), (2, 0, 2), (3, 1, 3)], key=str)
    assert jaccard.keep_one(df).count() == 4
    tok = queries.tokenizer_file("byte_bpe_50k.json").decode()
    stored = idstore.store(df.select("doc_id", "text"), tok)[1].collect()
    assert sorted(((r.doc_id, r.copy) for r in stored), key=str) == sorted([(None, 0), (1, 0), (1, 1), (2, 0), (3, 0)], key=str)
    assert backoff.score(df).count() == 5


def test_near_copies_in_large_regions(spark, monkeypatch):
    """Groups above the direct size, and a recursion that memory does not end."""
    rng = random.Random(3)
    docs = []
    for _ in range(2):
        words = prose(rng, 120, 5000).split()
        for _ in range(20):
            w = list(words)
            for _ in range(rng.choice([1, 2, 4, 6])):
                w[rng.randrange(120)] = f"q{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + i, prose(rng, 60)) for i in range(10)]
    df = spark.createDataFrame(docs, SCHEMA)
    want = brute.jaccard(docs)
    assert rows(jaccard.components(df), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard, "REGION", 1)
    assert rows(jaccard.components(df), "doc_id", "n_shingles", "component_id") == want


def test_region_join_in_memory():
    rng = random.Random(9)
    for _ in range(20):
        sets = []
        for _ in range(rng.randint(2, 25)):
            if sets and rng.random() < 0.7:
                s = set(rng.choice(sets))
                for _ in range(rng.randint(0, 4)):
                    s.discard(next(iter(s), None))
                    s.add(rng.randrange(10**6))
            else:
                s = {rng.randrange(10**6) for _ in range(rng.randint(1, 30))}
            sets.append(s)
        comp = list(range(len(sets)))

        def root(x, comp=comp):
            while comp[x] != x:
                x = comp[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[max(root(i), root(j))] = min(root(i), root(j))
        got = list(range(len(sets)))

        def find(x, got=got):
            while got[x] != x:
                x = got[x]
            return x

        for a, b, inter, uni in jaccard.join_region(list(range(len(sets))), list(range(len(sets))), [np.array(sorted(s), np.uint64) for s in sets], 75):
            assert (inter, uni) == (len(sets[a] & sets[b]), len(sets[a] | sets[b]))
            got[max(find(a), find(b))] = min(find(a), find(b))
        assert [find(i) for i in range(len(sets))] == [root(i) for i in range(len(sets))]


def test_components_of_a_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = dict(tuple(r) for r in graph.connected(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: c for x, c in label.items() if x in got}
    assert all(label[x] == x for x in label if x not in got)


def test_stars_are_components_at_once(spark, monkeypatch):
    """Edges that already lead to the smallest node take no round, others no round that only looks for a change."""
    tables = []
    monkeypatch.setattr(graph, "cut", lambda df, label: tables.append(label) or runtime.cut(df, label))
    stars = [(i, 10 * (i // 10)) for i in range(100)] + [(20, 27), (33, 33)]
    chain = [(1, 2), (2, 3), (3, 4)]
    for edges, want, most in ((stars, {i: 10 * (i // 10) for i in range(100)}, 1), (chain, dict.fromkeys(range(1, 5), 1), 3), ([], {}, 1)):
        tables.clear()
        found = [tuple(r) for r in graph.connected(spark.createDataFrame(edges, "u long, v long")).collect()]
        assert dict(found) == want
        assert len(found) == len(want)
        assert len(tables) <= most


def test_windows_that_do_not_fit_in_memory(spark):
    rng = random.Random(2)
    shared = prose(rng, 55)
    docs = [(i, prose(rng, rng.randrange(40)) + " " + shared + " " + prose(rng, rng.randrange(60))) for i in range(40)]
    df = spark.createDataFrame(docs, SCHEMA)
    cut = substring.dedup_substrings(df, keep=["doc_id"], state=50)
    got = rows(cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")), "doc_id", "n_words", "n_removed", "h")
    assert got == brute.substring(docs)


def test_windows_of_one_anchor_are_arrays():
    """A large anchor's windows take some bytes each, not a Python number each, and none is lost or made up."""
    rng = np.random.default_rng(6)
    n, width, rows_ = substring.RECENT, 50, 12
    hashes = rng.integers(0, 1 << 48, (rows_, n), dtype=np.uint64)
    hashes[7, 100:160], hashes[11, 5:9], hashes[11, 20] = hashes[2, 300:360], hashes[10, :4], hashes[0, -1]
    packed = [substring._packed(h) for h in hashes]
    anchor = substring._Anchor((1, 0, -1), width, 1 << 21)
    out = []
    tracemalloc.start()
    for i, raw in enumerate(packed):
        out += anchor.take(i, 0, 0, raw, None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[:4] for r in out] == [(7, 0, 100, 159 + width), (11, 0, 5, 8 + width), (11, 0, 20, 20 + width)]
    assert most < 45e6  # a set of these 720,000 numbers takes more
    small_ = substring._Anchor((1, 0, -1), width, 5 * n)
    again = [r for i, raw in enumerate(packed) for r in small_.take(i, 0, 0, raw, None)]
    seen = np.concatenate([substring._unpack(r[6]) for r in again if r[0] is None])
    assert np.array_equal(np.sort(seen), np.unique(hashes[:6]))
    assert [r[0] for r in again if r[0] is not None] == list(range(6, rows_))


def test_frequent_anchors(spark, monkeypatch):
    """A passage that most documents share, in rows dealt over shares, and windows over parts."""
    rng = random.Random(8)
    shared = prose(rng, 70)
    docs = [(i, prose(rng, rng.randrange(30)) + " " + shared + " " + (shared if i % 9 == 0 else prose(rng, rng.randrange(40)))) for i in range(120)]
    df = spark.createDataFrame(docs + [(i, prose(rng, 80)) for i in range(120, 150)], SCHEMA)
    data = [tuple(r) for r in df.collect()]
    for top, state in ((512, 1 << 21), (4, 7)):
        monkeypatch.setattr(substring, "FREQUENT", top)
        monkeypatch.setattr(substring, "COMBINE", 1 << 20 if top > 4 else 50)
        cut = substring.dedup_substrings(df, keep=["doc_id"], state=state)
        got = rows(cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")), "doc_id", "n_words", "n_removed", "h")
        assert got == brute.substring(data)


def test_word_kernels():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n\tÜ漢é\x1c\x85") for _ in range(rng.randrange(40))) for _ in range(200)]
    import pyarrow as pa

    for _, _, data, off in text.rounds(pa.array(texts)):
        w = text.find_words(data, off, text.SPACED)
        h = text.hash_words(data, w)
        seen = {}
        for i, t in enumerate(texts):
            own = [bytes(data[s:e]).decode() for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
            assert own == brute.SPACED.findall(t)
            for word, code in zip(own, h[w.first[i] : w.first[i + 1]], strict=True):
                assert seen.setdefault(word, code) == code
        assert len(set(seen.values())) == len(seen)


def test_sharding_law(spark):
    df = spark.range(1003).select((F.col("id") * 7).alias("doc_id"))
    placed = ring.assign(df, "doc_id", 24).collect()
    by = {}
    for r in placed:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 24
    # limited movement: much less than dealing anew moves
    more = {r.doc_id: r.shard for r in ring.assign(df, "doc_id", 25).collect()}
    assert sum(more[r.doc_id] != r.shard for r in placed) < 0.5 * len(placed)
    rng = random.Random(8)
    for _ in range(50):
        owner = [rng.randrange(4) for _ in range(12)]
        owner[:4] = range(4)
        counts = [rng.randrange(9) for _ in owner]
        cap = ring.capacities(sum(counts), 4)
        ranges = ring.walk(owner, counts, cap)
        held = [0] * 4
        for _, a, b, s, first in ranges:
            assert first == held[s]
            held[s] += b - a
        assert held == cap


def test_sharding_query_on_real_and_awkward_rows(spark, sf_dir, awkward, tmp_path, monkeypatch):
    """Every column of the query, one key at a time: null texts, ties, and a row that repeats."""
    import zlib

    spark.createDataFrame([*awkward, awkward[7], (7, "other"), (None, "x"), (None, None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, bin_keys in ((sf_dir, 1 << 20), (str(tmp_path), 1 << 20), (sf_dir, 1)):
        monkeypatch.setattr(ring, "BIN_KEYS", bin_keys)
        monkeypatch.setattr(ring, "VIRTUAL", 64 if bin_keys > 1 else 2)
        df = spark.read.parquet(f"{folder}/documents.parquet")
        keys = [(r.p, (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))) for r in df.select("doc_id", "text", F.xxhash64("doc_id").alias("p")).collect()]
        if bin_keys > 1:
            got = queries.op6_sharding(spark, folder).collect()
            assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
            want = brute.sharding(keys, *ring.ring(24), 24)
        else:  # more bins than arcs
            sized = df.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
            got = ring.assign(sized, "doc_id", 24, 2, ("size", "text_crc32")).collect()
            want = brute.sharding(keys, *ring.ring(24, 2, len(keys)), 24)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=key) == sorted(want, key=key)


def test_token_ids_of_every_character(spark):
    """The id store's own split against the whole library."""
    from tokenizers import Tokenizer

    form = queries.tokenizer_file("byte_bpe_50k.json").decode()
    lib = Tokenizer.from_str(form)
    chars = [chr(c) for c in [*range(1, 0x3100), *range(0xFB00, 0xFFFF), *range(0x1F300, 0x1F400)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c} {c}{c}1 {c}b  {c}\n" for c in chars]
    width = 2 if lib.get_vocab_size() < 1 << 16 else 4
    got = idstore._tokenizer(form, width).encode(texts)
    bad = [hex(ord(c)) for c, t, g in zip(chars, texts, got, strict=True) if np.frombuffer(g, f"<u{width}").tolist() != lib.encode(t, add_special_tokens=False).ids]
    assert bad == []


def test_perfect_hash_and_shards(spark, tmp_path):
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    h = idstore.key_hash(keys, np.zeros(len(keys)))
    mph = idstore.PerfectHash.build(h)
    assert sorted(mph.slots(h).tolist()) == list(range(len(keys)))
    df = spark.createDataFrame([(5, "hello world"), (9, "a"), (None, "n")], SCHEMA)
    tok = queries.tokenizer_file("byte_bpe_50k.json").decode()
    manifest, _ = idstore.store(df, tok, where=f"file://{tmp_path}/ids")
    shards = [idstore.Shard(r.path) for r in manifest.collect()]
    from tokenizers import Tokenizer

    want = [*Tokenizer.from_str(tok).encode("hello world").ids, 0]
    assert [s.get(5).tolist() for s in shards if s.get(5) is not None] == [want]
    assert all(s.get(6) is None for s in shards)
    assert any(s.get(None) is not None for s in shards)


def test_archive_assembly(spark, tmp_path):
    pages = [(1, "http://a/\n b", "<p>WARC/1.1\r\n\r\nWARC/1.1</p>"), (2, None, "same"), (3, "u", "same"), (4, "u", None), (5, "u", ""), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write_archives(df, f"file://{tmp_path}/w")
    records = warc.read_archives(manifest)
    assert records.count() == 18
    # the other direction of the link, in another record
    flipped = records.filter("kind <> 'request'").withColumn("concurrent_to", F.when(F.col("kind") == "response", F.array(F.lit("<r>"))).otherwise(F.col("concurrent_to")))
    extra = spark.createDataFrame([("<r>", "request", "u", [], None, None, None, None, None)], records.schema)
    whole = warc.assemble(flipped.unionByName(extra)).collect()
    assert len(whole) == 6 and all(len(r.metadata) == 1 for r in whole)
    assert sum(r.request is not None for r in whole) == sum(r.kind == "response" for r in whole)
    back = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert back[1].payload == pages[0][2].encode() and back[1].request.record_id and back[3].refers_to == 2
    assert back[5].refers_to == 4 and back[5].payload_bytes == 0 and back[None].record_type == "revisit"


def test_archives_of_string_ids_and_damaged_records(spark, tmp_path):
    pages = [("a/1", "u", "same"), ("b 2", "u", "same"), ("", "u", "x"), (None, None, "y"), ("ü", "u", None), ("a/1", "u", "same")]
    df = spark.createDataFrame(pages, "page_id string, url string, html string").withColumn("kind", F.lit("clash")).withColumn("record_id", F.lit(1))
    back = warc.round_trip(df).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in back), key=str) == sorted([("a/1", "response", None), ("a/1", "response", None), ("b 2", "revisit", "a/1"), ("", "response", None), (None, "response", None), ("ü", "response", None)], key=str)
    good = warc.format_record([("WARC-Type", "request"), ("WARC-Record-ID", "<1>")], b"x")
    ends = {"none": b"", "line": b"noise\r\n", "length": b"WARC/1.1\r\nWARC-Type: request\r\n\r\n", "short": good[:-6]}
    for name, end in ends.items():
        (tmp_path / name).write_bytes(good + end)
        manifest = spark.createDataFrame([(f"file://{tmp_path}/{name}",), (None,)], "path string")
        kinds = [r.kind for r in warc.read_archives(manifest).collect()]
        assert kinds == ["request"] + ["damaged"] * (name != "none")
        if name != "none":
            with pytest.raises(Exception, match="WARC"):
                warc.read_archives(manifest, strict=True).count()


def test_pieces_of_bpe_match_merging():
    encoder = bpe.Bpe(bpe.read_ranks(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")), queries.split_pattern())
    rng = random.Random(6)
    for _ in range(400):
        raw = bytes(rng.choice(b"aeinrst '\xc3\xa9\xe6\xbc\xa2") for _ in range(rng.randrange(1, 24)))
        assert encoder.encode_piece(raw) == encoder.merge(raw) or raw in encoder.ranks
    assert encoder.decode(encoder.encode_piece(b"a" * 3000)) == b"a" * 3000


def test_split_pattern_on_every_character():
    import base64

    import tiktoken

    raw, pattern = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    encoder = bpe.Bpe(bpe.read_ranks(raw), pattern)
    chars = [chr(c) for c in [*range(1, 0x3100), *range(0xFB00, 0xFFFF), *range(0x1F300, 0x1F400)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c} {c}{c}1 {c}b  {c}" for c in chars]
    bad = [hex(ord(c)) for c, t, got in zip(chars, texts, encoder.encode(texts), strict=True) if np.frombuffer(got, "<u4").tolist() != enc.encode_ordinary(t)]
    assert bad == []


def test_weak_supervision_learns_who_is_right():
    """Labelers of known reliability: the fit finds them, and the classifier follows the good ones."""
    rng = random.Random(0)
    counts = {}
    truth = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        vote = lambda p, real=real: "+" if (rng.random() < p) == real else "-"
        sign = "0" + vote(0.95) + vote(0.9) + vote(0.85) + "0" + "m"
        counts[sign] = counts.get(sign, 0) + 1
        truth.setdefault(sign, []).append(real)
    model = pii.fit([(3, s, n) for s, n in sorted(counts.items())])
    right = sum(sum(t) if model.accepts(3, s) else len(t) - sum(t) for s, t in truth.items())
    assert right / 4000 > 0.93
    assert abs(model.reliability[3, 1, "+"][0] - 0.95) < 0.05 and abs(model.prior[3] - 0.4) < 0.06


def test_loose_spans(spark):
    texts = [f"call me by phone ({a}) 555-{b}" if i % 2 else f"phone {a}-555-{b} please" for i, (a, b) in enumerate((str(201 + i), str(1000 + 7 * i)) for i in range(60))]
    texts += ["mail jane [at] site [dot] org", "version 2001:0db8:0000:0000:0000:ff00:0042:8329 here", "order 111 111 1111"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = {r.doc_id: [(pii.KINDS[s.kind], texts[r.doc_id][s.start : s.end]) for s in r.s] for r in pii.detect(df, out="s").collect()}
    assert sum(bool(found[i]) for i in range(60)) > 50
    assert found[60] == [("email", "jane [at] site [dot] org")]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    bench = items(spark, sf_dir)
    current, frame = data, docs
    for name, stage in cp.STAGES[:-1]:
        frame = cp.cut(stage(spark, frame, sf_dir), f"test-{name}")
        assert frame.columns == docs.columns
        after = sorted((r.doc_id, r.text) for r in frame.collect())
        if name == "quality_rules":
            failed = {r[0] for r in brute.quality(current) if r[6]}
            assert {d for d, _ in after} <= {d for d, _ in current} - failed
            assert len(after) > 0.5 * len(current)
        elif name == "near_duplicates":
            assert [d for d, _ in after] == sorted({c for _, _, c in brute.jaccard(current)})
        elif name == "benchmark_decontamination":
            dirty = {r[0] for r in brute.decontamination(current, bench) if r[2] > 0}
            assert [d for d, _ in after] == sorted(d for d, _ in current if d not in dirty)
        else:
            left = brute.pii(after)
            assert len(after) == len(current) and all(sum(r[1:5]) == 0 for r in left)
            before = dict(current)
            clean = {r[0] for r in brute.pii(current) if sum(r[1:5]) == 0}
            assert all(t == before[d] for d, t in after if d in clean)
        current = after
    ids = {r.doc_id: r for r in cp.STAGES[-1][1](spark, frame, sf_dir).collect()}
    want = brute.bpe(current, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern())
    assert [(d, ids[d].n_tokens, brute.sha(bytes(ids[d].token_ids)), ids[d].decoded_sha256) for d, *_ in want] == want


def test_pipeline_stages_on_awkward_rows(spark, sf_dir, awkward):
    """Null, empty, long, tied and repeated rows, and columns whose names the operators use, through each stage."""
    import corpus_pipeline as cp

    names = {"doc_id": "long", "text": "string", "lang": "string", "n_chars": "long", "n_words": "string", "Kept": "string", "id": "string", "n_hit": "string", "gone_": "string", "key_": "string", "pii_spans": "string", "tags": "array<string>"}
    ddl = ", ".join(f"`{n}` {t}" for n, t in names.items())
    bench = items(spark, sf_dir)
    texts = [*awkward, (100, "so " + bench[0][1]), (100, "so " + bench[0][1]), (101, None), (None, awkward[6][1]), (None, None), (102, awkward[13][1] + " me@x.org")]
    data = [(d, t, "en", None if t is None else len(t), "a", "b", "c", "d", "e", "f", "g", ["x"]) for d, t in texts]
    frame = spark.createDataFrame(data, ddl)
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, frame, sf_dir)
        assert got.columns == list(names)
        after = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
        if name == "quality_rules":
            assert set(after) <= {(d, t) for (d, t), q in zip(texts, brute.quality(texts), strict=True) if not q[6]} and (None, None) not in after
        elif name == "near_duplicates":
            named = [(d, t) for d, t in texts if d is not None]
            kept = {c for _, _, c in brute.jaccard(named)}
            want = sorted({(d, t) for d, t in named if d in kept} | {x for x in texts if x[0] is None}, key=str)
            assert after == want
        elif name == "benchmark_decontamination":
            assert after == sorted(((d, t) for (d, t), r in zip(texts, brute.decontamination(texts, bench), strict=True) if not r[2]), key=str)
        else:
            assert len(after) == len(texts) and any(t and "<EMAIL>" in t for _, t in after)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    ids = cp.STAGES[-1][1](spark, frame, sf_dir)
    assert sorted((r.decoded_sha256 for r in ids.collect())) == sorted(brute.sha(t or "") for _, t in texts)
    none = spark.createDataFrame([], ddl)
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    """Every column of the queries that SQL can express, in DuckDB on the same tables."""
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    cur = con.execute(queries.oracle_sql()[name])
    order = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in order]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == order
    assert sorted((tuple(r) for r in df.select(*order).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)


def same_scores(got, want):
    got = sorted(map(tuple, got), key=str)
    want = sorted(want, key=str)
    assert [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] == pytest.approx(w[2], abs=1e-4) and (g[3] is None and w[3] is None or g[3] == pytest.approx(w[3], abs=2e-6))


def test_orders_and_levels_of_backoff(spark, sf_dir, frame, awkward, monkeypatch):
    """Blocks and ranges so small that the rows are dealt over three levels, and back."""
    _, docs = small(spark, sf_dir)
    df = spark.createDataFrame(docs, SCHEMA)
    same_scores(backoff.score(df, order=1).collect(), brute.backoff(docs, order=1))
    same_scores(backoff.score(frame, order=2).collect(), brute.backoff(awkward, order=2))
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(backoff, "BUCKET_GRAMS", 500)
    monkeypatch.setattr(backoff, "FAN_BITS", 3)
    assert len(backoff._levels(8)) == 3
    same_scores(backoff.score(df).collect(), brute.backoff(docs))
    same_scores(backoff.score(frame).collect(), brute.backoff(awkward))


def test_packed_runs():
    rng = np.random.default_rng(5)
    for top in (1, 200, 1 << 20, 1 << 45, 1 << 63):
        sizes = rng.integers(0, 40, 12)
        runs = [np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True)) for n in sizes]
        values = np.concatenate(runs)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        assert (backoff.unpack(backoff.pack(values, first), sizes) == values).all()


def test_longer_context_tells_texts_apart(spark):
    """The second text recombines the bigrams of the others."""
    df = spark.createDataFrame([(1, "x a y a w a z"), (2, "x a w a y a z"), (3, "x a y a w a z"), (4, "q r s")], SCHEMA)
    run = lambda n: {r.doc_id: r for r in backoff.score(df, order=n).collect()}
    two, three = run(2), run(3)
    assert two[1].log_score == pytest.approx(two[2].log_score)
    assert three[1].n_known == 5 and three[2].n_known == 2  # a y a, a w a
    assert three[1].log_score > three[2].log_score


def test_symbols_and_short_repeated_lines(spark):
    """Texts past the bound of one rule alone, and one within all bounds."""
    words = " ".join(f"w{i}" for i in range(100))
    lines = "\n".join(f"longer line number {i} of words u{i} v{i} x{i} y{i} z{i}" for i in range(10))
    data = [(1, words), (2, words + " #" * 20), (3, words + " #" * 5), (4, lines + "\nab" * 10), (5, lines)]
    kept = {r.doc_id: r.kept for r in quality.score(spark.createDataFrame(data, SCHEMA), keep=["doc_id"], rules=quality.RepetitionRules(top={}, covered={})).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: False, 5: True}
