"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import backoff, bpe, decontam, idstore, jaccard, pii, quality, ring, substring, warc

#: Files of the public tokenizers; the folder is a parameter.
TOKENIZERS = None


def tokenizer_file(name: str, folder: str | None = None) -> bytes:
    folder = folder or TOKENIZERS
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = f"{folder}/{name}"
    with open(path, "rb") as f:
        return f.read()


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    joined = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined.cast("binary"), 256).alias("items_sha256"), decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, back = idstore.store(docs, tokenizer_file("byte_bpe_50k.json").decode())
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = backoff.score(docs, order=3)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("per_word", 6).alias("per_word"), "n_known")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = ring.assign(sized, "doc_id", 24, tie_cols=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern(), keep=["doc_id"])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, out="spans_found").select("doc_id", "spans_found")
    base = F.filter("spans_found", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans_found", lambda s: s["base"] & (s["kind"] == pii.KINDS.index(k)))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(pii.spell(base).cast("binary"), 256).alias("base_sha256"), pii.spell(F.col("spans_found")).alias("spans"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.components(docs)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.dedup_substrings(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_warc, op3_quality, op4_token_ids, op5_backoff, op6_sharding, op7_bpe, op8_pii, op9_jaccard_join, op10_substring, pipeline)
    return {f.__name__: f for f in own}


_ITEM_WINDOWS = r"""
  items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
    FROM benchmark),
  windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0))"""

ORACLE = {
    "op1_decontamination": rf"""
WITH {_ITEM_WINDOWS},
  d AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+'), []) AS w
    FROM documents),
  sizes AS (SELECT DISTINCT n FROM windows),
  starts AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
  hits AS (SELECT doc_id, s.n, i, item_id FROM starts s JOIN windows x ON s.n = x.n AND s.g = x.g),
  words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
  found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  k AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p),
  b AS (SELECT *, array_to_string(list_transform(string_split(s, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c)::INT - 1) + 1, 4)), '') AS bits FROM k)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b""",
    "op3_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x{20}\x{09}-\x{0D}]+'), []) AS w FROM documents),
  g AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, generate_series(2, 10) AS s(n) WHERE len(w) >= n)),
  again AS (
    SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c, min(i) OVER (PARTITION BY doc_id, n, g) AS f FROM g) WHERE c > 1),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM d WHERE len(w) > 0),
  three AS (SELECT doc_id, count(DISTINCT k) AS n_repeat FROM (SELECT doc_id, unnest(generate_series(i, i + 2)) AS k FROM again WHERE n = 3) GROUP BY doc_id),
  top AS (SELECT doc_id, n, max(c * (length(g) - n + 1)) AS chars FROM again WHERE n <= 4 GROUP BY doc_id, n),
  later AS (SELECT DISTINCT doc_id, n, unnest(generate_series(i, i + n - 1)) AS k FROM again WHERE n >= 5 AND i > f),
  covered AS (SELECT doc_id, n, sum(length(word)) AS chars FROM later JOIN words USING (doc_id, k) GROUP BY doc_id, n),
  bounds(n, bound) AS (VALUES (2, 0.20::DOUBLE), (3, 0.18), (4, 0.16), (5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10)),
  totals AS (SELECT doc_id, sum(length(word)) AS chars FROM words GROUP BY doc_id),
  over AS (
    SELECT doc_id, bool_or(x.chars::DOUBLE / t.chars / bound > 1) AS failed
    FROM (SELECT * FROM top UNION ALL SELECT * FROM covered) x JOIN totals t USING (doc_id) JOIN bounds USING (n) GROUP BY doc_id),
  lines AS (SELECT * FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x{20}\x{09}-\x{0D}]')),
  kinds AS (SELECT doc_id, line, count(*) AS c FROM lines GROUP BY doc_id, line),
  dups AS (SELECT doc_id, sum(c) AS n_lines, sum(c - 1) AS n_dup, sum(c * length(line)) AS chars, sum((c - 1) * length(line)) AS dup_chars FROM kinds GROUP BY doc_id),
  base AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(totals.chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
      coalesce(failed, false) OR coalesce(n_dup::DOUBLE / n_lines / 0.30::DOUBLE > 1, false) OR coalesce(dup_chars::DOUBLE / greatest(dups.chars, 1) / 0.20::DOUBLE > 1, false) AS repeats
    FROM d LEFT JOIN totals USING (doc_id) LEFT JOIN three USING (doc_id) LEFT JOIN over USING (doc_id) LEFT JOIN dups USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR repeats OR n_symbols::DOUBLE / greatest(n_words, 1) / 0.10::DOUBLE > 1) AS kept
FROM base""",
    "op5_backoff": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x{20}\x{09}-\x{0D}]+'), []) AS w FROM documents),
  g AS (
    SELECT doc_id, n, i, array_to_string(w[i - n + 1 : i], ' ') AS g, array_to_string(w[i - n + 1 : i - 1], ' ') AS h
    FROM (SELECT doc_id, w, n, unnest(generate_series(n::BIGINT, len(w))) AS i FROM d, generate_series(1, 3) AS s(n) WHERE len(w) >= n)),
  every AS (SELECT n, g, count(*) AS c FROM g GROUP BY n, g),
  own AS (SELECT doc_id, n, g, count(*) AS o FROM g GROUP BY doc_id, n, g),
  rest AS (SELECT doc_id, n, g, c - o AS c FROM own JOIN every USING (n, g)),
  total AS (SELECT sum(len(w)) AS m FROM d),
  level AS (
    SELECT g.doc_id, g.n, g.i, r.c AS c, h.c AS hc
    FROM g JOIN rest r ON r.doc_id = g.doc_id AND r.n = g.n AND r.g = g.g LEFT JOIN rest h ON h.doc_id = g.doc_id AND h.n = g.n - 1 AND h.g = g.h),
  word AS (
    SELECT doc_id, i, max(CASE WHEN n = 1 THEN c END) AS c1, max(CASE WHEN n = 2 THEN c END) AS c2, max(CASE WHEN n = 2 THEN hc END) AS h2,
      max(CASE WHEN n = 3 THEN c END) AS c3, max(CASE WHEN n = 3 THEN hc END) AS h3
    FROM level GROUP BY doc_id, i),
  scored AS (
    SELECT doc_id, CASE
        WHEN c3 > 0 THEN ln(c3 / greatest(h3, 1)::DOUBLE)
        WHEN c2 > 0 THEN CASE WHEN i >= 3 THEN ln(0.4::DOUBLE) ELSE 0 END + ln(c2 / greatest(h2, 1)::DOUBLE)
        ELSE least(i - 1, 2) * ln(0.4::DOUBLE) + ln(greatest(c1, 0.5)::DOUBLE / greatest(m - len(w), 1)) END AS s, coalesce(c3, 0) > 0 AS known
    FROM word JOIN d USING (doc_id), total),
  sums AS (SELECT doc_id, sum(s) AS s, count(*) FILTER (known) AS k FROM scored GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / len(w), 6) AS per_word, coalesce(k, 0)::BIGINT AS n_known
FROM d LEFT JOIN sums USING (doc_id)""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+'), []) AS w FROM documents),
  g AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
  size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM shared JOIN size p ON a = p.doc_id JOIN size q ON b = q.doc_id WHERE 100 * k >= 75 * (p.n + q.n - k)),
  edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
  least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op10_substring": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x{20}\x{09}-\x{0D}]+'), []) AS w FROM documents),
  starts AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
  low AS (SELECT g, min(doc_id) AS m FROM starts GROUP BY g),
  gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS k FROM starts JOIN low USING (g) WHERE m < doc_id),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM d WHERE len(w) > 0),
  left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
