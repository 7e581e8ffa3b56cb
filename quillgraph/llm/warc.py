"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record.  Records name
each other by WARC-Concurrent-To, in either direction and across files; :func:`assemble` joins them and
gives one nested row for each capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bitmap import bitmap, may_hold
from quillgraph.llm.runtime import cut, discard, file_system, fresh, prepare, remove
from quillgraph.llm.spread import spread_join

#: Bytes of records that go to Spark in one batch, and about the size of an archive file.
BATCH_BYTES = 8 << 20
FILE_BYTES = 256 << 20
_DATE = "2024-01-01T00:00:00Z"


def record_id(role: str, page_id, digest: str) -> str:
    raw = hashlib.blake2b(f"{role}/{page_id}/{digest}".encode(), digest_size=16).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=raw)}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def format_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def format_capture(page_id, url: str | None, payload: bytes, digest: str, first) -> list[bytes]:
    """The records of one capture; ``first`` is the page whose response holds the payload, or None if this does."""
    target = [("WARC-Target-URI", _clean(url))] if url else []
    main = record_id("response", page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Record-ID", main), ("WARC-Date", _DATE), *target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        out = [format_record([("WARC-Type", "response"), *common], http + payload)]
    else:
        refers = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("response", first, digest))]
        out = [format_record([("WARC-Type", "revisit"), *common, *refers], http)]
    for kind, mime, block in (
        ("request", "application/http; msgtype=request", f"GET {_clean(url or '/')} HTTP/1.1\r\n\r\n".encode()),
        ("metadata", "application/warc-fields", b"" if page_id is None else f"page-id: {quote(str(page_id), safe='')}\r\n".encode()),
    ):
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, page_id, digest)), ("WARC-Date", _DATE), *target]
        out.append(format_record([*own, ("WARC-Concurrent-To", main), ("Content-Type", mime)], block))
    return out


def parse_records(stream: io.BufferedIOBase):
    """(fields, block) of each record of an uncompressed stream; fields are lists by lower-case name.

    A record that does not begin as one, has no length or is cut short raises ValueError.
    """
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields: dict[str, list[str]] = {}
        last = None
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            if line[:1] in b" \t" and last:
                fields[last][-1] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            fields.setdefault(last, []).append(value.strip())
        said = fields.get("content-length", [""])[0]
        if not said.isdecimal():
            raise ValueError("a WARC record has no length")
        size = int(said)
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut short")
        yield fields, block


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, where: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes one capture for each row and gives a manifest: path, captures, bytes.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is written as
    response and the others as revisits of it; smaller payloads are always responses.  A null payload is
    empty.  Rows with a null id are revisits of an equal payload, or responses if no row with an id has it;
    rows that repeat the smallest id with the same payload are responses too.  Files of task attempts that
    did not end are not listed.
    """
    spark = pages.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(html_col), F.lit(""))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("html"), F.unhex(F.sha1(text)).alias("sha"))
    keys = cut(src.filter(F.octet_length("html") >= min_bytes).select("id", "sha"), "payloads")
    first = keys.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha", "first")
    again = spread_join(keys, first, "sha", keys, "id").filter(~F.col("id").eqNullSafe(F.col("first"))).distinct()
    again = cut(again.select(F.col("id").alias("id2"), F.col("sha").alias("sha2"), "first"), "revisits")
    # only payloads of rows that may be revisits are shuffled
    mark = lambda i, sha: F.xxhash64(F.col(i), F.col(sha))
    may = may_hold(spark, bitmap(again.select(mark("id2", "sha2").alias("key"))))
    clear = src.filter(~may(mark("id", "sha"))).select("id", "url", "html", F.lit(None).cast(pages.schema[id_col].dataType).alias("first"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2"))
    rest = src.filter(may(mark("id", "sha"))).join(again.hint("merge"), same, "left").select("id", "url", "html", "first")
    full = clear.unionByName(rest)

    def run(batches):
        sink, done, n, size = None, [], 0, 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "first")), strict=True):
                if sink is None:
                    fs, base = file_system(where)
                    fs.create_dir(base, recursive=True)
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = r[2].encode()
                for rec in format_capture(r[0], r[1], payload, sha1_base32(payload), r[3]):
                    packed = gzip.compress(rec, 4, mtime=0)  # a member of its own, so that a record can be read by its place
                    sink.write(packed)
                    size += len(packed)
                n += 1
                if size >= FILE_BYTES:
                    sink.close()
                    done.append((f"{where}/{name}", n, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((f"{where}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "captures", "bytes"])

    manifest = cut(full.mapInArrow(run, "path string, captures long, bytes long"), "archives")
    discard(keys, again)
    return manifest


_RECORD = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.string()), ("payload", pa.binary())])


def _record(fields: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    one = lambda k: fields.get(k, [None])[0]
    kind, mime = one("warc-type"), one("content-type") or ""
    body, size, digest = None, None, one("warc-payload-digest")
    if "application/http" in mime and kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?mi)^content-length:\s*(\d+)", head)
        if kind == "response":
            size, digest = len(body), sha1_base32(body)
        else:
            size, digest = int(said[1]) if said else None, (digest or "").rpartition(":")[2]
    text = block.decode("utf-8", "replace") if kind == "metadata" else None
    return (one("warc-record-id"), kind, one("warc-target-uri"), fields.get("warc-concurrent-to", []), one("warc-refers-to"), digest, size, text, body if payloads and kind == "response" else None)


def read_archives(manifest: DataFrame, path_col: str = "path", payloads: bool = True, strict: bool = False) -> DataFrame:
    """Every record of the listed files (plain or gzipped): its ids, type, payload figures and payload.

    A damaged record (no version line, no length, cut short, or broken gzip data) ends its file: the
    records before it are given, then one row of kind "damaged" with the file as uri and the reason as
    fields; with ``strict`` it raises instead.  Null paths are left out.
    """
    paths = manifest.select(F.col(path_col).alias("path")).filter("path is not null")
    paths = paths.repartition(max(1, paths.count()))

    def run(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = file_system(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    stream = io.BufferedReader(raw, 1 << 20)
                    if stream.peek(2)[:2] == b"\x1f\x8b":
                        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
                    try:
                        for fields, block in parse_records(stream):
                            rows.append(_record(fields, block, payloads))
                            held += len(block) if payloads else 500
                            if held >= BATCH_BYTES:
                                yield _pack(rows)
                                rows, held = [], 0
                    except (ValueError, EOFError, gzip.BadGzipFile, zlib.error) as e:
                        if strict:
                            raise
                        rows.append((None, "damaged", uri, [], None, None, None, str(e), None))
                if rows:
                    yield _pack(rows)

    ddl = "record_id string, kind string, uri string, concurrent_to array<string>, refers_to string, digest string, payload_bytes long, fields string, payload binary"
    return paths.mapInArrow(run, ddl)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit record's columns, ``request`` and ``metadata`` (array).

    A companion record belongs to each response that it names in WARC-Concurrent-To, or that names it.  Of
    several requests the one with the smallest record id is taken.  Companions of no response are left out,
    as are records without an id; a response without companions has a null request and no metadata.
    """
    main = records.filter(F.col("kind").isin("response", "revisit") & F.col("record_id").isNotNull())
    side = records.filter(F.col("kind").isin("request", "metadata") & F.col("record_id").isNotNull()).select("record_id", "kind", "uri", "concurrent_to", "fields")
    shape = F.struct("record_id", "kind", "uri", "fields").alias("side")
    named = side.select(F.explode("concurrent_to").alias("main_id"), shape)
    naming = main.select(F.explode("concurrent_to").alias("side_id"), F.col("record_id").alias("main_id"))
    back = naming.join(side.hint("merge"), naming["side_id"] == side["record_id"]).select("main_id", shape)
    sides = named.unionByName(back)
    grouped = sides.groupBy("main_id").agg(
        F.min(F.when(F.col("side.kind") == "request", F.col("side"))).alias("request"),
        F.array_sort(F.collect_set(F.when(F.col("side.kind") == "metadata", F.col("side")))).alias("metadata"),
    )
    # by key at every size: Spark knows nothing of what a task reads from archives
    whole = main.join(grouped.hint("merge"), main["record_id"] == grouped["main_id"], "left").drop("main_id")
    return whole.withColumn("metadata", F.coalesce("metadata", F.expr("cast(array() as array<struct<record_id:string,kind:string,uri:string,fields:string>>)")))


def round_trip(pages: DataFrame, where: str | None = None, payloads: bool = True, **columns) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and assembles the captures.

    Gives page_id, uri, payload_bytes, payload_digest, record_type, refers_to (the page id of the response
    that a revisit names), request, metadata and payload.  Ids of any simple type keep it; a null id comes
    back null.  Without ``where`` the archives go again once they are read.
    """
    spark = pages.sparkSession
    folder = where or fresh(spark, "warc")
    records = cut(read_archives(write_archives(pages, folder, **columns), payloads=payloads, strict=True), "records")
    if where is None:
        remove(spark, folder)
    kind = pages.schema[columns.get("id_col", "page_id")].dataType
    # the page of each capture, as its metadata record names it
    noted = records.filter("kind = 'metadata'").select(F.explode("concurrent_to").alias("key"), "fields")
    line = r"(?m)^page-id: (.*?)\r?$"
    page = F.when(F.col("fields").rlike(line), F.url_decode(F.regexp_extract("fields", line, 1))).cast(kind)
    noted = noted.groupBy("key").agg(F.min(page).alias("key_page"))
    # a revisit is joined to the response that it names, a response to itself
    key = F.when(F.col("kind") == "revisit", F.col("refers_to")).otherwise(F.col("record_id")).alias("key")
    captures = assemble(records).withColumn("key", key).drop("refers_to")
    named = records.filter(F.col("kind").isin("response", "revisit")).select(key)
    placed = spread_join(captures, noted, "key", named, "record_id", "left")
    revisit = F.col("kind") == "revisit"
    own = F.element_at(F.col("metadata.fields"), 1)
    own = F.when(own.rlike(line), F.url_decode(F.regexp_extract(own, line, 1))).cast(kind)
    return placed.select(
        F.when(revisit, own).otherwise(F.col("key_page")).alias("page_id"), "uri", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.when(revisit, F.col("key_page")).alias("refers_to"), "request", "metadata", "payload"
    )
