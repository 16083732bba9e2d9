"""WARC archives: records, segmented records and their reassembly.

Writing: each record is one row of text, and Spark's text writer puts the two line ends between records that the format asks
for, so archives land by Spark's own committed writes wherever it can write. A payload over segment_bytes goes out as a first
segment and continuation records, and its response uses chunked transfer framing. Reading: archives are parsed by content
length; records in one piece pass straight on, and only segments are shuffled, grouped by the origin's identifier, put in
order of their numbers, checked against the total length, and only then freed of the chunk framing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\r\n"


def record_id(page_id: int | None, sha1: str, tag: str | None = None, segment: int = 1) -> str:
    """tag tells rows with the same id and payload apart; the first of them has none, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {sha1} {tag} {segment}')}>"


def cut(data: bytes, size: int) -> list[bytes]:
    """Parts of at most size bytes, none of which begins inside a UTF-8 sequence."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + max(size, 4))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:end])
        at = end
    return parts or [b""]


def chunked(data: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut(data, size) if c) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        size = int(data[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + size])
        if len(out[-1]) != size:
            raise ValueError("a chunk is shorter than its length says")
        at = line + 2 + size + 2


def records(page_id: int | None, url: str, payload: bytes, sha1: str, original: int | None, segment_bytes: int, tag: str | None = None) -> Iterator[str]:
    """The records of one page. original: the page that a revisit refers to."""
    me = record_id(page_id, sha1, tag)
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [f"WARC-Target-URI: {url}", "WARC-Date: 2025-01-01T00:00:00Z", f"WARC-Payload-Digest: {digest}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if original is not None:
        block = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {len(payload)}{END}{END}".encode()
        yield _record("revisit", me, [*head, f"WARC-Refers-To: {record_id(original, sha1)}", f"X-Refers-To-Page: {original}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"], block)
        return
    if len(payload) <= segment_bytes:
        yield _record("response", me, head, f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {len(payload)}{END}{END}".encode() + payload)
        return
    block = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Transfer-Encoding: chunked{END}{END}".encode() + chunked(payload, max(4, segment_bytes // 3))
    parts = cut(block, segment_bytes)
    for k, part in enumerate(parts):
        last = [f"WARC-Segment-Total-Length: {len(block)}"] if k == len(parts) - 1 else []
        if k == 0:
            yield _record("response", me, [*head, "WARC-Segment-Number: 1", *last], part)
        else:
            yield _record("continuation", record_id(page_id, sha1, tag, k + 1), ["WARC-Date: 2025-01-01T00:00:00Z", f"WARC-Segment-Origin-ID: {me}", f"WARC-Segment-Number: {k + 1}", *last], part)


def _record(kind: str, rid: str, head: list[str], block: bytes) -> str:
    return END.join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]) + block.decode()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000, segment_bytes: int = 16384, records_per_file: int = 6000) -> None:
    """Writes one response or revisit for each row under path, as text files.

    Of rows with equal payloads of at least `least` bytes, the one with the largest id is the response and the others revisit it.
    A file has at most records_per_file records of at most segment_bytes each and their headers, about 100 MB, so a task that reads
    one holds no more. Payloads are compared by SHA-256. A null body is an empty payload, a null url an empty one; line ends in a url become %0D and %0A. Rows
    that repeat the largest id with the same payload are responses too. Rows with a null id are always responses. Each record has an
    identifier of its own, whatever ids repeat.
    """
    common.ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("key", F.sha2("body", 256)).withColumn("mark", F.concat_ws(":", "key", F.col("id").cast("string")))
    heads = rows.where(F.octet_length("body") >= least).groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    revisits = common.stored(rows.select("id", "key", "mark").join(heads, "key").where("id <> first").select("mark", "first").distinct())
    twins = common.stored(rows.groupBy("mark").count().where("count > 1").select("mark"))
    rows = rows.withColumn("tag", F.lit(None).cast("string"))
    if not twins.isEmpty():
        # rows that repeat an id with its payload are stored with a tag each; the least tag of a mark is left out again
        single, near = common.split(rows, "mark", common.bit_filter(twins, "mark"))
        tagged = common.stored(near.join(twins, "mark", "left_semi").select(*rows.columns).withColumn("tag", F.expr("uuid()")))
        least_tags = tagged.groupBy("mark").agg(F.min("tag").alias("tag")).select("tag", F.lit(True).alias("lead"))
        apart = tagged.join(least_tags, "tag", "left").withColumn("tag", F.when(F.col("lead").isNull(), F.col("tag"))).select(*rows.columns)
        rows = single.unionByName(near.join(twins, "mark", "left_anti").select(*rows.columns)).unionByName(apart)
    # only rows that the filter takes for revisits are shuffled with their bodies
    stay, near = common.split(rows, "mark", common.bit_filter(revisits, "mark"))
    marked = stay.withColumn("first", F.lit(None).cast("long")).unionByName(near.join(revisits, "mark", "left").select(*stay.columns, "first"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, bodies, firsts, tags in common.rows_of(batches, "id", "url", "body", "first", "tag"):
            out = []
            for i, u, b, f, t in zip(ids, urls, bodies, firsts, tags):
                data = b.encode()
                out += records(i, u, data, hashlib.sha1(data).hexdigest(), f, segment_bytes, t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    marked.mapInArrow(build, "value string").write.option("lineSep", END + END).option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """(offset, kind, record_id, origin, segment, total, uri, refers_to, payload_digest, block, page, refers_id) of each record of an
    archive; white space between records is skipped."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:body].decode("utf-8", "replace").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        end = body + int(head["content-length"])
        if end > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        number = lambda k: int(head[k]) if head.get(k) else None
        yield at, head["warc-type"], head["warc-record-id"], head.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), head.get("warc-target-uri"), head.get("x-refers-to-page"), head.get("warc-payload-digest"), data[body:end], head.get("x-page-id"), head.get("warc-refers-to")
        at = end


def _payload(block: bytes) -> tuple[bytes, int | None]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        body = unchunked(body)
    return body, int(fields[b"content-length"]) if b"content-length" in fields else None


def _sha1(claimed: str | None) -> bytes | None:
    """A SHA-1 in Base32 or hex; None for another algorithm or none at all."""
    algorithm, _, value = (claimed or "").partition(":")
    if algorithm.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    return bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())


def _number(x: str | None) -> int | None:
    return int(x) if x and x.strip().lstrip("-").isdigit() else None


def _result(rid: str, page: str | None, kind: str, refers: str | None, refers_id: str | None, claimed: str | None, uri: str | None, block: bytes) -> tuple:
    body, length = _payload(block)
    own = _sha1(claimed)
    if kind == "revisit":
        return _number(page), length, own.hex() if own else None, kind, _number(refers), rid, refers_id, uri, None
    sha1 = hashlib.sha1(body).digest()
    if own and own != sha1:
        raise ValueError(f"the payload of record {rid} differs from its digest")
    return _number(page), len(body), sha1.hex(), kind, None, rid, None, uri, body


KINDS = ("response", "revisit", "continuation")
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, uri string"
_OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("uri", pa.string()), ("payload", pa.binary())])


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each response or revisit under path: page_id, payload_bytes, payload_digest (hex SHA-1), record_type,
    refers_to, record_id, refers_to_id, uri, and payload (binary, null for revisits) if asked for. Records of other types
    (warcinfo, request, metadata and so on) are passed over.

    Archives of other writers: page_id is null without our own header; refers_to of a revisit then is the page_id of the record
    that WARC-Refers-To names, null if that is not there; a payload without a SHA-1 digest is not checked, and a revisit
    without one has payload_digest null. Fails on a record that is cut short, a missing segment, a total length that doesn't
    fit or a payload that differs from its digest."""
    common.ship(spark)
    kept = _OUT if with_payload else pa.schema(list(_OUT)[:-1])
    schema = OUT + ", payload binary" * with_payload
    inner = pa.schema([("page", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("refers_id", pa.string()), ("claimed", pa.string()), ("target", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
    # records in one piece are finished here; pieces keep their block
    both = pa.schema([*kept, *inner])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("content")):
                rows: list[tuple] = []
                held = 0
                for _, kind, rid, origin, segment, total, uri, refers, claimed, block, page, refers_id in parse(data.as_py()):
                    if kind not in KINDS:
                        continue
                    if segment is None:
                        rows.append((*_result(rid, page, kind, refers, refers_id, claimed, uri, block)[: len(kept)], *[None] * len(inner)))
                    else:
                        rows.append((*[None] * len(kept), page, kind, refers, refers_id, claimed, uri, origin or rid, segment, total, block))
                    held += len(block)
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield _batch(rows, both)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, both)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for origins, pages, kinds, refers, ids, claims, uris, totals, blocks, ns in common.rows_of(batches, "origin", "page", "kind", "refers", "refers_id", "claimed", "target", "total", "blocks", "numbers"):
            rows = []
            for rid, page, kind, ref, ref_id, claim, uri, total, block, n in zip(origins, pages, kinds, refers, ids, claims, uris, totals, blocks, ns):
                if kind == "continuation" and n[0] != 1 or n != list(range(1, len(n) + 1)):
                    raise ValueError(f"record {rid} lacks a segment")
                whole = b"".join(block)
                if len(whole) != total:
                    raise ValueError(f"record {rid} has {len(whole)} bytes in its segments, not {total}")
                rows.append(_result(rid, page, kind, ref, ref_id, claim, uri, whole)[: len(kept)])
            yield _batch(rows, kept)

    fields = "page string, kind string, refers string, refers_id string, claimed string, target string, origin string, segment int, total long, block binary"
    parsed = common.stored(spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, f"{schema}, {fields}"))
    pieces = parsed.where(F.col("segment").isNotNull())
    one = F.struct("segment", "block")
    # a record's segments are as many as its payload's size asks for; an archive that is there twice repeats them: one of each number
    grouped = pieces.groupBy("origin").agg(*[F.max(c).alias(c) for c in ("page", "refers", "refers_id", "claimed", "target", "total")], F.max_by("kind", -F.col("segment")).alias("kind"), F.array_sort(F.collect_set(one)).alias("parts"), F.sum((F.col("segment") == 1).cast("int")).alias("times"))
    whole = grouped.select("origin", "page", "kind", "refers", "refers_id", "claimed", "target", "total", "times", F.col("parts.block").alias("blocks"), F.col("parts.segment").alias("numbers"))
    joined = whole.withColumn("times", F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1))))).mapInArrow(join, schema)
    out = parsed.where(F.col("segment").isNull()).select(*joined.columns).unionByName(joined)
    if parsed.where("kind IS NULL AND record_type = 'revisit' AND refers_to IS NULL AND refers_to_id IS NOT NULL").isEmpty():
        return out
    ids = out.where("record_type = 'response'").groupBy(F.col("record_id").alias("named")).agg(F.min("page_id").alias("named_page"))
    return out.join(ids, F.col("refers_to_id") == F.col("named"), "left").withColumn("refers_to", F.coalesce("refers_to", F.when(F.col("record_type") == "revisit", F.col("named_page")))).select(*joined.columns)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}-warc"
    write(common.read(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, octet_length(encode(COALESCE(html, '')))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT *, MAX(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM g
"""
