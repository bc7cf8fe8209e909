"""WARC archives: writing captures, reading records, assembling transactions.

Each capture is three records, a request, a response (or a revisit, where another capture of equal
payload is the response) and metadata; request and metadata name the response in WARC-Concurrent-To.
Records are gzip members of their own, as the format recommends, and are written by Spark's text
writer, so any file system that Spark knows will do and its commit protocol holds; the writer's line
separator is an empty gzip member. Reading goes through Spark's binary file source.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.llm.common import release, scratch, stage, tune

#: Captures, and bytes (but for the last capture), of one archive file; they bound what a reader holds.
CAPTURES_PER_FILE, BYTES_PER_FILE = 500, 1 << 28
DATE = "2024-01-01T00:00:00Z"
_EMPTY = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 2, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _rid(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """Write every row of pages as a capture to archives in the folder `path`.

    Of captures with equal payloads of at least `least` bytes, the one with the largest id is the
    response and the others revisit it (their records carry no payload); smaller payloads are all
    responses. A null payload is empty; null ids lose against others. Equal means equal SHA-1. The
    archives of a task lie in folders numbered by the bytes it has written before.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null").select("sha", "first")
    rows = rows.join(stage(groups), "sha", "left")
    refers = F.when((F.octet_length("payload") >= least) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("id", "url", "payload", refers.alias("refers"))

    most = BYTES_PER_FILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for b in batches:
            out, archives = [], []
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = payload_digest(payload)
                uri = " ".join((url or "").split())
                target, sha = ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")
                main = _rid(page, digest, "response")
                path_of = uri.split("://", 1)[-1]
                host, _, rest = path_of.partition("/")
                request = f"GET /{rest} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                fields = f"page-id: {'' if page is None else page}\r\npayload-bytes: {len(payload)}\r\n"
                own = [target, sha, ("Content-Type", "application/http;msgtype=response")]
                if refers_to is None:
                    first = _record("response", main, own, http + payload)
                else:
                    fields += f"refers-to-page: {refers_to}\r\n"
                    own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _rid(refers_to, digest, "response"))]
                    first = _record("revisit", main, own, http)
                second = _record("request", _rid(page, digest, "request"), [target, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")], request)
                third = _record("metadata", _rid(page, digest, "metadata"), [target, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], fields.encode())
                out += [first, second, third]
                archives += [written // most] * 3
                written += len(first) + len(second) + len(third)
            yield pa.RecordBatch.from_arrays([pa.array(archives, pa.int32()), pa.array(out, pa.binary())], names=["archive", "value"])

    records = rows.mapInArrow(run, "archive int, value binary").select("archive", F.col("value").cast("string").alias("value"))
    options = {"lineSep": _EMPTY.decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": 3 * CAPTURES_PER_FILE}
    records.write.partitionBy("archive").options(**options).text(path)
    release(pages.sparkSession)


def members(content) -> Iterator[bytes]:
    """The contents of a file's gzip members, one at a time; a cut last member gives what it has."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            piece = view[at : at + 65536]
            try:
                out.append(z.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"not a gzip member at byte {at}") from e
            at += len(piece) - len(z.unused_data)
        if whole := b"".join(out):
            yield whole


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; the block is cut by Content-Length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("record shorter than its Content-Length")
    return headers, rest[:n]


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in `path`.

    kind, record_id, concurrent_to, uri, digest (as declared), block_digest (of the payload read, of
    responses), payload (of responses, without HTTP headers), fields (of metadata: map).
    """
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "record_id", "concurrent_to", "uri", "digest", "block_digest", "payload", "fields"]
        kinds = [*[pa.string()] * 6, pa.binary(), pa.map_(pa.string(), pa.string())]
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for raw in members(content.as_buffer()):
                    h, block = parse(raw)
                    kind = h["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    fields = [tuple(y.strip() for y in x.split(":", 1)) for x in block.decode().split("\r\n") if ":" in x] if kind == "metadata" else None
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if payload is None else payload_digest(payload), payload, fields))
                    size += len(raw)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "kind string, record_id string, concurrent_to string, uri string, digest string, block_digest string, payload binary, fields map<string,string>")


def assemble(records: DataFrame, *, payload: bool = True) -> DataFrame:
    """One row per capture: uri and the structs response, request, metadata.

    Records meet through the id of the response: a response or revisit under its own id, a request
    or metadata record under the one it is concurrent to. Every capture is its own group, so one
    grouping joins all three without skew. A missing part is null. Repeated captures (three records
    with the ids of others) are counted in `times`. payload=False leaves the payloads behind.
    """
    main = F.col("kind").isin("response", "revisit")
    size = F.octet_length("payload").cast("long")
    body = [F.col("payload")] if payload else []
    rows = records.select("kind", "uri", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("key"), F.struct("record_id", "kind", "digest", "block_digest", size.alias("payload_bytes"), *body).alias("part"), "fields")
    kind_of = lambda k, what: F.first(F.when(F.col("kind") == k, what), ignorenulls=True)
    return rows.where("key is not null").groupBy("key").agg(
        F.first("uri", ignorenulls=True).alias("uri"),
        F.count(F.when(main, 1)).alias("times"),
        F.first(F.when(main, F.col("part")), ignorenulls=True).alias("response"),
        kind_of("request", F.struct(F.col("part.record_id").alias("record_id"))).alias("request"),
        kind_of("metadata", F.struct(F.col("part.record_id").alias("record_id"), "fields")).alias("metadata"),
    )


def captures(pages: DataFrame, *, least: int = 0, **columns) -> DataFrame:
    """Write pages as archives in the scratch folder, read them back and describe every capture.

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url. The digest of a
    response is computed from the payload read; that of a revisit is the declared one. Rows that
    repeat an id and payload give as many equal rows. An empty table gives an empty result; other
    columns are not looked at.
    """
    spark = pages.sparkSession
    path = scratch(spark)
    write(pages, path, least=least, **columns)
    got = assemble(read(spark, path), payload=False)
    number = lambda name: F.col("metadata.fields")[name].cast("long")
    rows = got.select(
        F.expr("try_cast(metadata.fields['page-id'] as bigint)").alias("page_id"),
        F.coalesce("response.payload_bytes", number("payload-bytes")).alias("payload_bytes"),
        F.coalesce("response.block_digest", "response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        number("refers-to-page").alias("refers_to"),
        F.col("uri").alias("url"),
        F.explode(F.expr("sequence(1, times)")).alias("time"),
    )
    return rows.drop("time")
