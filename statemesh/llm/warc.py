"""WARC archives: writing with revisit records and segments, and reading back with segment reassembly.

Writing: of records with equal payloads of at least ``min_bytes`` the one with the smallest page_id is a response, the
others are revisits that refer to it. A response's block is an HTTP message whose body has chunked transfer framing; a
block longer than ``segment_bytes`` is cut into a first record and continuation records. The archives are plain WARC/1.1
files, written through Spark's own committer, so any store that Spark can write to will do. No payload is shuffled for it:
pages lie in chunks, digests alone are compared, and a revisit's reference comes back to its place.

Reading: records are parsed by their Content-Length. Whole records are decoded where they are read; segmented ones are
grouped by origin identifier, ordered by segment number, checked against the total length that the last segment states,
joined and decoded. A group is one page's record, so no group grows with the corpus.

Identifiers are functions of page_id and payload. Rows that repeat both have the same identifier; a header of their own
(WARC-Copy) tells their segments apart, so that copies are never gathered in one group. Page ids may be of any type: whole
numbers are written as they are, others by the hexadecimal digits of their text.

Defined cases: null html is an empty payload; a null page_id counts as the largest identifier; repeated rows with the
smallest page_id are all responses; an empty table makes no archive records; other columns are ignored. Missing segments or a wrong length raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import IN_CHUNK, chunk_of, located, n_partitions, release_memory, rows_of, scratch, stored, stored_by_chunk

_NONE = "none"
COPY = "WARC-Copy"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_name(page_id) -> str:
    """How an identifier names a page; the same as name_column()."""
    if page_id is None:
        return _NONE
    return str(page_id) if isinstance(page_id, int) else f"x{str(page_id).encode().hex().upper()}"


def name_column(page: Column, kind: T.DataType) -> Column:
    text = page.cast("string")
    return F.coalesce(text if isinstance(kind, T.IntegralType) else F.concat(F.lit("x"), F.hex(text)), F.lit(_NONE))


def page_column(uri: str, kind: T.DataType) -> Column:
    """The page_id that a column of identifiers names."""
    name = F.nullif(F.regexp_extract(uri, "page:([^/]*)/", 1), F.lit(""))
    name = F.nullif(name, F.lit(_NONE))
    return name.cast(kind) if isinstance(kind, T.IntegralType) else F.decode(F.unhex(F.substr(name, F.lit(2))), "UTF-8").cast(kind)


def record_uri(page_id, payload: bytes, segment: int = 1) -> str:
    """A record's identifier; it can be turned back into the page's."""
    tail = f"#{segment}" if segment > 1 else ""
    return f"<urn:statemesh:page:{page_name(page_id)}/{hashlib.sha1(payload).hexdigest()[:16]}{tail}>"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(part)
        at = end + 4 + size


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def records_of(page_id, url: str, payload: bytes, refers_to: str | None, segment_bytes: int, copy: str = "0") -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations. copy tells rows with equal ids apart."""
    target = "".join(c for c in (url or "about:blank") if c > " ")
    digest = f"sha1:{digest_of(payload)}"
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        own = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_uri(page_id, payload)), ("WARC-Refers-To", refers_to), ("WARC-Profile", profile)]
        yield record([*own, *common, ("Content-Type", "application/http; msgtype=response")], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    origin = record_uri(page_id, payload)
    for k, part in enumerate(parts, 1):
        own = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", record_uri(page_id, payload, k)), *common]
        if len(parts) > 1:
            own += [("WARC-Segment-Number", k), (COPY, copy)]
        if k > 1:
            own.append(("WARC-Segment-Origin-ID", origin))
        if len(parts) > 1 and k == len(parts):
            own.append(("WARC-Segment-Total-Length", len(block)))
        if k == 1:
            own.append(("Content-Type", "application/http; msgtype=response"))
        yield record(own, part)


def inflated(archive: bytes) -> bytes:
    """The bytes of an archive, of any number of gzip members, or as they are."""
    out = []
    while archive.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        out.append(member.decompress(archive))
        archive = member.unused_data
    return b"".join(out) + archive


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by the stated lengths."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = archive[end + 4 : end + 4 + size]
        if len(block) != size or archive[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken record at byte {at}")
        yield head, block
        at = end + 8 + size


def revisits(chunks: DataFrame, page_type: T.DataType, min_bytes: int) -> DataFrame:
    """(place, refers_to) of the rows of located chunks(page_id, payload) that are revisits: the URI of the record they repeat.

    Payloads stay where they are: digests, sizes and identifiers are compared, and places and URIs come back.
    """
    schema = T.StructType(
        [T.StructField("place", T.LongType()), T.StructField("page_id", page_type), T.StructField("size", T.LongType()), T.StructField("sha", T.StringType())]
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                rows = rows_of(body.as_py()).select(["page_id", "payload"]).combine_chunks()
                found = [(len(x), hashlib.sha1(x).hexdigest()) for x in (v.as_py() for v in rows.column("payload"))]
                places = pa.array([(chunk << IN_CHUNK) + i for i in range(len(found))], pa.int64())
                ids = rows.column("page_id").combine_chunks()
                ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
                sizes, shas = pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], pa.string())
                yield pa.RecordBatch.from_arrays([places, ids, sizes, shas], names=schema.names)
        release_memory()

    seen = stored(chunks.mapInArrow(digests, schema).where(F.col("size") >= min_bytes), "payload-digests")
    groups = seen.groupBy("sha", "size").agg(F.min("page_id").alias("_page"), F.count("*").alias("_n"))  # min() leaves nulls to the last
    groups = groups.where("_n > 1").drop("_n")
    # A frequent payload's rows are split by the skew-join rule; the groups' side has one row for each.
    again = seen.join(groups, ["sha", "size"]).where(~F.col("page_id").eqNullSafe(F.col("_page")))
    name = F.concat(name_column(F.col("_page"), page_type), F.lit("/"), F.substr("sha", F.lit(1), F.lit(16)))
    return again.select("place", F.concat(F.lit("<urn:statemesh:page:"), name, F.lit(">")).alias("refers_to"))


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    segment_bytes: int = 32_768,
    records_per_file: int = 2_000,
    compression: str = "gzip",
) -> None:
    """Write WARC files (.gz unless compression is "none") under path from pages(page_id, url, html).

    Pages are stored once as chunks of bounded size, and each chunk's records are written where it lies.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    chunks = stored_by_chunk(located(pages.select("page_id", "url", payload)), "pages", n_partitions(spark))
    again = revisits(chunks, pages.schema["page_id"].dataType, min_bytes).select(chunk_of(F.col("place")).alias("chunk"), "place", "refers_to")

    def lines(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, first = rows_of(left.column("rows")[0].as_py()), left.column("chunk")[0].as_py() << IN_CHUNK
        refers = dict(zip(right.column("place").to_pylist(), right.column("refers_to").to_pylist()))
        out = []
        for at in range(0, rows.num_rows, 64):
            held: list[bytes] = []
            for i, r in enumerate(rows.slice(at, 64).to_pylist(), first + at):
                held += records_of(r["page_id"], r["url"], r["payload"], refers.get(i), segment_bytes, str(i))
            # the text sink ends each row with the line feed that a record ends with
            out.append(pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in held], pa.binary())], names=["value"]))
        return pa.Table.from_batches(out)

    records = chunks.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(lines, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.options(
        maxRecordsPerFile=records_per_file, compression=compression
    ).text(path)


READ = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("copy", T.StringType()),
        T.StructField("block", T.BinaryType()),
    ]
)
DECODED = T.StructType([*READ.fields[:4], T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])


def _decode(block: bytes, kind: str, digest: str) -> tuple[int, bytes | None]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return int(fields[b"content-length"]), None
    payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    if digest and digest_of(payload) != digest:
        raise ValueError("payload and digest differ")
    return len(payload), payload


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """DECODED rows, one for each logical record of the archives under path."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held: list[tuple] = []
                for head, block in parse(inflated(content.as_py())):
                    number = int(head.get("warc-segment-number", 1))
                    origin = head["warc-record-id"] if number == 1 else head["warc-segment-origin-id"]
                    total = head.get("warc-segment-total-length")
                    held.append(
                        (
                            origin,
                            head["warc-type"],
                            head.get("warc-refers-to"),
                            head.get("warc-payload-digest", "").removeprefix("sha1:"),
                            number if "warc-segment-number" in head else 0,
                            int(total) if total else None,
                            head.get(COPY.lower(), ""),
                            block,
                        )
                    )
                    if len(held) == 256:
                        yield _batch(held, READ)
                        held = []
                if held:
                    yield _batch(held, READ)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    n, payload = _decode(r["block"], r["record_type"], r["digest"])
                    out.append((r["record_id"], r["record_type"], r["refers_to"], r["digest"], n, payload if keep_payload else None))
                yield _batch(out, DECODED)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = r["parts"]
                copies = max(1, sum(p["segment"] == 1 for p in parts))  # equal records of other writers
                block = b"".join(p["block"] for p in parts[::copies])
                numbers, totals = [p["segment"] for p in parts], [p["total"] for p in parts if p["total"] is not None]
                whole = [k for k in range(1, len(parts) // copies + 1) for _ in range(copies)]
                if numbers != whole or totals != [len(block)] * copies:
                    raise ValueError(f"segments {numbers} of {r['record_id']} make {len(block)} bytes of {totals}")
                n, payload = _decode(block, "response", r["digest"])
                yield _batch([(r["record_id"], "response", None, r["digest"], n, payload if keep_payload else None)] * copies, DECODED)

    # An archive is read whole by one task; write_archives() bounds its records.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    read = files.mapInArrow(rows, READ)
    whole = read.where("segment = 0").mapInArrow(decode, DECODED)
    segments = (
        read.where("segment > 0")
        .groupBy("record_id", "copy")
        .agg(F.first("digest").alias("digest"), F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"))
    )
    return whole.unionByName(segments.mapInArrow(join, DECODED))


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema)], names=schema.names)


def page_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    ship(spark)
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    id_type = pages.schema["page_id"].dataType
    read = read_archives(spark, path, keep_payload=False)
    return read.select(
        page_column("record_id", id_type).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        page_column("refers_to", id_type).alias("refers_to"),
    )
