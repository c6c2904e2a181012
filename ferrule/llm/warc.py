"""WARC archives: writing pages as records, and reading them back with segments reassembled."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import checkpoint_dir, materialize, may_hold

#: Bytes of a record's block beyond which it goes on in continuation records; bytes of a chunk of the transfer framing; records of a file.
SEGMENT, FRAME, FILE_RECORDS = 32_768, 4_096, 2_000
#: What ends a record. As the line separator of the text sink, it makes the sink's files archives.
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

Batches = Iterator[pa.RecordBatch]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, of: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {of}'.encode()).digest())}>"


def chunked(payload: bytes, size: int = FRAME) -> bytes:
    """Transfer framing: chunks with their length in hex, closed by one of length 0."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """Undo ``chunked``; chunk extensions and trailers are skipped. A frame that breaks off is an error."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if len(body) < line + 4 + size:
            raise ValueError("a chunk is shorter than its length")
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def _records(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> Iterator[bytes]:
    """The records of one page, without what ends them; ``first``: the page whose payload it repeats."""
    of = digest(payload)
    revisit = first is not None and page_id is not None and first != page_id
    common = {"WARC-Date": DATE, "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Page-ID": "" if page_id is None else str(page_id)}
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id, of), "WARC-Payload-Digest": f"sha1:{of}", "Content-Type": "application/http;msgtype=response"}
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(first, of)}
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[k : k + SEGMENT] for k in range(0, len(block), SEGMENT)]
    for k, part in enumerate(parts, 1):
        own = head if k == 1 else {"WARC-Type": "continuation", "WARC-Record-ID": _record_id(page_id, f"{of} {k}"), "WARC-Segment-Origin-ID": head["WARC-Record-ID"]}
        if len(parts) > 1:
            own = own | {"WARC-Segment-Number": str(k)} | ({"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {})
        fields = common | own | {"Content-Length": str(len(part))}
        yield b"WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in fields.items()).encode() + b"\r\n" + part


def _build(batches: Batches) -> Batches:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first")), strict=True)
        out: list[bytes] = []
        size = 0
        for row in rows:
            for record in _records(*row):
                out.append(record)
                size += len(record)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write a record for each page (page_id, url, html) to gzipped archives in ``folder``, a path that Spark can reach.

    Of pages with equal payloads of ``least`` bytes or more, the one of smallest page_id is a response, the others revisit
    it. Only payloads that may repeat are shuffled, a Bloom filter of the repeated digests having passed the rest. Null html
    is an empty payload. A null page_id is a response; rows that repeat the smallest page_id are responses, too.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    able = rows.where((F.length("payload") >= least) & F.col("page_id").isNotNull())
    firsts = able.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    firsts = materialize(firsts)
    probed = may_hold(rows, "sha", firsts.select("sha"), "may")
    again = probed.where("may").join(firsts, "sha", "left")
    again = again.withColumn("first", F.when(F.length("payload") >= least, F.col("first")))
    once = probed.where("not may").withColumn("first", F.lit(None).cast("long"))
    records = again.unionByName(once).select("page_id", "url", "payload", "first").mapInArrow(_build, "value binary")
    lines = records.select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


class BrokenRecord(ValueError):
    """A record that cannot be read."""


def parse_stream(chunks: Iterable[bytes], aside: Callable[[str], None] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive that comes in chunks: fields by lower-case name, and block. No more than a record is held.

    A record that cannot be read is an error; or with ``aside``, which is told of it, reading goes on at the next one.
    """
    source = iter(chunks)
    data = bytearray()
    ended = False

    def find(what: bytes, at: int = 0) -> int:
        nonlocal ended
        while (found := data.find(what, at)) < 0 and not ended:
            at = max(at, len(data) - len(what) + 1)
            chunk = next(source, None)
            ended = chunk is None
            data.extend(chunk or b"")
        return found

    while True:
        find(b"WARC/")
        while data[:2] == b"\r\n":
            del data[:2]
        if not data:
            return
        try:
            end = find(b"\r\n\r\n")
            if end < 0 or not data.startswith(b"WARC/"):
                raise BrokenRecord("no header")
            lines = data[:end].decode().split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
            size = int(fields["content-length"])
            missing = {"warc-type", "warc-record-id"} - set(fields)
            if missing:
                raise BrokenRecord(f"a header without {sorted(missing)}")
            while len(data) < end + 4 + size and not ended:
                chunk = next(source, None)
                ended = chunk is None
                data.extend(chunk or b"")
            if len(data) < end + 4 + size:
                raise BrokenRecord(f"record {fields['warc-record-id']} breaks off")
        except (ValueError, KeyError) as x:
            said = f"a broken header: {x!r}" if not isinstance(x, BrokenRecord) else str(x)
            if aside is None:
                raise BrokenRecord(said) from x
            aside(said)
            after = find(b"\r\n\r\nWARC/", 1)
            del data[: after + 4 if after >= 0 else len(data)]
            continue
        yield fields, bytes(data[end + 4 : end + 4 + size])
        del data[: end + 4 + size]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive that is there as a whole."""
    return parse_stream([data])


_PARSED = "origin string, segment int, total long, segmented boolean, record_type string, page_id long, url string, digest string, refers_to string, block binary, error string"


def _row(f: dict[str, str], block: bytes) -> tuple:
    number, total, page = f.get("warc-segment-number"), f.get("warc-segment-total-length"), f.get("warc-page-id")
    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
    return (origin, int(number or 1), int(total) if total else None, number is not None, f["warc-type"], int(page) if page else None, f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:"), f.get("warc-refers-to"), block, None)


def _parser(aside: bool) -> Callable[[Batches], Batches]:
    """Parse rows (file, value): the pieces of archives between their ``END``, each archive's in order; and rows (None, value): whole archives."""

    def run(batches: Batches) -> Batches:
        def pieces() -> Iterator[tuple[str | None, bytes]]:
            for batch in batches:
                for file, value in zip(batch.column("file"), batch.column("value"), strict=True):
                    yield file.as_py(), value.as_py()

        rows: list[tuple] = []
        size = 0
        end = END.encode()
        broken = lambda said: rows.append((None, 1, None, False, "broken", None, None, None, None, None, said))
        numbers = count()
        for _, group in groupby(pieces(), key=lambda p: p[0] or next(numbers)):
            chunks = (x for file, value in group for x in ((value,) if file is None else (value, end)))
            for fields, block in parse_stream(chunks, broken if aside else None):
                rows.append(_row(fields, block))
                size += len(block)
                if size > 4_000_000:
                    yield _parsed(rows)
                    rows.clear()
                    size = 0
        yield _parsed(rows)

    return run


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in _PARSED.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _payload(parts: list[dict]) -> bytes | None:
    """The payload of a record from its segments, in order: the block without HTTP header and transfer framing; null for a record without one."""
    blocks = {p["segment"]: p["block"] for p in parts}
    block = b"".join(blocks.values())
    total = max((p["total"] for p in parts if p["total"] is not None), default=len(block))
    if list(blocks) != list(range(1, len(blocks) + 1)) or len(block) != total:
        raise BrokenRecord(f"record {parts[0]['origin']}: segments {list(blocks)} of {len(block)} bytes, not {total}")
    if parts[0]["record_type"] != "response":
        return None
    header, _, body = block.partition(b"\r\n\r\n")
    payload = dechunk(body) if b"transfer-encoding: chunked" in header.lower() else body
    if digest(payload) != parts[0]["digest"]:
        raise BrokenRecord(f"record {parts[0]['origin']}: the payload is not that of its digest")
    return payload


_RECORD = "record_id string, record_type string, page_id long, url string, digest string, refers_to string, payload binary, error string"


def _decoder(aside: bool) -> Callable[[Batches], Batches]:
    """Whole records with their payload. Its digest is held against the header's."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                parts.sort(key=lambda p: p["segment"])
                payload, error = None, parts[0]["error"]
                if error is None:
                    try:
                        payload = _payload(parts)
                    except ValueError as x:
                        if not aside:
                            raise
                        error = str(x)
                heads = [p for p in parts if p["segment"] == 1] or parts[:1]
                out += [(p["origin"], p["record_type"], p["page_id"], p["url"], p["digest"], p["refers_to"], payload, error) for p in heads]
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _RECORD.split(", ")])

    return run


def read_records(spark: SparkSession, folder: str, aside: bool = False) -> DataFrame:
    """All records of the archives in ``folder``, whole: record_id, record_type, page_id, url, digest, refers_to, payload, error.

    Gzipped archives (``*.gz``) are read as streams: Spark's text source, with the end of a record as the end of a line, hands
    their pieces over in order, so that no more than a record is in memory, however large the archive. Archives that are
    not compressed (``*.warc``) are read whole. Continuation records are grouped with their origin, ordered by segment number,
    joined and held against the total length; a record in one piece is not shuffled. A group is one record, so it is as large
    as one page. A missing segment, a wrong length, a broken header or frame or a wrong digest is an error, never a shortened
    page; with ``aside`` such a record is a row with ``error`` and without payload, and all others are read.
    """
    gzipped = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(folder)
    gzipped = gzipped.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder)
    plain = plain.select(F.lit(None).cast("string").alias("file"), F.col("content").alias("value"))
    parsed = gzipped.mapInArrow(_parser(aside), _PARSED).unionByName(plain.mapInArrow(_parser(aside), _PARSED))
    part = F.struct(*[x.split()[0] for x in _PARSED.split(", ")])
    alone = parsed.where("not segmented").select(F.array(part).alias("parts"))
    joined = parsed.where("segmented").groupBy("origin").agg(F.collect_list(part).alias("parts")).select("parts")
    return alone.unionByName(joined).mapInArrow(_decoder(aside), _RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back, and say of each what its record holds.

    Returns page_id, payload_bytes, payload_digest, record_type and, for a revisit, refers_to, the page_id of the response
    that its WARC-Refers-To leads to; payload_bytes of a revisit are those of that response.
    """
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, least)
    records = read_records(spark, folder)
    records = materialize(records.select("record_id", "record_type", "page_id", "digest", "refers_to", F.length("payload").cast("long").alias("payload_bytes")))
    responses = records.where("record_type = 'response'")
    own = responses.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    targets = responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("target"), F.min("payload_bytes").alias("bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(targets, "refers_to", "left")
    revisits = revisits.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("target").alias("refers_to"))
    return own.unionByName(revisits)
