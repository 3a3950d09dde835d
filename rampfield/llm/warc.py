"""WARC archives written and read by Spark, with segmented records and revisits.

Writing: every page is a record; a payload already held by a page with a smaller id becomes
a revisit. Blocks longer than a segment are cut into a first record and continuations.
Records are packed into rows of a few megabytes, and the text writer puts the blank lines
that end a record between and after them, so every part file is a WARC file of bounded size.

Reading: every file is parsed on its own. Segments are grouped by the record they continue,
put in order, checked for gaps and for the stated total, and joined; then the HTTP message
is taken apart and its chunks are joined. Records that are whole take no shuffle.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: version line, end of record, profile of a revisit
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: payloads shorter than this are never revisits
LEAST_SHARED = 100
#: a segment is shorter than most pages, so that ordinary records are segmented
SEGMENT, CHUNK, PACK, PACKS_PER_FILE = 2 * 1024, 8 * 1024, 4 * 1024 * 1024, 4


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for k in range(0, len(payload), size):
        piece = payload[k : k + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked message; ValueError if its framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        digits = body[at:line].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("chunk size malformed")
        size = int(digits, 16)
        at = line + 2
        if size == 0:
            break
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk length wrong")
        out.append(body[at : at + size])
        at += size + 2
    # trailer fields may stand before the empty line
    if body[at : at + 2] != b"\r\n" and body.find(b"\r\n\r\n", at) < 0:
        raise ValueError("end of chunks missing")
    return b"".join(out)


def http_payload(block: bytes) -> bytes:
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP head incomplete")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().lower()
    if fields.get(b"transfer-encoding") == b"chunked":
        return unchunked(body)
    if b"content-length" in fields and int(fields[b"content-length"]) != len(body):
        raise ValueError("HTTP length wrong")
    return body


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without the blank lines after it."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", b""]) + block


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of every record of an archive, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        head = data.find(END, at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in data[at:head].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode().strip()
        start = head + len(END)
        stop = start + int(fields["content-length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError(f"record at byte {at} has a wrong length")
        yield fields, data[start:stop]
        at = stop + len(END)


def segments(fields: dict[str, str | None], block: bytes, size: int) -> list[bytes]:
    """The record, or its first segment and continuations if the block is longer than ``size``."""
    if len(block) <= size:
        return [record(fields, block)]
    origin, count = fields["WARC-Record-ID"], -(-len(block) // size)
    out = [record({**fields, "WARC-Segment-Number": "1"}, block[:size])]
    for k in range(2, count + 1):
        more = {
            "WARC-Type": "continuation", "WARC-Record-ID": _urn(f"{origin} {k}"), "WARC-Date": fields["WARC-Date"],
            "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": str(k),
            "WARC-Segment-Total-Length": str(len(block)) if k == count else None,
        }
        out.append(record(more, block[(k - 1) * size : k * size]))
    return out


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=5)}>"


def _uri(url: str | None, page: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{quote(page or '')}"


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = "2000-01-01T00:00:00Z", segment: int = SEGMENT, chunk: int = CHUNK, pack: int = PACK,
) -> None:
    """Writes one record per row to gzip-compressed WARC files under ``path``.

    The payload is the page in UTF-8, empty for null. Of rows with equal payloads of at least
    ``LEAST_SHARED`` bytes those with the smallest id are responses, the others revisits; where all
    ids are null, all are responses. A null url gives a urn.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.filter(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.when(F.col("page").isNotNull(), F.struct("page", "url"))).alias("first"))
        .filter("n > 1 and first is not null").select("digest", "first")
    )
    joined = rows.join(shared, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first.page"))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page, url, digest, payload, first, first_url in zip(*(c.to_pylist() for c in b.columns)):
                count += 1
                fields = {
                    "WARC-Type": "response" if first is None else "revisit",
                    "WARC-Record-ID": _urn(f"{page} {digest} {part} {count}"), "WARC-Date": date,
                    "WARC-Target-URI": _uri(url, page), "WARC-Payload-Digest": f"sha256:{digest}",
                    "Content-Type": "application/http; msgtype=response",
                    "Page-ID": None if page is None else quote(page),
                }
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if first is None:
                    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
                else:
                    block = head + b"\r\n"
                    fields |= {
                        "WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": _uri(first_url, first),
                        "WARC-Refers-To-Date": date, "Refers-To-Page-ID": quote(first),
                    }
                for r in segments(fields, block, segment):
                    if size + len(r) > pack and held:
                        yield pa.RecordBatch.from_pydict({"records": pa.array([END.join(held)], pa.binary())})
                        held, size = [], 0
                    held.append(r)
                    size += len(r)
        if held:
            yield pa.RecordBatch.from_pydict({"records": pa.array([END.join(held)], pa.binary())})

    # the payload of a revisit is not needed any more
    lean = joined.select(
        F.col("page").cast("string"), "url", "digest", F.when(~again, F.col("payload")).alias("payload"),
        F.when(again, F.col("first.page").cast("string")).alias("first"), F.when(again, F.col("first.url")).alias("first_url"),
    )
    lean.mapInArrow(write, "records binary").select(F.col("records").cast("string")).write.option(
        "lineSep", END.decode()
    ).option("compression", "gzip").option("maxRecordsPerFile", PACKS_PER_FILE).text(path)


RECORD = (
    "type string, id string, url string, page string, refers_to string, digest string, "
    "origin string, segment int, total bigint, block binary"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, segments still apart."""
    from urllib.parse import unquote

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for f, block in records(data):
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    page, refers = f.get("page-id"), f.get("refers-to-page-id")
                    rows.append((
                        f["warc-type"], f["warc-record-id"], f.get("warc-target-uri"),
                        None if page is None else unquote(page), None if refers is None else unquote(refers),
                        f.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                        f.get("warc-segment-origin-id") or (f["warc-record-id"] if number else None),
                        None if number is None else int(number), None if total is None else int(total), block,
                    ))
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def joined_block(numbers: list[int], totals: list[int | None], blocks: list[bytes]) -> bytes:
    """The block of a segmented record; ValueError if segments are missing, doubled or of a wrong total."""
    order = sorted(range(len(numbers)), key=lambda k: numbers[k])
    if [numbers[k] for k in order] != list(range(1, len(numbers) + 1)):
        raise ValueError("segments missing or doubled")
    whole = b"".join(blocks[k] for k in order)
    total = totals[order[-1]]
    if total is None or total != len(whole):
        raise ValueError("total length wrong")
    return whole


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, url, page, refers_to, digest, n_segments, error, payload) of every logical record.

    A record whose segments or chunks do not fit together has a null payload and says why in
    ``error``. The payload of a revisit is null.
    """
    rows = read_records(spark, path)
    own = ["type", "id", "url", "page", "refers_to", "digest"]
    part = F.struct("segment", "total", "block")
    whole = rows.filter("segment is null").select(*own, F.array(part).alias("parts"))
    first = F.first(F.when(F.col("segment") == 1, F.struct(*own)), ignorenulls=True)
    split = (
        rows.filter("segment is not null").groupBy("origin").agg(first.alias("own"), F.collect_list(part).alias("parts"))
        .select(
            F.coalesce("own.type", F.lit("continuation")).alias("type"), F.coalesce("own.id", "origin").alias("id"),
            *[F.col(f"own.{c}") for c in own[2:]], "parts",
        )
    )

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            payloads, errors, counts = [], [], []
            for kind, parts in zip(b.column(0).to_pylist(), b.column(6).to_pylist()):
                payload = error = None
                try:
                    numbers, totals, blocks = ([p[k] for p in parts] for k in ("segment", "total", "block"))
                    block = blocks[0] if numbers[0] is None else joined_block(numbers, totals, blocks)
                    payload = http_payload(block) if kind == "response" else None
                except ValueError as broken:
                    error = str(broken)
                payloads.append(payload)
                errors.append(error)
                counts.append(len(parts))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in range(6)], pa.array(counts, pa.int32()), pa.array(errors, pa.string()), pa.array(payloads, pa.binary())],
                [*own, "n_segments", "error", "payload"],
            )

    kinds = ", ".join(f"{c} string" for c in own)
    return whole.unionByName(split).mapInArrow(decode, f"{kinds}, n_segments int, error string, payload binary")


def page_digests(records_: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error) of logical records.

    Length and digest are those of the payload read; a revisit gets them from the response it
    refers to, and is an error if its stated digest differs.
    """
    from .storage import stored

    r = stored(records_.select(
        F.col("page").cast(id_type).alias("page_id"), F.col("type").alias("record_type"),
        F.col("refers_to").cast(id_type).alias("refers_to"), F.col("digest").alias("stated"), "error",
        F.octet_length("payload").cast("bigint").alias("n"), F.sha2("payload", 256).alias("sha"),
    ))
    response = r.filter("record_type = 'response'")
    held = response.select(F.col("page_id").alias("refers_to"), F.col("sha").alias("stated"), F.col("n").alias("m")).distinct()
    again = r.filter("record_type = 'revisit'").join(held, ["refers_to", "stated"], "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
    wrong: Column = F.when(F.col("sha") != F.col("stated"), F.lit("digest wrong"))
    return response.select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to",
        F.coalesce("error", wrong).alias("error"),
    ).unionByName(again.select(
        "page_id", F.col("m").alias("payload_bytes"), F.when(F.col("m").isNotNull(), F.col("stated")).alias("payload_digest"),
        "record_type", "refers_to", F.when(F.col("m").isNull(), F.lit("response missing")).alias("error"),
    )).select(*out)
