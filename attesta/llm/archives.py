"""Web archives: writing WARC files and reading them back, with segments reassembled.

`write_archives` gives each page a record: of pages with equal payloads of `least` bytes or more the
one of the largest page_id is a response and the others revisit it; all other pages are responses.
Payloads go in chunked transfer framing, and blocks over `segment` bytes are cut into a response and
continuations (WARC/1.1, ISO 28500). Files hold a bounded number of records of bounded size.

`read_archives` parses records by their Content-Length, so payloads may hold anything. Gzipped files, of
one member or many, are streamed a record at a time, whatever their size; others are read whole, up to
the 2 GB of a binary value. Records that
name an origin are grouped by it, ordered by segment number and checked: numbers run from 1, and the
last gives the total length, which must be that of the parts. Then the chunked framing is taken off
and the payload digest is checked. `status` is ok, missing segment, wrong length, bad framing or
wrong digest; only ok records have a payload.

A null html is an empty payload, a null url gives no target URI, and a null page_id comes back as
null. Pages of null page_id are the response only of payloads that no other page has. Repeated rows
each get a record, those of the largest page_id all as responses. An empty table gives no records.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST, SEGMENT, CHUNK, RECORDS_PER_FILE = 1000, 64 << 10, 8 << 10, 500
DATE = "2026-01-01T00:00:00Z"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\nX-Payload-Length: %d\r\n\r\n"


def record_id(page_id: int | None, mark: str) -> str:
    """A URN that names the page; the mark tells pages of one page_id apart."""
    return f"urn:page:{'' if page_id is None else page_id}:{mark}"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<?urn:page:(-?\d+):[0-9a-f]{16}>?", urn or "")
    return int(found[1]) if found else None


def chunked(payload: bytes, most: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + most]), payload[i : i + most]) for i in range(0, len(payload), most)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """What chunked framing holds, extensions and trailers left out; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        size = body[at:line].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode("utf-8", "replace") + b"\r\n"


def records_of(urn: str, url: str | None, kind: str, refers_to: str | None, digest: str, block: bytes, segment: int) -> Iterator[bytes]:
    """The record of a page: one, or a segment and its continuations."""
    safe = None if url is None else re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    about = [("WARC-Type", kind), ("WARC-Record-ID", f"<{urn}>"), ("WARC-Date", DATE), ("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to:
        about += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    about.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment:
        yield header([*about, ("Content-Length", len(block))]) + block
        return
    yield header([*about, ("WARC-Segment-Number", 1), ("Content-Length", segment)]) + block[:segment]
    for n, at in enumerate(range(segment, len(block), segment), 2):
        part = block[at : at + segment]
        total = len(block) if at + segment >= len(block) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{urn}#{n}')}>"), ("WARC-Date", DATE), ("WARC-Target-URI", safe)]
        fields += [("WARC-Segment-Origin-ID", f"<{urn}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total), ("Content-Length", len(part))]
        yield header(fields) + part


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Writes the pages as gzipped WARC files under the path."""
    shared.small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    mark = F.substring(F.md5(F.concat_ws("|", "url", "digest")), 1, 16)
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("mark", mark)
    long = rows.where(F.octet_length("payload") >= least)
    copies = long.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"), F.max(F.struct("page_id", "mark")).alias("kept"))
    copies = copies.where("n > 1 and keeper is not null").select(F.col("digest").alias("of"), "keeper", F.col("kept.mark").alias("keeper_mark"))
    # few digests come again: payloads stay where they are
    copies = shared.bounded(shared.stage(copies, "copies"), 128)
    rows = rows.join(copies, (F.col("digest") == F.col("of")) & (F.octet_length("payload") >= least), "left")

    def write(batches):
        for batch in batches:
            out: list[bytes] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "mark", "keeper", "keeper_mark"))):
                page, url, payload, digest, mark, keeper, keeper_mark = row
                revisit = keeper is not None and page != keeper
                block = HTTP % len(payload) + (b"" if revisit else chunked(payload))
                refers_to = record_id(keeper, keeper_mark) if revisit else None
                out += records_of(record_id(page, mark), url, "revisit" if revisit else "response", refers_to, digest, block, segment)
            for at in range(0, len(out), RECORDS_PER_FILE):
                yield pa.RecordBatch.from_arrays([pa.array(out[at : at + RECORDS_PER_FILE], pa.binary())], ["record"])

    records = rows.select("page_id", "url", "payload", "digest", "mark", "keeper", "keeper_mark").mapInArrow(shared.lean(write), "record binary")
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path, compression="gzip")


# ---------------------------------------------------------------- reading

RECORD = "record_id string, record_type string, target_uri string, refers_to string, digest string, origin_id string, number int, total long, block binary"


def fields_of(head: bytes) -> dict[str, str]:
    """The fields of a record's head, by lower-case name."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records_in(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields and the block of each record, from what stands between the blank lines of an archive.
    A block goes on over blank lines until it has the length that its head tells."""
    fields, parts, held, need = None, [], 0, 0
    for piece in pieces:
        while piece is not None:
            if fields is None:
                at = piece.find(b"WARC/")
                if at < 0:
                    break
                fields, parts, held = fields_of(piece[at:]), [], 0
                need, piece = int(fields.get("content-length", "0")), None
            else:
                parts += [END, piece] if parts else [piece]
                held += len(piece) + (len(END) if len(parts) > 1 else 0)
                piece = None
            if fields is not None and held >= need:
                block = b"".join(parts)
                yield fields, block[:need]
                fields, piece = None, block[need:] or None
    if fields is not None and parts:
        yield fields, b"".join(parts)


def record_batches(found: Iterable[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for f, block in found:
        number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
        origin = f.get("warc-segment-origin-id") or (f.get("warc-record-id") if number else None)
        rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest"), origin, int(number) if number else None, int(total) if total else None, block))
        held += len(block)
        if held > 1 << 23:
            yield _record_rows(rows)
            rows, held = [], 0
    if rows:
        yield _record_rows(rows)


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under the path as they stand, segments apart."""

    def whole(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from record_batches(records_in(content.as_py().split(END)))

    def streamed(batches):
        pieces = ((f, p) for batch in batches for f, p in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()))
        for _, of_file in itertools.groupby(pieces, lambda x: x[0]):  # a file lies in one task, in order
            yield from record_batches(records_in(p for _, p in of_file))

    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(path).select("content").mapInArrow(shared.lean(whole), RECORD)
    zipped = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.gz").text(path)
    zipped = zipped.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return zipped.mapInArrow(shared.lean(streamed), RECORD).union(plain)


def _record_rows(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.string()
    kinds = (text, text, text, text, text, text, pa.int32(), pa.int64(), pa.binary())
    names = ("record_id", "record_type", "target_uri", "refers_to", "digest", "origin_id", "number", "total", "block")
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], list(names))


PAGE = "page_id long, record_id string, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, status string"


def decoded(record_id, record_type, target_uri, refers_to, digest, block, status) -> tuple:
    """A row of PAGE from a whole record."""
    head, _, body = block.partition(END)
    told = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    digest = (digest or "").removeprefix("sha1:")
    size, payload = int(told.get(b"X-Payload-Length", 0)), None
    if status == "ok" and record_type != "revisit":
        payload = unchunked(body) if told.get(b"Transfer-Encoding") == b"chunked" else body
        if payload is None:
            status = "bad framing"
        elif hashlib.sha1(payload).hexdigest() != digest:
            status, payload = "wrong digest", None
        else:
            size = len(payload)
    return page_of(record_id), record_id, record_type, target_uri, page_of(refers_to), size, digest, payload, status


def _page_rows(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.string()
    kinds = (pa.int64(), text, text, text, pa.int64(), pa.int64(), text, pa.binary(), text)
    names = [x.split()[0] for x in PAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


_WHOLE = ("record_id", "record_type", "target_uri", "refers_to", "digest", "block")


def assembled(segments: list[dict]) -> Iterator[tuple]:
    """Rows of PAGE from the segments of one origin; an origin that was written r times has r rows."""
    by_number: dict[int, list[dict]] = {}
    for s in segments:
        by_number.setdefault(s["number"], []).append(s)
    heads = by_number.get(1, [])
    last = max(by_number)
    for copy in range(max(1, len(heads))):
        parts = [by_number.get(n, [])[copy : copy + 1] for n in range(1, last + 1)]
        first = parts[0][0] if parts[0] else segments[0]
        if not all(parts) or parts[-1][0]["total"] is None:
            status, block = "missing segment", b""
        else:
            block = b"".join(p[0]["block"] for p in parts)
            status = "ok" if len(block) == parts[-1][0]["total"] else "wrong length"
        yield decoded(first["origin_id"], first["record_type"], first["target_uri"], first["refers_to"], first["digest"], block, status)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row of PAGE for each response and revisit of the archives."""
    records = archive_records(spark, path)

    def whole(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in _WHOLE)))
            for at in range(0, len(rows), 500):
                yield _page_rows([decoded(*r, "ok") for r in rows[at : at + 500]])

    def join(batches):
        for table in shared.runs(batches, "origin_id"):
            yield _page_rows(list(assembled(table.to_pylist())))

    alone = records.where("origin_id is null and record_type in ('response', 'revisit')").mapInArrow(shared.lean(whole), PAGE)
    cut = records.where("origin_id is not null").repartition("origin_id").sortWithinPartitions("origin_id", "number")
    return alone.union(cut.mapInArrow(shared.lean(join), PAGE))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = read_archives(spark, path)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


OP8_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM h WHERE payload_bytes >= {LEAST} GROUP BY 1 HAVING count(*) > 1)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
       CASE WHEN k.keeper <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper <> h.page_id THEN k.keeper END AS refers_to, 'ok' AS status
FROM h LEFT JOIN k ON h.payload_digest = k.payload_digest AND h.payload_bytes >= {LEAST}
"""
