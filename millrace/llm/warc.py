"""WARC archives: a writer with one gzip member per record, and a reader that salvages damaged archives.

The writer joins records to blocks of bounded size, and Spark's text writer stores each block as one file, on any
file system that Spark knows. The last member of a file is a small ``metadata`` record; the size field at its end
closes with a zero byte, which is what the text writer is told to put behind each row, so files hold members only.

The reader gets whole files. Where a member or record fails a check, it searches for the next gzip magic number or
version line at which a valid record starts, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pick, slices
from millrace.session import materialize, new_folder

#: Compressed bytes after which a file is closed, and gzip's level.
FILE_BYTES = 8 << 20
LEVEL = 5

#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 1000

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Header fields that a record has once.
ONCE = ("warc-type", "warc-record-id", "content-length")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, response_id``: the id of the response that a record revisits, else null.

    Of equal payloads of ``least`` bytes or more, that with the largest ``page_id`` is the response. Only digests that
    occur more than once are kept to decide this; they are counted in each task first, and joined by Spark's choice
    from their written size, so pages are not shuffled for a small number of copies, and a digest that fills a task
    is split. Rows without id revisit a row with id, and are responses if there is none. Rows that repeat the largest id are
    responses each.
    """
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", payload(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    long = rows.where(F.octet_length("payload") >= least)
    groups = long.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    repeated = materialize(groups.where("n > 1 and response_id is not null").select("digest", "response_id"), "repeated")
    out = rows.join(repeated.withColumnRenamed("digest", "__digest"), F.col("digest") == F.col("__digest"), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return out.select("page_id", "url", "payload", "digest", F.when(other, F.col("response_id")).alias("response_id"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + END + block + END


def page_record(page_id: int | None, url: str | None, body: bytes, digest: str, response_id: int | None) -> bytes:
    """A response, or a revisit that has the headers of the response alone."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if response_id is None:
        return record("response", fields, head + body)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(response_id))], head)


def member(raw: bytes, level: int = LEVEL) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for every row of ``pages`` (``page_id, url, html``) to archives in ``folder``.

    The payload is the html in UTF-8, empty for null. A file is closed after ``file_bytes``, so a task holds one file and
    one page. An empty table writes no archive with records.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            fields = [("WARC-Record-ID", "<urn:page:archive>"), ("WARC-Date", DATE), ("Content-Type", "text/plain")]
            last = member(record("metadata", fields, f"records: {len(parts)}\r\n".encode()))
            assert last[-1] == 0
            return pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, last[:-1]])], pa.binary())], names=["value"])

        for part in slices(batches, "payload"):
            for page_id, url, text, digest, response_id in zip(*[c.to_pylist() for c in part.columns], strict=True):
                parts.append(member(page_record(page_id, url, text.encode("utf-8", "replace"), digest, response_id)))
                size += len(parts[-1])
                if size >= file_bytes:
                    yield close()
                    parts, size = [], 0
        if parts:
            yield close()

    blocks = plan_records(pages, least).mapInArrow(run, "value binary")
    text = blocks.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(folder)


def _inflate(data: memoryview, start: int) -> tuple[bytes, int | None]:
    """The content of the gzip member at ``start`` and where it ends; what comes before the damage and None if it is damaged or cut."""
    unpack = zlib.decompressobj(31)
    out, at, step = [], start, 1 << 14
    while at < len(data) and not unpack.eof:
        piece = data[at : at + step]
        try:
            out.append(unpack.decompress(piece))
        except zlib.error:
            out.append(_last_bytes(data, start, at, len(piece)))
            return b"".join(out), None
        at += len(piece)
        step = min(step * 2, 1 << 18)
    return b"".join(out), at - len(unpack.unused_data) if unpack.eof else None


def _last_bytes(data: memoryview, start: int, at: int, size: int) -> bytes:
    """What can be inflated of the piece in which the damage is, which zlib loses as a whole: it is fed by single bytes."""
    unpack = zlib.decompressobj(31)
    if at > start:
        unpack.decompress(data[start:at])
    out = []
    try:
        for k in range(at, at + size):
            out.append(unpack.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _parse(data: bytes, start: int) -> tuple[dict, int, str] | None:
    """The record at ``start``, where it ends, and what is wrong with its content; None if it is no record."""
    line = data.find(b"\r\n", start, start + 16)
    stop = data.find(END, start)
    if line < 0 or stop < 0 or not data.startswith(b"WARC/1.", start):
        return None
    fields: dict[str, str] = {}
    for row in data[line + 2 : stop].split(b"\r\n"):
        key, colon, value = row.partition(b":")
        name = key.decode("utf-8", "replace").strip().lower()
        if not colon or b"\r" in row or b"\n" in row or (name in ONCE and name in fields):
            return None  # what follows a cut header is another record's
        fields[name] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in fields:
        return None
    first, last = stop + 4, stop + 4 + int(length)
    if data[last : last + 4] != END:
        return None
    block = data[first:last]
    found = {"type": fields["warc-type"], "fields": fields, "payload": block, "declared": None}
    if fields.get("content-type", "").startswith("application/http"):
        head, split, body = block.partition(END)
        declared = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
        found |= {"payload": body if split else b"", "declared": int(declared[1]) if declared else None}
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    wrong = ""
    if found["type"] == "response":
        found["digest"] = hashlib.sha1(found["payload"]).hexdigest()
        if algorithm == "sha1" and len(digest) == 40 and digest.lower() != found["digest"]:
            wrong = "payload digest differs"
        elif found["declared"] is not None and found["declared"] != len(found["payload"]):
            wrong = "payload length differs"
    else:
        found["digest"] = digest.lower() or None
    return found, last + 4, wrong


def _records(data: bytes, members: bool) -> Iterator[tuple[int, int, list[dict], str]]:
    """(offset, bytes, records, reason) of everything in ``data``, in order; a reason stands for a gap.

    Records that share a member come together. Of a damaged member those before the damage are told with no bytes,
    since a gap covers it. ``members``: gzip members are looked for, as they are not inside of one.
    """
    view, n = memoryview(data), len(data)
    at, gap, reason = 0, None, ""

    def closed(stop: int) -> Iterator[tuple[int, int, list[dict], str]]:
        if gap is not None:
            yield gap, stop - gap, [], reason

    while at < n:
        good: list[dict] = []
        stop, why = None, "no member or version line"
        if members and data.startswith(b"\x1f\x8b\x08", at):
            content, stop = _inflate(view, at)
            parts = list(_records(content, False))
            good = [r for _, _, found, _ in parts for r in found]
            wrong = [x for *_, x in parts if x]
            why = "damaged member" if stop is None else wrong[0] if wrong else "" if good else "no record in the member"
        elif data.startswith(b"WARC/1.", at):
            parsed = _parse(data, at)
            why = "damaged record"
            if parsed:
                record, stop, why = parsed
                good = [] if why else [record]
        if good:
            yield from closed(at)
            gap = None
            if not why:
                yield at, stop - at, good, ""
                at = stop
                continue
            yield at, 0, good, ""
        if gap is None:
            gap, reason = at, why
        if stop is not None:  # a sound member or record with something wrong inside: what is in it is no record
            at = stop
        else:
            following = START.search(data, at + 1)
            at = following.start() if following else n
    yield from closed(n)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, bytes, record or None, reason) of everything in an archive, in order; None stands for a gap.

    The bytes of all rows cover the archive once. Records of one member have its offset, and the first one its bytes; a
    member is held inflated. Records in front of the damage of a member have no bytes, as the gap has them.
    """
    for offset, size, records, reason in _records(data, True):
        if reason:
            yield offset, size, None, reason
        for k, record in enumerate(records):
            yield offset, 0 if k else size, record, ""


RECORDS = (
    "kind string, path string, offset bigint, bytes bigint, reason string, record_type string, record_id string, "
    "uri string, refers_to string, digest string, payload_bytes bigint, payload binary"
)


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives in ``folder``, gzip members or plain, by ``kind``.

    ``offset`` and ``bytes`` say where in its file each is found; together they cover every file. A gap has a ``reason``.
    ``payload_bytes`` and ``digest`` are of the whole payload, also for a revisit. A task holds a file at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, held = batch.column(0)[i].as_py(), [], 0
                for offset, size, found, reason in salvage(batch.column(1)[i].as_py()):
                    rows.append(_row(path, offset, size, found, reason, with_payload))
                    held += size
                    if held >= FILE_BYTES:
                        yield _batch(rows, kinds, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds, names)

    return files.mapInArrow(run, RECORDS)


def _row(path: str, offset: int, size: int, found: dict | None, reason: str, with_payload: bool) -> tuple:
    if found is None:
        return ("gap", path, offset, size, reason, *[None] * 7)
    get, length = found["fields"].get, len(found["payload"])
    if found["type"] == "revisit" and found["declared"] is not None:
        length = found["declared"]
    described = (found["type"], get("warc-record-id"), get("warc-target-uri"), get("warc-refers-to"), found["digest"], length)
    return ("record", path, offset, size, None, *described, found["payload"] if with_payload else None)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder, and report every page as it is read back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A null html is an empty payload; a null id
    comes back null. Repeated rows come back repeated. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write(pages, folder)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1)
    records = read(spark, folder, with_payload=False).where("kind = 'record' and record_type in ('response', 'revisit')")
    whole = lambda c: F.when(number(c) != "", number(c)).cast("bigint")
    return records.select(
        whole(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        whole(F.col("refers_to")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) END AS response
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response IS NULL OR response = page_id THEN NULL ELSE response END AS refers_to
FROM r
"""
