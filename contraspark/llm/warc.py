"""WARC archives: a writer with revisit records and a reader that salvages damaged archives.

Writer: tasks turn rows into records, each a gzip member of its own, and Spark's text sink puts their
bytes into files on any store Spark can write. A line of the sink is a run of records of about
``RUN_BYTES``, and a file takes ``RUNS_PER_FILE`` of them, so files are bounded by bytes (a single
longer record stands alone in its run). The sink's line separator is an empty gzip member, so the
files are plain concatenations of members; without compression it is the blank lines that end a record.

Reader: archives come through Spark's binaryFile source, so an archive is a task's unit of work: it
must fit into an executor's memory about three times, and be below Spark's 2 GB. The reader goes once
over the bytes; gzip members are fed to the decompressor piece by piece. Each record is checked: version
line, header fields, Content-Length inside the data, the closing blank lines, and the payload digest.
After a failed check the reader looks for the next gzip member or version line that starts a valid
record and goes on there; the bytes in between are returned as a gap with their reason, never lost
silently.

Defined cases: null payloads count as empty; null target URIs are written as an empty field; null ids
are written as ``null``. A row that has its group's largest id is a response, even if several rows
share that id; when all ids of a group are null, all its rows are responses. A revisit whose response
is not among the records keeps the digest that its own header declares and has a null payload_bytes.
Payloads of any length are written and read as a whole. Other columns are not read. Empty tables give
empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contraspark.llm.common import attach_stats, materialise, slices

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 1000
#: Bytes of the records in one run, and runs in one file.
RUN_BYTES, RUNS_PER_FILE = 1 << 20, 32
#: Compressed bytes given to the decompressor at first; twice as many each time.
_PIECE = 1 << 14
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
_URN = "urn:row:"


def plan_revisits(rows: DataFrame, id_col: str, payload_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``rows`` as (id, uri?, payload) plus record_type and refers_to.

    Of records whose payloads are equal and of ``min_bytes`` at least, the one with the largest id is
    the response and the others revisit it.
    """
    long = F.octet_length(payload_col) >= min_bytes
    # Short payloads are no group: each is keyed by its own id's salt, and its key's statistic is unused.
    key = F.when(long, F.sha2(F.col(payload_col), 256)).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64(id_col), F.lit(4096)).cast("string")))
    out = attach_stats(rows.withColumn("_key", key), ["_key"], [F.max(id_col).alias("_top")], F.col(id_col))
    revisit = long & F.col("_top").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_top"))
    return out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_top"))).drop("_key", "_top")


def _record(key: object, uri: str | None, payload: bytes, kind: str, refers_to: object) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    named = lambda x: f"<{_URN}{'null' if x is None else x}>"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", named(key)), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), *([("WARC-Refers-To", named(refers_to)), ("WARC-Profile", REVISIT_PROFILE)] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warc(rows: DataFrame, path: str, compress: bool = True, level: int = 6, run_bytes: int = RUN_BYTES, runs_per_file: int = RUNS_PER_FILE) -> None:
    """Write (id, uri, payload binary, record_type, refers_to) as WARC 1.1 files below ``path``."""

    def packed(record: bytes) -> bytes:
        if not compress:
            return record
        member = zlib.compressobj(level, zlib.DEFLATED, 31)
        return member.compress(record) + member.flush()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The separator puts the blank lines back that end the last record of an uncompressed run.
        line = lambda held: pa.record_batch([pa.array([b"".join(held) if compress else b"".join(held)[:-4]], pa.binary())], ["record"])
        held, size = [], 0
        for batch in slices(batches, "payload"):
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                record = packed(_record(*row))
                if held and size + len(record) > run_bytes:
                    yield line(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield line(held)

    separator = _EMPTY_MEMBER.decode("iso-8859-1") if compress else "\r\n\r\n"
    rows = rows.select("id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"), "record_type", "refers_to")
    (
        rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", runs_per_file).text(path)
    )


# ---- reading -------------------------------------------------------------------------------------

_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_START = re.compile(rb"WARC/1\.[01]\r?\n|\x1f\x8b\x08")

_MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


class _Damaged(Exception):
    pass


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``at`` and where it ends."""
    unzip, view, parts, end, piece = zlib.decompressobj(31), memoryview(data), [], at, _PIECE
    try:
        while not unzip.eof and end < len(data):
            parts.append(unzip.decompress(view[end : end + piece]))
            end = min(len(data), end + piece)
            piece *= 2
    except zlib.error as e:
        raise _Damaged(f"gzip: {e}") from None
    if not unzip.eof:
        raise _Damaged("gzip: the member is cut off")
    return b"".join(parts), end - len(unzip.unused_data)


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Header fields, payload and end of the record at ``at``."""
    version = _VERSION.match(data, at)
    if not version:
        raise _Damaged("no version line")
    head = data.find(b"\r\n\r\n", version.end() - 2)
    if head < 0:
        raise _Damaged("the header does not end")
    fields: dict[str, str] = {}
    for line in data[version.end() : head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Damaged("a header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if missing := [f for f in _MANDATORY if f not in fields]:
        raise _Damaged(f"no {missing[0]}")
    if not re.fullmatch(r"\d+", size := fields.get("content-length", "")):
        raise _Damaged("no valid Content-Length")
    end = head + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise _Damaged("the record does not end where its length says")
    block = data[head + 4 : end]
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
    digest = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") != "revisit" and digest.startswith("sha1:"):
        found = hashlib.sha1(payload)
        if digest[5:] not in (base64.b32encode(found.digest()).decode(), found.hexdigest()):
            raise _Damaged("the payload does not have its digest")
    return fields, payload, end + 4


def _bare(digest: str) -> str | None:
    """A declared SHA-1 digest, Base32 or hex, as bare hex."""
    value = digest.removeprefix("sha1:")
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value).hex() if re.fullmatch("[A-Z2-7]{32}", value) else None


def read_records(data: bytes, offset: int = 0) -> Iterator[tuple]:
    """(offset, length, fields, payload, None) for each record and (offset, length, None, None, reason) for each gap."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                content, end = _member(data, at)
                found = [(at, end - at, *x[2:]) for x in read_records(content)]
            else:
                fields, payload, end = _parse(data, at)
                found = [(at, end - at, fields, payload, None)]
        except _Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap >= 0:
            yield offset + gap, at - gap, None, None, reason
            gap = -1
        yield from ((offset + a, n, *rest) for a, n, *rest in found)
        at = end
    if gap >= 0:
        yield offset + gap, len(data) - gap, None, None, reason


_SCHEMA = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap_reason", pa.string()), ("record_type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("payload", pa.binary()),
])
READ_SCHEMA = "path string, offset long, length long, gap_reason string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, declared_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record and per gap (gap_reason set) of the archives below ``path``.

    offset and length are in bytes of the stored file; for a damaged record inside an intact gzip
    member they are those of the member. Digests are computed from the payload as read, bare hex.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for at, size, fields, payload, reason in read_records(batch.column(1)[i].as_py()):
                    if reason is not None:
                        rows.append((name, at, size, reason, *[None] * 8))
                    else:
                        row_id = lambda key, f=fields: f.get(key, "").strip("<>").removeprefix(_URN) or None
                        rows.append((
                            name, at, size, None, fields.get("warc-type"), row_id("warc-record-id"), fields.get("warc-target-uri"), row_id("warc-refers-to"),
                            len(payload), hashlib.sha1(payload).hexdigest(), _bare(fields.get("warc-payload-digest", "")), payload if with_payload else None,
                        ))
                        held += len(payload)
                    if len(rows) >= 5000 or held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, READ_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to), revisits with their response's payload figures."""
    number = lambda c: F.col(c).try_cast("long")
    rows = records.where("gap_reason is null").select(
        number("record_id").alias("id"), number("refers_to").alias("refers_to"), "record_type", "payload_bytes", "payload_digest", "declared_digest",
    ).withColumn("_of", F.coalesce("refers_to", "id"))
    rows = materialise(rows, "warc-records")  # the archives are parsed once
    own = lambda c: F.max(F.when(F.col("record_type") == "response", F.col(c)))
    rows = attach_stats(rows, ["_of"], [own("payload_bytes").alias("_n"), own("payload_digest").alias("_d")], F.col("id"))
    revisit = F.col("record_type") == "revisit"
    return rows.select(
        "id", F.when(revisit, F.col("_n")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.coalesce("_d", "declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
