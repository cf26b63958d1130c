"""Writing and reading WARC archives compressed with Zstandard.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a
dictionary; after it comes one Zstandard frame for each record, compressed
with that dictionary.  The reader loads the dictionary from the leading frame,
decodes frame by frame in constant memory, and refuses records whose version
line, mandatory headers, Content-Length or digests are wrong.

Archives of other writers are read as well: header names count in any case, with
or without a space after the colon, folded over several lines or repeated; all
record types and any record id; digests by SHA-1, SHA-256 or MD5 in hex or base
32; archives without a dictionary and with other skippable frames.

``write_warc`` is a map over partitions: each task streams its records into
archives in the shared folder and returns one manifest row for each archive.  A
task that is run again writes under another name, and only archives named in
the committed manifest are read, so lost executors leave no half archives
behind in the result.  ``read_warc`` opens archives on the executors.  Every record
has an id of its own; the page's id, which may be repeated or null, is in a header
of ours, and so is the page a revisit refers to.

Defined cases: a null payload is empty; null ids are kept; a page repeated
with the smallest id of its payload is a response each time; empty tables give
no archives; page_id and refers_to are null for records of other writers, whose
ids are in record_id and refers_to_id; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm._spark import ship, staged, workspace

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: Revisits are recorded for payloads of at least so many bytes.
REVISIT_BYTES = 100
#: Payload bytes in an archive before the next one is begun.
ROLL_BYTES = 256 << 20
#: The dictionary of an archive is trained on its first records, up to so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = ("WARC/0.17", "WARC/0.18", "WARC/1.0", "WARC/1.1")
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Our own headers: the page of a record, and the page a revisit refers to.
PAGE_HEADER, REFERS_HEADER = "X-Page-ID", "X-Refers-To-Page"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Up to so many repeated payloads are broadcast to the pages, more are joined by shuffle.
BROADCAST_DIGESTS = 500_000
MANIFEST = "archive string, records bigint, payload_bytes bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, record_id string, refers_to_id string, target_uri string"


def _page(value: str | None) -> int | None:
    return None if value in (None, "null") else int(value)


def encode_record(page: int | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, url: str | None = None) -> bytes:
    block = HTTP % size + (b"" if revisit else payload)
    name = lambda x: "null" if x is None else str(x)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"{PAGE_HEADER}: {name(page)}",
    ]
    if url:
        head.insert(4, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"{REFERS_HEADER}: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    """A record as the reader returns it, with all its headers as (name, value) in their order."""

    page_id: int | None
    payload_bytes: int
    payload_digest: str | None
    record_type: str
    refers_to: int | None
    payload: bytes
    record_id: str
    refers_to_id: str | None
    target_uri: str | None
    headers: list[tuple[str, str]]


def parse_headers(lines: list[str]) -> list[tuple[str, str]]:
    """(name, value) of each header; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t"):
            if not out:
                raise ValueError("the first header is a continuation line")
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        out.append((name, value.strip()))
    return out


def check_digest(stated: str, content: bytes, what: str) -> None:
    """ValueError if a labelled digest, in hex or base 32, isn't that of the content; unknown algorithms are passed over."""
    kind, colon, value = stated.partition(":")
    kind = kind.lower().replace("-", "")
    if not colon or kind not in ("sha1", "sha256", "md5"):
        return
    actual = hashlib.new(kind, content, usedforsecurity=False)
    if value.lower() != actual.hexdigest() and value.upper().rstrip("=") != base64.b32encode(actual.digest()).decode().rstrip("="):
        raise ValueError(f"the {what} digest differs")


def decode_record(raw: bytes) -> Record:
    """The record of a frame; ValueError if it is not valid."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or version.strip() not in VERSIONS:
        raise ValueError(f"no WARC version line: {version[:40]!r}")
    headers = parse_headers(lines)
    first: dict[str, str] = {}
    for name, value in headers:
        first.setdefault(name.lower(), value)
    if missing := [h for h in MANDATORY if not first.get(h.lower())]:
        raise ValueError(f"record without {missing}")
    if not first["content-length"].isdecimal():
        raise ValueError(f"Content-Length is {first['content-length'][:40]!r}")
    length = int(first["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the frame holds {len(rest) - 4}")
    block = rest[:length]
    if stated := first.get("warc-block-digest"):
        check_digest(stated, block, "block")
    kind, stated, ours = first["warc-type"].lower(), first.get("warc-payload-digest"), PAGE_HEADER.lower() in first
    payload = block
    size = None
    if first.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else None
    if kind == "revisit":
        if ours and (payload or REFERS_HEADER.lower() not in first or not stated):
            raise ValueError("a revisit has a payload, or no digest or page that it refers to")
        digest, payload = (stated.removeprefix("sha256:") if stated else None), b""
    else:
        if ours and size != len(payload):
            raise ValueError("the payload's length differs")
        if stated and "warc-truncated" not in first and "warc-segment-number" not in first:
            check_digest(stated, payload, "payload")
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    return Record(_page(first.get(PAGE_HEADER.lower())), size or 0, digest, kind, _page(first.get(REFERS_HEADER.lower())), payload, first["warc-record-id"], first.get("warc-refers-to"), first.get("warc-target-uri"), headers)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from the first records, or from nothing but their bytes where there are too few to train on."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(s[:2048] for s in samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def iter_frames(stream) -> Iterator[bytes]:
    """Contents of each frame of an archive, decoded with the dictionary of the leading skippable frame if there is one."""
    rest = b""

    def need(n: int, or_end: bool = False) -> bytes:
        nonlocal rest
        while len(rest) < n:
            more = stream.read(max(n - len(rest), 1 << 18))
            if not more:
                if or_end and not rest:
                    return b""
                raise ValueError("the archive ends within a frame")
            rest += more
        return rest[:n]

    decoder, leading = zstandard.ZstdDecompressor(), True
    while magic := need(4, or_end=True):
        number = struct.unpack("<I", magic)[0]
        if number in SKIPPABLE_MAGICS:
            size = struct.unpack("<I", need(8)[4:])[0]
            raw = need(8 + size)[8:]
            rest = rest[8 + size :]
            if leading and number == DICTIONARY_MAGIC:
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            leading = False
            continue
        if number != FRAME_MAGIC:
            raise ValueError(f"no Zstandard frame: {magic!r}")
        leading = False
        frame, out = decoder.decompressobj(), []
        while not frame.eof:
            if not rest:
                need(1)
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = name = packer = None
        waiting: list[bytes] = []
        records = total = sample = 0
        manifest: list[tuple[str, int, int]] = []

        def begin() -> None:
            nonlocal out, name, packer
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            out = store.open_output_stream(name, compression=None)
            raw = train_dictionary(waiting)
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw))
            packed = zstandard.ZstdCompressor(level=9).compress(raw)
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            for record in waiting:
                out.write(packer.compress(record))
            waiting.clear()

        def finish() -> None:
            nonlocal out, records, total, sample
            if waiting:
                begin()
            if out is not None:
                out.close()
                manifest.append((name.rpartition("/")[2], records, total))
            out, records, total, sample = None, 0, 0, 0

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "digest", "refers_to", "size", "revisit")]
            for i in range(batch.num_rows):
                page, url, payload, digest, refers_to, size, revisit = (c[i].as_py() for c in columns)
                record = encode_record(page, payload or b"", digest, size, refers_to, revisit, url)
                records, total = records + 1, total + len(record)
                if out is None:
                    waiting.append(record)
                    sample += len(record)
                    if sample >= SAMPLE_BYTES:
                        begin()
                else:
                    out.write(packer.compress(record))
                if total >= roll:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*manifest) if manifest else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "records", "payload_bytes"])

    return run


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """Rows to write: which page is a response and which revisits an earlier one; a revisit carries no payload."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), (F.col(url_col) if url_col else F.lit(None).cast("string")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    first = rows.where(F.col("size") >= least).select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first_page")
    first = staged(first, "warc-repeats")
    # counted before it is sent; then the payloads needn't be shuffled
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    rows = rows.join(first, F.col("digest") == F.col("of"), "left")
    revisit = F.coalesce((F.col("size") >= least) & F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")), F.lit(False))
    return rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", F.when(revisit, F.col("first_page")).alias("refers_to"), "size", revisit.alias("revisit"))


def write_warc(rows: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` into archives; the staged manifest of what was committed."""
    ship(rows.sparkSession)
    return staged(rows.mapInArrow(_writer(folder, roll), MANIFEST), "warc-manifest")


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string()]
        names = [f.split(" ")[0] for f in RECORD.split(", ")]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

        for batch in batches:
            archives, expected = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for archive, count in zip(archives, expected, strict=True):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for raw in iter_frames(stream):
                        r = decode_record(raw)
                        rows.append((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload if payloads and r.record_type != "revisit" else None, r.record_id, r.refers_to_id, r.target_uri))
                        held, seen = held + (len(r.payload) if payloads else 0) + 256, seen + 1
                        if held >= 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if count is not None and seen != count:
                    raise ValueError(f"{archive} holds {seen} records, its manifest says {count}")
                if rows:
                    yield pack(rows)

    return run


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """Records of the archives that the manifest names, or of all archives in the folder."""
    ship(spark)
    if manifest is None:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
        manifest = listed.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.lit(None).cast("long").alias("records"))
    tasks = manifest.select("archive", "records").repartition(max(1, spark.sparkContext.defaultParallelism * 4), "archive")
    out = tasks.mapInArrow(_reader(folder, payloads), RECORD)
    return out if payloads else out.drop("payload")


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write every page as a record and read the archives back, without the payloads."""
    spark = pages.sparkSession
    folder = workspace(spark, "warc")
    records = read_warc(spark, folder, write_warc(with_revisits(pages, **options), folder), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
