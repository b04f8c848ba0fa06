"""Operator 5: WARC archives compressed with Zstandard, written and read back.

Archives follow the public ``.warc.zst`` convention: a leading skippable frame
(magic 0x184D2A5D) holds the dictionary, then every record is a frame of its own.
Archives travel as rows ``(path, content)``, each of bounded size, in a table of
the shared folder, so Spark's commit covers lost executors; the reader takes the
same columns, which are also those of Spark's ``binaryFile`` source, so it reads
archive files as well. ``export_files`` writes them out as files.

Records with equal payloads (of ``min_bytes`` or more) are stored once: the one
with the smallest id is a ``response``, the others are ``revisit`` records that
refer to it. A revisit keeps the HTTP header, so the full payload's length and
digest are read back from its headers.

Edge cases: a null payload is empty; a null id is written as ``null`` and sorts
last; rows that repeat an id and payload are each a response if theirs is the
smallest id; a null or odd URL is written percent-encoded; an empty table gives
no archives and no rows. A damaged record yields a row whose ``error`` says why,
and ends its archive's reading, if the frame itself can't be read. Other columns
are not read and may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import io
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.common import materialize, read

# Fixed values of the WARC/1.1 and Zstandard formats.
SKIPPABLE_MAGIC = 0x184D2A5D.to_bytes(4, "little")
FRAME_MAGIC = 0xFD2FB528.to_bytes(4, "little")
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-record-id", "warc-date", "warc-type", "content-length")

ID_PREFIX = "urn:x-page:"
ARCHIVE_BYTES = 4 << 20          # an archive is closed once it is this large
SAMPLE_PAGES, SAMPLE_BYTES = 256, 64 << 10   # dictionary: so many pages of at most this size
DICTIONARY_BYTES = 32 << 10
WINDOW = 1 << 16                 # bytes handed to the decoder at a time

RECORD_SCHEMA = ("path string, record_id string, record_type string, refers_to string, "
                 "target_uri string, payload_bytes long, payload_digest string, "
                 "payload binary, error string")


class DamagedArchive(ValueError):
    """What is wrong with a frame or record."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record, uncompressed."""
    sha = digest(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    uri = urllib.parse.quote(url, safe="%:/?#[]@!$&'()*+,;=-._~") if url else ID_PREFIX + page
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<{ID_PREFIX}{page}>"), ("WARC-Date", date),
              ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha}"),
              ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def archive_head(dictionary: bytes) -> bytes:
    """The leading skippable frame: the dictionary, itself compressed."""
    packed = zstandard.ZstdCompressor().compress(dictionary) if dictionary else b""
    return SKIPPABLE_MAGIC + len(packed).to_bytes(4, "little") + packed if packed else b""


def _dictionary(content: memoryview) -> tuple[bytes, int]:
    """The dictionary of an archive, and where its records start."""
    if bytes(content[:4]) != SKIPPABLE_MAGIC:
        return b"", 0
    end = 8 + int.from_bytes(content[4:8], "little")
    if len(content) < end:
        raise DamagedArchive("the dictionary's frame is cut off")
    held = bytes(content[8:end])
    if held[:4] == FRAME_MAGIC:
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    return held, end


def frames(content: bytes) -> Iterator[bytes]:
    """Each record of an archive, decoded: one frame a record."""
    view = memoryview(content)
    held, at = _dictionary(view)
    decoder = (zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)) if held
               else zstandard.ZstdDecompressor())
    while at < len(view):
        frame, out = decoder.decompressobj(), []
        try:
            while not frame.eof:
                if at >= len(view):
                    raise DamagedArchive("the last frame is cut off")
                given = view[at:at + WINDOW]
                out.append(frame.decompress(given))
                at += len(given) - len(frame.unused_data)
        except zstandard.ZstdError as error:
            raise DamagedArchive(f"bad frame: {error}") from error
        yield b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise DamagedArchive("a header line has no colon")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def _number(fields: dict[str, str], name: str) -> int:
    if not fields.get(name, "").isascii() or not fields.get(name, "").isdigit():
        raise DamagedArchive(f"{name} is not a number")
    return int(fields[name])


def _page(uri: str) -> str:
    return uri.strip("<>").removeprefix(ID_PREFIX)


def parse(data: bytes) -> dict:
    """The columns of one record; raises ``DamagedArchive`` if it is not valid."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or not version.startswith(b"WARC/1."):
        raise DamagedArchive("no WARC header")
    fields = _fields(lines)
    for name in REQUIRED:
        if name not in fields:
            raise DamagedArchive(f"{name} is missing")
    length = _number(fields, "content-length")
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise DamagedArchive("Content-Length does not fit the record")
    if fields.get("warc-block-digest") not in (None, f"sha1:{digest(block)}"):
        raise DamagedArchive("the block's digest does not fit")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise DamagedArchive("no HTTP header")
    size = _number(_fields(http.partition(b"\r\n")[2]), "content-length")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or said != digest(payload)):
        raise DamagedArchive("the payload does not fit its length or digest")
    if kind == "revisit" and (payload or not said or "warc-refers-to" not in fields):
        raise DamagedArchive("a revisit has a payload, or lacks its digest or what it refers to")
    return {"record_id": _page(fields["warc-record-id"]), "record_type": kind,
            "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
            "target_uri": fields.get("warc-target-uri"), "payload_bytes": size,
            "payload_digest": said, "payload": payload if kind == "response" else None, "error": None}


def train_dictionary(pages: DataFrame, payload: str, count: int = SAMPLE_PAGES,
                     most: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from at most ``count`` payloads of at most ``most`` bytes each."""
    rows = (pages.select(F.col(payload).cast("binary").alias("b"))
            .filter(F.col("b").isNotNull() & F.octet_length("b").between(64, most))
            .limit(count).collect())
    if len(rows) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["b"]) for r in rows]).as_bytes()
    except zstandard.ZstdError:   # too little or too uniform to learn from
        return b""


def revisits(narrow: DataFrame) -> DataFrame:
    """``(_id, _sha, first)`` of the rows of ``(id, sha)`` that are not the first of their digest.

    No payload takes part, and both sides of the join are plain shuffles, so a digest
    of very many pages is split. Payloads then meet these rows by id and digest, a key
    that only rows equal in both share.
    """
    first = materialize(narrow.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
                        .filter("n > 1 AND first IS NOT NULL").select("sha", "first"), "warc-firsts")
    return (narrow.distinct().join(first, "sha").filter(~F.col("first").eqNullSafe(F.col("id")))
            .select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), "first"))


def write_archives(pages: DataFrame, page_id: str, url: str, payload: str, min_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows ``(path, content)``: archives that hold one record for each page.

    A task writes archives of about ``archive_bytes`` and never holds more than
    one; a single record may make an archive larger.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    narrow = materialize(rows.filter(F.octet_length("payload") >= min_bytes).select("id", "sha"), "warc-digests")
    refers = materialize(revisits(narrow), "warc-revisits")
    tagged = rows.join(
        refers, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload",
        F.col("first").cast("string").alias("refers_to"))
    held = train_dictionary(pages, payload)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = zstandard.ZstdCompressionDict(held) if held else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=table)
        head = archive_head(held)

        def row(body: io.BytesIO) -> pa.RecordBatch:
            content = head + body.getvalue()
            name = f"{hashlib.sha1(content).hexdigest()}.warc.zst"
            return pa.RecordBatch.from_pydict({"path": [name], "content": pa.array([content], pa.binary())})

        body = io.BytesIO()
        for batch in batches:
            for r in batch.to_pylist():
                body.write(packer.compress(record(
                    r["id"] if r["id"] is not None else "null", r["url"], r["payload"],
                    r["refers_to"], date)))
                if body.tell() >= archive_bytes:
                    yield row(body)
                    body = io.BytesIO()
        if body.tell():
            yield row(body)

    return tagged.mapInArrow(pack, "path string, content binary")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives given as ``(path, content)``, one row a record."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else
                             pa.binary() if n == "payload" else pa.string()) for n in names])

        def flush(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size, path = [], 0, path.as_py()
                try:
                    for data in frames(content.as_py() or b""):
                        try:
                            row = parse(data)
                        except DamagedArchive as error:
                            row = {"error": str(error)}
                        if not with_payload:
                            row["payload"] = None
                        rows.append({"path": path} | row)
                        size += len(data)
                        if size >= ARCHIVE_BYTES:
                            yield flush(rows)
                            rows, size = [], 0
                except DamagedArchive as error:
                    rows.append({"path": path, "error": str(error)})
                if rows:
                    yield flush(rows)

    return archives.select("path", "content").mapInArrow(unpack, RECORD_SCHEMA)


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files under ``folder``, a URI that all executors reach.

    Each file is written under another name and then moved to its own, so a task
    that runs again leaves one whole file. Returns the paths, once evaluated.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = f"{root}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py())
                store.move(part, f"{root}/{name}")
                paths.append(f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"path": paths})

    return archives.select("path", "content").mapInArrow(put, "path string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record for each page, read the archives back; one row a page."""
    pages = read(spark, sf_dir, "pages")
    archives = materialize(write_archives(pages, "page_id", "url", "html"), "warc")
    records = read_archives(archives, with_payload=False)
    return records.select(
        F.expr("try_cast(record_id AS BIGINT)").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"), "error")
