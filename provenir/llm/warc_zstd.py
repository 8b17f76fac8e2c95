"""WARC archives with a Zstandard dictionary: written, and read back.

Each task writes archives of its own rows. Of an archive's first records, up to SAMPLE bytes of them, a dictionary is trained; it stands
in a skippable frame at the head of the file, and every record follows as a frame of its own, compressed with it, so that
a reader can begin at any record. Dictionaries only bear on size. An archive whose records are too few to train on has no dictionary.

Payloads are compared over all rows by SHA-1, length and a second hash; of equal ones the row with the least id is written as a response and the
others as revisits, which keep the HTTP head with the payload's length and digest, but not the payload. The least id is aggregated before it is
shuffled and joined back, and adaptive execution splits that join for a payload that very many rows share.

Files get names that no other attempt uses; the manifest, a table that Spark commits, names those of the attempts that
count. Files of lost or repeated attempts are never read. The folder is opened by pyarrow's file systems (file, hdfs, s3, gs).

Defined results: null html is an empty payload; a null url has no target header, and bytes outside visible ASCII are percent-encoded in it;
an id that repeats with the same payload is a response each time, if it is the least, so that ids need not be unique; a row with a null id
revisits the least id, if there is one, and else is a response; an empty table gives no archive; other columns are ignored.
A record is held in memory, never an archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import Scratch, table

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VISIBLE = "".join(map(chr, range(0x21, 0x7F)))

SAMPLE, DICTIONARY, LEAST_SAMPLES, ARCHIVE, LEVEL, CHUNK = 2_000_000, 64_000, 16, 1_000_000_000, 3, 1 << 20
BATCH = 4_000_000


def resolve_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """id, url, payload, sha1 (hex), refers_to: of rows with equal payloads of at least so many bytes, the least id where it is another's; null
    for a response; revisit: whether the row is one."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").alias("id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload"), "other": F.xxhash64("payload")})
    keys = ["sha1", "size", "other"]
    first = rows.where(F.col("size") >= least).groupBy(*keys).agg(F.min("id").alias("first"))
    found = rows.join(first, keys, "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return found.select("id", "url", "payload", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def _name(id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{id} {digest}'.encode()).digest(), version=4)}>"


def record(id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _name(id, digest), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe=VISIBLE)
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if revisit:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": _name(refers_to, digest), "X-Refers-To-Id": str(refers_to)}
    if id is not None:
        head["X-Id"] = str(id)
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(records) < LEAST_SAMPLES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, records, k=512, d=8)
    except zstandard.ZstdError:  # too little that repeats
        return None


class Archive:
    """One file: records are held until there is a dictionary, and then written one by one."""

    def __init__(self, out):
        self.out, self.held, self.size, self.records, self.raw, self.trained = out, [], 0, 0, 0, 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        found = dictionary(self.held)
        if found is not None:
            data = found.as_bytes()
            self._put(struct.pack("<II", SKIPPABLE, len(data)) + data)
            self.trained = len(data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_content_size=True, write_checksum=True)
        for r in self.held:
            self._put(self.compressor.compress(r))
        self.held = []

    def add(self, data: bytes) -> None:
        self.records += 1
        self.raw += len(data)
        if self.compressor:
            self._put(self.compressor.compress(data))
            return
        self.held.append(data)
        if self.raw >= SAMPLE:
            self._begin()

    def close(self) -> None:
        if not self.compressor:
            self._begin()
        self.out.close()


def frames(source) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    head, found = source.read(8), None
    if len(head) == 8 and (parts := struct.unpack("<II", head))[0] == SKIPPABLE:
        found, head = zstandard.ZstdCompressionDict(source.read(parts[1]), dict_type=zstandard.DICT_TYPE_FULLDICT), b""
    reader, data = zstandard.ZstdDecompressor(dict_data=found), head
    while data := data or source.read(CHUNK):
        one, pieces = reader.decompressobj(), []
        while True:
            pieces.append(one.decompress(data))
            if one.eof:
                break
            if not (data := source.read(CHUNK)):
                raise ValueError("the archive ends within a record")
        data = one.unused_data
        yield b"".join(pieces)


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines)}


def parse(data: bytes) -> dict:
    """A record's fields; its digest and lengths are held against the payload, if it has one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = _headers(lines)
    block = rest[: int(fields["content-length"])]
    if version != VERSION or len(rest) != len(block) + 4:
        raise ValueError("not a record of this version and length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_headers(http.split(b"\r\n")[1:])["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} isn't what was written")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "id": number("x-id"), "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "date": fields["warc-date"], "url": fields.get("warc-target-uri"),
        "payload_digest": digest, "payload_bytes": size, "refers_to": number("x-refers-to-id"), "payload": None if revisit else payload,
    }


MANIFEST = "path string, records long, raw_bytes long, bytes long, dictionary_bytes long"
RECORDS = {"id": pa.int64(), "record_id": pa.string(), "record_type": pa.string(), "date": pa.string(), "url": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
RECORDS_DDL = "id long, record_id string, record_type string, date string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def write_archives(rows: DataFrame, folder: str, scratch: Scratch, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes rows, as resolve_revisits gives them, below folder. The manifest: a row for each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        now, path, done = None, "", []

        def close() -> None:
            now.close()
            done.append({"path": path, "records": now.records, "raw_bytes": now.raw, "bytes": now.size, "dictionary_bytes": now.trained})

        for batch in batches:
            for values in zip(*(c for c in batch.columns)):
                if now is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    path, now = f"{folder}/{name}", Archive(fs.open_output_stream(f"{root}/{name}"))
                now.add(record(*(v.as_py() for v in values), date))
                if now.raw >= ARCHIVE:
                    close()
                    now = None
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return scratch.write(rows.select("id", "url", "payload", "sha1", "refers_to", "revisit").mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives. An archive is read by one task, record by record; without payloads they
    are still decompressed and compared with their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(RECORDS)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                out, size = [], 0
                with fs.open_input_stream(name) as source:
                    for data in frames(source):
                        one = parse(data)
                        if not payloads:
                            one["payload"] = None
                        size += 300 + len(one["payload"] or b"")
                        out.append(one)
                        if size >= BATCH:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    # As many tasks as archives: the manifest is small, and adaptive execution would read all of them in one.
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, RECORDS_DDL)


def op11_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, once they are written."""
    scratch = Scratch(spark)
    manifest = write_archives(resolve_revisits(table(spark, sf_dir, "pages")), f"{scratch.root}/archives", scratch)
    return read_archives(manifest, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op11_dictionary_warc": op11_dictionary_warc}
ORACLE = {
    "op11_dictionary_warc": """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by html) as first from p)
select page_id, strlen(html)::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((strpos('0123456789abcdef', substr(h, 1 + i * 5 // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 + i * 5 // 4, 1)) - 1) >> (3 - i * 5 % 4)) & 31), 1)), 'string_agg', '') as payload_digest,
  case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from f
"""
}
