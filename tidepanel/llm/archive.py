"""WARC archives of report pages with one Zstandard frame per record and an embedded dictionary.

Each task writes its pages to archives of bounded size in a shared folder. An archive starts with
a skippable frame that holds a dictionary built from the archive's own first records; every record
is a frame of its own under that dictionary, so any record can be read alone. Payloads that occur
again are written once: the others become revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, cut_lineage

#: Fixed values of the format: magic of the dictionary's skippable frame, version line, revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Least payload that is worth a revisit record, in bytes.
LEAST_REVISIT = 1000
#: Tasks that read archives, at most; beyond it a task reads several, one after the other.
MOST_READERS = 20_000
#: Uncompressed bytes of an archive; bytes of its first records that its dictionary is built from; the dictionary's size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 1 << 20, 32 << 10


def record_urn(key) -> str:
    return f"<urn:x-report-page:{'' if key is None else quote(str(key), safe='')}>"


def record_key(urn: str) -> str | None:
    return unquote(urn[len("<urn:x-report-page:"):-1]) or None


def warc_record(key, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """One record. A revisit has the HTTP head of the payload as its block, a response head and payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if is_revisit else head + payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_urn(key)), ("WARC-Date", date)]
    if url is not None:
        uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
        fields.append(("WARC-Target-URI", uri))
        if uri != url:  # not a URI as it stands: kept whole in a field of its own
            fields.append(("X-Source-URL", quote(url, safe="")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """Trained dictionary of the records, empty where they are too few or too alike."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, records)) // 4), records).as_bytes() if len(records) >= 8 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes one archive; the first records wait until they make up the dictionary's sample."""

    def __init__(self, stream):
        self.stream, self.waiting, self.held, self.compressor, self.records, self.size = stream, [], 0, None, 0, 0

    def add(self, record: bytes):
        self.records += 1
        self.size += len(record)
        if self.compressor:
            self.stream.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def _begin(self):
        data = _dictionary(self.waiting)
        self.stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        for record in self.waiting:
            self.stream.write(self.compressor.compress(record))
        self.waiting.clear()

    def close(self):
        if not self.compressor:
            self._begin()
        self.stream.close()


def _filesystem(folder: str):
    """The shared folder's file system and the path on it, as tasks see them."""
    uri = folder.replace("s3a://", "s3://", 1)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "external_id", url_col: str = "source_url",
                   html_col: str = "html", least_revisit: int = LEAST_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page to archives under ``folder`` (default: one in the session's shared
    folder) and return their list: ``archive``, ``n_records``, ``n_bytes``.

    Of pages with equal payloads of ``least_revisit`` bytes or more, that with the greatest id is the
    response and the others revisit it; rows that repeat that id with that payload are responses too.
    A null id is smaller than any other; if all are null, all are responses. Null html is an empty
    payload; a null url leaves the target out. Further columns are ignored; an empty table makes no
    archive. A task that runs again writes new files; only those of the list count.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    base = pages.select(pages[id_col].alias("key"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha1("payload"), "check": F.xxhash64("payload"), "size": F.octet_length("payload")})
    again = (base.where(F.col("size") >= least_revisit).groupBy("digest", "check", "size").agg(F.max("key").alias("response"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 and response is not null").drop("n"))
    marked = base.join(again, ["digest", "check", "size"], "left").select(
        "key", "url", "payload", "digest", "response", (F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response"))).alias("revisit"))

    def run(batches):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        done, writer, name = [], None, ""
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(fs.open_output_stream(name))
                key, url, data, digest, response, revisit = row
                writer.add(warc_record(key, url, data, digest, response, revisit, date))
                if writer.size >= ARCHIVE_BYTES:
                    writer.close()
                    done.append((name, writer.records, writer.size))
                    writer = None
        if writer:
            writer.close()
            done.append((name, writer.records, writer.size))
        if done:
            names, records, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array([folder + n[len(root):] for n in names]), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
                                             ["archive", "n_records", "n_bytes"])

    return cut_lineage(marked.mapInArrow(run, "archive string, n_records long, n_bytes long"))


def _exactly(stream, n: int) -> bytes:
    out = b""
    while len(out) < n:
        part = stream.read(n - len(out))
        if not part:
            raise ValueError("archive ends inside a record")
        out += part
    return out


def archive_records(stream):
    """(fields, block) of every record of an archive, one after the other."""
    magic, n = struct.unpack("<II", _exactly(stream, 8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("archive without dictionary frame")
    data = _exactly(stream, n) if n else b""
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None).stream_reader(stream, read_across_frames=True)
    held = b""
    while True:
        while b"\r\n\r\n" not in held:
            part = plain.read(1 << 16)
            if not part:
                if held:
                    raise ValueError("archive ends inside a header")
                return
            held += part
        head, _, held = held.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        if version.encode() != VERSION:
            raise ValueError("not a record")
        if len(held) < size + 4:
            held += _exactly(plain, size + 4 - len(held))
        block, held = held[:size], held[size + 4:]
        yield fields, block


def read_archives(archives: DataFrame, id_type: T.DataType, *, payloads: bool = True) -> DataFrame:
    """Read listed archives back: ``external_id`` (as ``id_type``), ``source_url``, ``record_type``, ``payload_bytes``,
    ``payload_digest`` (lower-case hex SHA-1 of the full payload), ``refers_to`` and, with ``payloads``, ``payload``
    (null for a revisit). The digest of every response is worked out from what was read. The archives are counted
    and spread over as many tasks, at most ``MOST_READERS``."""
    schema = "id string, source_url string, record_type string, payload_bytes long, payload_digest string, refers string, payload binary"
    names = ["id", "source_url", "record_type", "payload_bytes", "payload_digest", "refers", "payload"]

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = _filesystem(archive)
                rows, held = [], 0
                with fs.open_input_stream(path) as stream:
                    for fields, block in archive_records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
                        kind = fields["WARC-Type"]
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        url = unquote(fields["X-Source-URL"]) if "X-Source-URL" in fields else fields.get("WARC-Target-URI")
                        refers = fields.get("WARC-Refers-To")
                        rows.append((record_key(fields["WARC-Record-ID"]), url, kind, size, digest, refers and record_key(refers),
                                     payload if payloads and kind == "response" else None))
                        held += len(payload) if payloads else 0
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=ARROW)

    names_only = archives.select("archive")
    # With a stated number adaptive execution leaves the partitions of this short list as they are.
    spread = names_only.repartitionByRange(min(max(names_only.count(), 1), MOST_READERS), "archive")
    out = spread.mapInArrow(run, schema).withColumns({"external_id": F.col("id").cast(id_type), "refers_to": F.col("refers").cast(id_type)})
    return out.select("external_id", "source_url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else []))


ARROW = pa.schema([("id", pa.string()), ("source_url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("refers", pa.string()), ("payload", pa.binary())])
