"""WARC archives of pages: payloads kept once, records compressed one by one with a dictionary of their own archive.

Equal payloads are found by a grouped minimum over (digest, page_id); pages themselves
aren't shuffled unless more payloads repeat than may be broadcast, and then without the
payloads of the most frequent ones. Each task writes the pages that it reads: the first
records of an archive train a Zstandard dictionary, which stands in a skippable frame
at the head of the file, and every record is a frame of its own after it, so a reader can begin at
any record. A task keeps that sample and one record in memory, whatever the archive's size.

Files go to the shared folder under a name of the task's attempt, and only those that
the table of archives names count; so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import words as W

LEAST_PAYLOAD = 100  # bytes; smaller ones are stored each time
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 256 << 20, 2 << 20, 64 << 10
BROADCAST_ROWS, HOT = 100_000, 1024  # repeated payloads that are broadcast at most; a payload of over 1 / HOT of all rows is hot
READ_BYTES = 1 << 18
LEVEL = 6
# Fixed values of the formats: the frame that holds a dictionary, and the profile of a revisit.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLLECTION = 0x6C756D656E72  # names this writer in record ids
ARCHIVES = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def record_id(page_id: int | None) -> str:
    """A UUID of version 8 that holds the page's id, so a reader needs no lookup."""
    bits = (page_id or 0) & 2**64 - 1
    high = (4 if page_id is None else 0) | bits >> 62
    return f"<urn:uuid:{uuid.UUID(int=COLLECTION << 80 | 8 << 76 | high << 64 | 2 << 62 | bits & 2**62 - 1)}>"


def page_id_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    bits = (value >> 64 & 3) << 62 | value & 2**62 - 1
    return None if value >> 64 & 4 else bits - 2**64 if bits >= 2**63 else bits


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or, with ``refers_to``, a revisit without one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-cased name, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on records; of too few or too short ones, their own last bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8, f=18, split_point=1.0, accel=2, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


class _Archive:
    """A file that is being written: its first records wait until they are enough to train a dictionary."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.path, self.n_records, self.raw, self.size = path, 0, 0, 0
        self._out = store.open_output_stream(path, compression=None)  # the frames are our own
        self._waiting: list[bytes] = []
        self._packer: zstandard.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        self.n_records += 1
        self.raw += len(data)
        if self._packer is not None:
            self._put(self._packer.compress(data))
            return
        self._waiting.append(data)
        if self.raw >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        held = dictionary(self._waiting)
        packed = zstandard.ZstdCompressor(LEVEL).compress(held)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        words = zstandard.ZstdCompressionDict(held)
        words.precompute_compress(LEVEL)
        self._packer = zstandard.ZstdCompressor(dict_data=words)
        for data in self._waiting:
            self._put(self._packer.compress(data))
        self._waiting = []

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        if self._packer is None:
            self._begin()
        self._out.close()
        return self.path, self.n_records, self.size


def frames(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an archive, from its bytes in pieces of any size."""
    held = b""

    def need(n: int) -> None:
        nonlocal held
        while len(held) < n:
            more = next(chunks, b"")
            if not more:
                raise ValueError("the archive ends within a frame")
            held += more

    need(8)
    magic, size = struct.unpack("<II", held[:8])
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary")
    need(8 + size)
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held[8 : 8 + size]))
    held = held[8 + size :]
    opener = zstandard.ZstdDecompressor(dict_data=words)
    while held or (held := next(chunks, b"")):
        frame, out = opener.decompressobj(), []
        while True:
            out.append(frame.decompress(held))
            if frame.eof:
                break
            held = next(chunks, b"")
            if not held:
                raise ValueError("the archive ends within a frame")
        held = frame.unused_data
        yield b"".join(out)


def marked(pages: DataFrame, least: int = LEAST_PAYLOAD, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to): payload is null where the page revisits ``refers_to``."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.cast("binary").alias("payload"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("digest"),
    )
    counted = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = B.written(counted.filter("n > 1 and first is not null"))
    names, refers = rows.columns, F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))

    def joined(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
        right = right.select(F.col("digest").alias("_digest"), "first")
        return left.join(right, key == F.col("_digest"), "left").withColumn("refers_to", refers).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).drop("_digest")

    if firsts.count() <= broadcast_rows:
        return joined(rows, F.broadcast(firsts), F.col("digest")).select(*names, "refers_to")
    hot = F.col("n") * HOT > rows.count()  # so there are fewer than HOT of them
    known = joined(rows, F.broadcast(firsts.filter(hot)), F.col("digest")).withColumnsRenamed({"first": "_hot", "refers_to": "_refers"})
    open_ = F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id"), F.lit(0)).cast("string")))  # settled rows meet nothing
    out = joined(known, firsts.filter(~hot), open_)
    return out.select(*names, F.coalesce("_refers", "refers_to").alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of ``marked`` as archives below ``folder``; returns the table of them (ARCHIVES), already written itself."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        done: list[tuple[str, int, int]] = []
        archive = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")), strict=True):
                if archive is None:
                    archive = _Archive(store, f"{top}/{task.partitionId():06d}-{task.taskAttemptId():08d}-{len(done):04d}.warc.zst")
                archive.add(record(*row, date))
                if archive.raw >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    return B.written(W.small_batches(rows).mapInArrow(run, ARCHIVES))


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) of archives (path); responses are measured anew and must have the digest that they name.

    payload is null for revisits, and for all where ``payloads`` is false.
    """

    def row(data: bytes, path: str) -> tuple:
        fields, block = parsed(data)
        page = page_id_of(fields["warc-record-id"])
        http, _, body = block.partition(b"\r\n\r\n")
        told = fields["warc-payload-digest"].removeprefix("sha256:")
        size = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
        if fields["warc-type"] == "revisit":
            return page, fields.get("warc-target-uri"), "revisit", page_id_of(fields["warc-refers-to"]), None, size, told
        measured = hashlib.sha256(body).hexdigest()
        if (measured, len(body)) != (told, size):
            raise ValueError(f"{path}: the payload of {fields['warc-record-id']} isn't the one that its digest names")
        return page, fields.get("warc-target-uri"), "response", None, body if payloads else None, len(body), measured

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as file:
                    for data in frames(iter(lambda f=file: f.read(READ_BYTES), b"")):
                        held.append(row(data, path))
                        size += 200 + len(held[-1][4] or b"")
                        if size >= W.BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, RECORDS)


def archived(pages: DataFrame, folder: str | None = None, payloads: bool = False, broadcast_rows: int = BROADCAST_ROWS, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each page and reads them back (RECORDS): page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    Of records with equal payloads of ``LEAST_PAYLOAD`` bytes or more the one of the smallest page_id
    is the response and others revisit it; smaller payloads are all responses. Digests are
    sha256 of the whole payload, which is the html in UTF-8.

    A null html is an empty payload. A null page_id is never referred to, so pages of such
    ids alone are all responses. Rows that repeat that smallest page_id with the same payload are all
    responses, and such rows share a record id. A null url gives a record without one; in others what isn't
    allowed in a URI is percent-encoded. Other columns are not read. An empty table gives no archive and no row.
    """
    folder = folder or B.shared_folder(pages.sparkSession)
    archives = write_archives(marked(pages, broadcast_rows=broadcast_rows), folder, archive_bytes=archive_bytes)
    return read_archives(archives, folder, payloads)
