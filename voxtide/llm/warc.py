"""WARC archives written from, and read back as, a chunked record table.

A record travels as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, never as a whole. The
writer streams the chunks of a record into a gzip member of an archive while a SHA-256 runs along and is held
against the declared digest; the reader inflates an archive block by block and yields chunk rows that
carry the digest and the length of the payload up to and with the chunk.

Scale: payloads are not shuffled; only (page_id, digest) is, to find equal payloads. Each task writes archives
of its own in the shared folder under a name of its own attempt and renames them when complete; the manifest
lists those of committed tasks alone, so a lost executor or a second attempt leaves no record twice. Archives
are reached through ``pyarrow.fs`` by the folder's URI (a mounted path, or a store that it knows).

Defined cases: a null payload is empty; a null url is written as ``urn:page:<id>``; a null id is kept as
such and never revisits; rows repeating an id and a payload are each written, with the same decision; an
empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import gives_back, shared_dir, stored, unhex_sha256

CHUNK = 1 << 18
#: Payloads from this size on are written once and revisited.
REVISIT_BYTES = 100
#: An archive is closed when it has passed this size.
ARCHIVE_BYTES = 1 << 28
DATE = "2024-01-01T00:00:00Z"
BLOCK = 1 << 18


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """page_id, url, payload_bytes, digest, refers_to, chunk_no, last, data: the chunks of a record in order, in one task.

    Of equal payloads of at least ``REVISIT_BYTES``, all but those with the least id revisit it, without data.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("payload_bytes", F.octet_length("body").cast("long")).withColumn("digest", unhex_sha256(F.col("body")))
    prints = stored(rows.select("page_id", "payload_bytes", "digest").where(F.col("payload_bytes") >= REVISIT_BYTES), "payloads")
    owners = prints.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    again = prints.join(owners, "digest").where("page_id != owner").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "owner").distinct()
    again = stored(again, "revisits")
    rows = rows.join(again, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    kept = F.when(F.col("owner").isNull(), F.col("payload_bytes")).otherwise(0)
    parts = F.greatest(F.lit(1), F.ceil(kept / chunk)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    data = F.when(F.col("owner").isNull(), F.substring(F.col("body").cast("binary"), F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "payload_bytes", "digest", F.col("owner").alias("refers_to"), "chunk_no", (F.col("chunk_no") == F.col("parts") - 1).alias("last"), data.alias("data"))


def _head(page: int | None, url: str | None, size: int, digest: str, refers: int | None, date: str) -> bytes:
    """The WARC header of a record, and of a response also the HTTP header that its block begins with."""
    name = "none" if page is None else str(page)
    target = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url) if url else f"urn:page:{name}"
    http = b"" if refers is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers is None:
        lines += ["Content-Type: application/http; msgtype=response"]
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Payload-Length: {size}"]
    return "\r\n".join([*lines, f"Content-Length: {len(http) + (size if refers is None else 0)}"]).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str | None = None, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a chunk table as gzip WARC archives; return the manifest (archive, records), already written."""
    folder = folder or f"{shared_dir(chunks.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = pack = digest = None
        path, records, written = "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            store.move(f"{path}.part", path)
            return pa.RecordBatch.from_pydict({"archive": pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), "records": pa.array([records], pa.int64())})

        for batch in batches:
            for page, url, size, declared, refers, number, last, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, records, written = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}.part", compression=None)
                if number == 0:
                    pack, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                    written += out.write(pack.compress(_head(page, url, size, declared.hex(), refers, date)))
                digest.update(data)
                written += out.write(pack.compress(data))
                if last:
                    if refers is None and digest.digest() != declared:
                        raise ValueError(f"the chunks of record {page} don't have the declared digest")
                    written += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    records += 1
                    if written >= archive_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return stored(chunks.mapInArrow(gives_back(run), "archive string, records long"), "manifest")


class Inflated:
    """Bytes of a gzip (many members) or plain stream, held a few blocks at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.held, self.raw, self.inflate, self.plain = stream, bytearray(), b"", None, None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(BLOCK)
            if not self.raw:
                return False
        if self.plain is None:
            self.plain = not self.raw.startswith(b"\x1f\x8b")
        if self.plain:
            self.held += self.raw
            self.raw = b""
            return True
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        self.held += self.inflate.decompress(self.raw, BLOCK)
        self.raw = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """All bytes up to and with ``mark``; None at the end of the stream."""
        at = 0
        while (found := self.held.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.held)
            if not self._more():
                return None
        return self.some(found + len(mark))

    def some(self, most: int) -> bytes:
        """From one to ``most`` bytes; none at the end of the stream."""
        while not self.held and self._more():
            pass
        out = bytes(self.held[:most])
        del self.held[:most]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        return self.some(n) if n else b""


def records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, int, str, bool]]:
    """(headers, chunk_no, data, bytes so far, SHA-256 so far, last) of every chunk of every record's payload."""
    source = Inflated(stream)
    while (raw := source.until(b"\r\n\r\n")) is not None:
        lines = raw.decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http") and left:
            left -= len(source.until(b"\r\n\r\n"))
        number, done, digest = 0, 0, hashlib.sha256()
        while True:
            data = source.exactly(min(left, chunk))
            if not data and left:
                raise ValueError("the archive ends within a record")
            left -= len(data)
            done += len(data)
            digest.update(data)
            yield head, number, data, done, digest.hexdigest(), left == 0
            number += 1
            if not left:
                break
        source.exactly(4)


def read_archives(manifest: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the manifest's archives: record_id, page_id, record_type, url, declared_digest, declared_bytes,
    refers_to, chunk_no, bytes_so_far, sha256_so_far, last [, data]."""
    schema = "record_id string, page_id long, record_type string, url string, declared_digest string, declared_bytes long, refers_to long, chunk_no long, bytes_so_far long, sha256_so_far string, last boolean"
    names = [x.split()[0] for x in schema.split(", ")] + ["data"] * with_data
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")] + [pa.binary()] * with_data

    def page(urn: str | None) -> int | None:
        number = (urn or "").strip("<>").removeprefix("urn:page:")
        return int(number) if number.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for head, number, data, done, digest, last in records(stream, chunk):
                        length = head.get("warc-payload-length")
                        rows.append((head.get("warc-record-id", "").strip("<>"), page(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-payload-digest", "").rpartition(":")[2] or None, int(length) if length else None, page(head.get("warc-refers-to")), number, done, digest, last, data)[: len(names)])
                        held += len(data)
                        if len(rows) >= 2000 or held >= 16 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    archives = manifest.select("archive")  # dealt by range: hashed names would meet in tasks
    return archives.repartitionByRange(max(1, archives.count()), "archive").mapInArrow(gives_back(run), schema + ", data binary" * with_data)


def summaries(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table as read: what its last chunk carries (a revisit: what it declares)."""
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        "page_id", F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("sha256_so_far")).alias("payload_digest"), "record_type", F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )
