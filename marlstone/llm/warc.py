"""WARC: bring monolithic gzip files into the form that allows random access.

A .warc.gz that was compressed as one stream can be read only from its start. The normaliser
inflates such a file once, as a stream, writes every record as a gzip member of its own, and
beside the file an index of each record's offset and length. Files are units of work: each is
handled by one task, memory holds one record, compressed, and results appear by a rename. A finished
file is left as it is by a task that runs again, or twice. Results are named by the base name of the input and a
hash of its whole path, so inputs of one name in several folders don't meet.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import scratch

CHUNK = 1 << 18
#: The start of a record: the version and the name of its first header.
START = re.compile(rb"WARC/\d{1,9}\.\d{1,9}\r\n[A-Za-z-]{1,99}:")
INDEX_SCHEMA = "file string, record_no long, page_id long, url string, offset long, length long, payload_bytes long, payload_sha1 string, status string"


def _member() -> "zlib._Compress":
    return zlib.compressobj(6, zlib.DEFLATED, 31)


def output_name(path: str) -> str:
    """The name of the normalised form of a file: its base name with a hash of its whole path."""
    base = path.rpartition("/")[2]
    stem, dot, rest = base.partition(".")
    return f"{stem}-{hashlib.sha1(path.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}{dot}{rest}"


def _finish(files: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a written file its name, unless another run of the task has done so: some file systems don't rename onto a file."""
    if files.get_file_info(final).type == pafs.FileType.File:
        files.delete_file(temporary)
        return
    try:
        files.move(temporary, final)
    except OSError:
        if files.get_file_info(final).type != pafs.FileType.File:
            raise
        files.delete_file(temporary)


def warc_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC/1.0 response-like resource record. Null fields leave out their header; null html is an empty payload."""
    payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{hashlib.sha1(payload).hexdigest()}")
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write each partition of pages (page_id, url, html) as one gzip stream of WARC records: (path)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        final = f"{root}/part-{task.partitionId():06d}.warc.gz"
        part = f"{final}.{task.taskAttemptId()}.tmp"
        squeeze, any_row = _member(), False
        with files.open_output_stream(part) as out:
            for batch in batches:
                for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                    any_row = True
                    out.write(squeeze.compress(warc_record(None if pd.isna(page_id) else int(page_id), url, html)))
            out.write(squeeze.flush())
        if any_row:
            _finish(files, part, final)
            yield pd.DataFrame({"path": [f"{folder}/{final.rpartition('/')[2]}"]})
        else:
            files.delete_file(part)

    return pages.select("page_id", "url", "html").mapInPandas(write, "path string")


class _Inflated:
    """The inflated bytes of a gzip file, however many members it has; `cut` if it ends within one."""

    def __init__(self, stream) -> None:
        self.stream, self.rest, self.buffer, self.cut, self.ended = stream, b"", bytearray(), False, False
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while not self.ended:
            data = self.rest or self.stream.read(CHUNK)
            self.rest = b""
            if not data:
                self.ended = True
                self.cut = self.started and not self.inflate.eof
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            try:
                out = self.inflate.decompress(data, CHUNK)
            except zlib.error:
                self.ended = self.cut = True
                return False
            self.rest = self.inflate.unconsumed_tail or self.inflate.unused_data
            self.started = True
            if out:
                self.buffer += out
                return True
        return False

    started = False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with the mark, however many; None if the stream ends before it."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def begins(self, mark: bytes) -> bool:
        """Whether what is left starts with the mark, or is a part of it at the stream's end."""
        while len(self.buffer) < len(mark) and self._more():
            pass
        return mark.startswith(bytes(self.buffer[: len(mark)]))

    def skip(self, most: int = 256) -> bool:
        """Drop at least one byte and all up to the next start of a record; whether there is one. A start has at most `most` bytes."""
        del self.buffer[:1]
        while not (found := START.search(self.buffer)):
            del self.buffer[: max(0, len(self.buffer) - most)]
            if not self._more():
                self.buffer.clear()
                return False
        del self.buffer[: found.start()]
        return True

    def take(self, n: int) -> Iterator[bytes]:
        """Up to n bytes, in chunks; fewer if the stream ends."""
        while n:
            if not self.buffer and not self._more():
                return
            out = bytes(self.buffer[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            yield out


def normalise_file(source, target, name: str) -> Iterator[dict]:
    """Rewrite one file; yields index rows. source and target are binary streams.

    What is no WARC record, or has no trailer where its length says, gives a row with status `malformed` and length 0,
    and reading goes on at the next start of a record after the bad one's. A stream that ends within a record has
    a row `truncated`. The member of such a record is not written. Headers may have any size.
    """
    stream, offset, number = _Inflated(source), 0, 0

    def row(**x) -> dict:
        return {"file": name, "record_no": number, "page_id": None, "url": None, "offset": offset, "length": 0, "payload_bytes": 0, "payload_sha1": None, "status": "ok"} | x

    while True:
        if not stream.begins(b"WARC/"):
            yield row(status="malformed")
            number += 1
            if not stream.skip():
                return
            continue
        head = stream.until(b"\r\n\r\n")
        if head is None:
            if stream.buffer or stream.cut:
                yield row(status="truncated")
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()) or START.search(head, 1):
            yield row(status="malformed")
            number += 1
            stream.buffer[:0] = head
            if not stream.skip():
                return
            continue
        size, got, sha, squeeze, parts = int(length), 0, hashlib.sha1(), _member(), []
        parts.append(squeeze.compress(head))
        for piece in stream.take(size):
            got += len(piece)
            sha.update(piece)
            parts.append(squeeze.compress(piece))
        end = b"".join(stream.take(4))
        if got < size or end != b"\r\n\r\n":
            stream.buffer[:0] = zlib.decompressobj(31).decompress(b"".join(parts) + squeeze.flush(zlib.Z_SYNC_FLUSH)) + end
            more = stream.skip()  # a length that is too large has taken in what follows
            yield row(status="malformed" if more or got == size and len(end) == 4 else "truncated")
            number += 1
            if not more:
                return
            continue
        parts.append(squeeze.compress(end) + squeeze.flush())
        length = 0
        for piece in parts:
            target.write(piece)
            length += len(piece)
        page = fields.get("x-page-id", "")
        yield row(page_id=int(page) if page.lstrip("-").isdigit() else None, url=fields.get("warc-target-uri"), length=length, payload_bytes=size, payload_sha1=base64.b32encode(sha.digest()).decode())
        offset += length
        number += 1


def normalise(paths: DataFrame, folder: str) -> DataFrame:
    """Normalise the files of paths (path) into folder; the index of all records.

    Each result is named by output_name(), and beside it a sidecar `<file>.idx` has one JSON line per record. A file that holds no
    record gives an empty file and sidecar. Null paths are skipped; a path listed twice gives its rows twice and one file.
    See normalise_file for broken input.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        out_fs, root = pafs.FileSystem.from_uri(folder)
        out_fs.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch["path"].dropna():
                in_fs, at = pafs.FileSystem.from_uri(path)
                name = output_name(path)
                temporary = [f"{root}/{name}.{attempt}.tmp", f"{root}/{name}.idx.{attempt}.tmp"]
                with in_fs.open_input_stream(at, compression=None) as source, out_fs.open_output_stream(temporary[0], compression=None) as target, out_fs.open_output_stream(temporary[1], compression=None) as index:
                    rows: list[dict] = []
                    for found in normalise_file(source, target, name):
                        index.write(json.dumps(found).encode() + b"\n")
                        rows.append(found)
                        if len(rows) >= 4096:
                            yield pd.DataFrame(rows).astype({"page_id": "Int64"})
                            rows = []
                _finish(out_fs, temporary[0], f"{root}/{name}")
                _finish(out_fs, temporary[1], f"{root}/{name}.idx")
                if rows:
                    yield pd.DataFrame(rows).astype({"page_id": "Int64"})

    return paths.select("path").mapInPandas(work, INDEX_SCHEMA)


def read_record(folder: str, file: str, offset: int, length: int) -> tuple[dict, bytes]:
    """One record by its index entry: headers and payload."""
    files, root = pafs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{root}/{file}") as f:
        f.seek(offset)
        raw = zlib.decompress(f.read(length), 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def normalise_pages(pages: DataFrame) -> DataFrame:
    """Write pages as monolithic files in the shared folder and normalise those: the index rows.

    Null html is an empty payload; null page_id or url leave their column null. Repeated
    pages are records of their own; other columns of pages are ignored.
    """
    folder = scratch(pages.sparkSession, "warc")
    return normalise(write_monolithic(pages, f"{folder}/raw"), f"{folder}/records").withColumn("page_id", F.col("page_id").cast("long"))
