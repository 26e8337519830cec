"""WARC archives: a writer with one gzip member a record, and a reader that salvages damaged archives.

The reader checks every record: the member inflates to its end with the right checksum, version line and headers
parse, the block has its stated length and ends properly, a stated block digest (SHA-1, SHA-2 or MD5, in hex or base
32) holds. After a failed check it looks for the next gzip member (or, in plain archives, the next version line) that
passes all checks, goes on from there, and logs the bytes between as a gap with the first check that failed. A member
that holds several records gives them all, or none if one of them fails.

Archives are written and read by the tasks through ``pyarrow.fs``, record by record, in the folder given, which all
executors must share. A writing task begins a new archive every ``ROLL_BYTES``, so archives stay small however much a
task has to write, and reading deals them out one to a task. A file gets a name of its own and counts only when the
task's rows have come back, so a repeated or lost task leaves no half archive in the list.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.llm import text

ROLL_BYTES = 64 << 20
_BLOCK = 1 << 18
_DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
_GZIP, _VERSION = b"\x1f\x8b\x08", re.compile(rb"(?:^|(?<=\n))WARC/\d+\.\d+\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = "path string, start long, stop long, headers map<string,string>, block binary, gap string"


class Bad(Exception):
    """A check that failed."""


# --- records ------------------------------------------------------------------------------------------

def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers.items()]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def _headers(head: bytes) -> dict[str, str]:
    first, *lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", first):
        raise Bad("version line")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Bad("header line")
        try:
            out[name.strip().decode()] = value.strip().decode()
        except UnicodeDecodeError:
            raise Bad("header encoding") from None
    return out


def _length(headers: dict[str, str]) -> int:
    value = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
    if not re.fullmatch(r"\d{1,18}", value):
        raise Bad("content length")
    return int(value)


def _digest(headers: dict[str, str], block: bytes) -> None:
    stated = next((v for k, v in headers.items() if k.lower() == "warc-block-digest"), "")
    kind, _, value = stated.partition(":")
    kind, value = kind.lower().replace("-", ""), value.strip().rstrip("=").lower()
    if kind in _DIGESTS:
        own = hashlib.new(kind, block).digest()
        if value not in (own.hex(), base64.b32encode(own).decode().rstrip("=").lower()):
            raise Bad("block digest")


def _records(whole: bytes) -> list[tuple[dict[str, str], bytes]]:
    """All records of an inflated member, one after the other up to its end."""
    out, at = [], 0
    while at < len(whole) or not out:
        stop = whole.find(b"\r\n\r\n", at)
        if stop < 0:
            raise Bad("header end")
        headers = _headers(whole[at:stop])
        first, n = stop + 4, _length(headers)
        if whole[first + n:first + n + 4] != b"\r\n\r\n":
            raise Bad("block length")
        block = whole[first:first + n]
        _digest(headers, block)
        out.append((headers, block))
        at = first + n + 4
    return out


class Archive:
    """Reads at offsets, a block at a time."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size = file, size

    def read(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        out = b""
        while len(out) < n and (more := self.file.read(n - len(out))):
            out += more
        return out

    def zipped(self, name: str) -> bool:
        return self.read(0, 3) == _GZIP or (name.endswith(".gz") and not self.read(0, 5) == b"WARC/")

    def records(self, start: int, zipped: bool) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
        """Where the record or member at ``start`` stops, and ``(headers, block)`` of what it holds; Bad if any check fails."""
        return self._zipped(start) if zipped else self._plain(start)

    def _zipped(self, start: int) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
        if self.read(start, 3) != _GZIP:
            raise Bad("member header")
        expand, parts, at = zlib.decompressobj(31), [], start
        try:
            while not expand.eof:
                more = self.read(at, _BLOCK)
                if not more:
                    raise Bad("member cut short")
                parts.append(expand.decompress(more))
                at += len(more)
                if len(parts) == 1 and not parts[0].startswith(b"WARC/") and len(parts[0]) >= 5:
                    raise Bad("version line")
        except zlib.error:
            raise Bad("member data") from None
        return at - len(expand.unused_data), _records(b"".join(parts))

    def _plain(self, start: int) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
        if self.read(start, 5) != b"WARC/":
            raise Bad("version line")
        head, at, line = bytearray(), start, 0
        while (stop := head.find(b"\r\n\r\n", max(0, line - 4))) < 0:
            # headers may be of any length, but the first line that is none ends the search for their end
            while (end := head.find(b"\r\n", line)) >= 0:
                if line and head.find(b":", line, end) < 0:
                    raise Bad("header line")
                line = end + 2
            more = self.read(at, 4096 if at == start else _BLOCK)
            if not more:
                raise Bad("header end")
            head, at = head + more, at + len(more)
        headers = _headers(bytes(head[:stop]))
        n, first = _length(headers), start + stop + 4
        if first + n + 4 > self.size:
            raise Bad("record cut short")
        block = self.read(first, n)
        if self.read(first + n, 4) != b"\r\n\r\n":
            raise Bad("block length")
        _digest(headers, block)
        return first + n + 4, [(headers, block)]

    def candidates(self, start: int, zipped: bool) -> Iterator[int]:
        """Offsets from ``start`` on where a record may begin."""
        keep, at = 32, start
        last = -1
        while at < self.size:
            low = max(0, at - keep)
            piece = self.read(low, at - low + _BLOCK)
            if zipped:
                place = piece.find(_GZIP)
                while place >= 0:
                    if low + place >= start and low + place > last:
                        last = low + place
                        yield last
                    place = piece.find(_GZIP, place + 1)
            else:
                for match in _VERSION.finditer(piece):
                    # "^" holds at the piece's own start only where that is the archive's start
                    if low + match.start() >= start and low + match.start() > last and (match.start() or not low):
                        last = low + match.start()
                        yield last
            at += _BLOCK


def salvage(archive: Archive, name: str) -> Iterator[tuple]:
    """``(start, stop, headers, block, None)`` for every record that passes all checks and ``(start, stop, None, None,
    reason)`` for every gap, in order and without overlap. Records of one member share its start and stop."""
    zipped, at = archive.zipped(name), 0
    while at < archive.size:
        try:
            stop, found = archive.records(at, zipped)
        except Bad as bad:
            reason, resumed = str(bad), None
            for place in archive.candidates(at + 1, zipped):
                try:
                    stop, found = archive.records(place, zipped)
                except Bad:
                    continue
                resumed = place
                break
            yield at, archive.size if resumed is None else resumed, None, None, reason
            if resumed is None:
                return
            at = resumed
        for headers, block in found:
            yield at, stop, headers, block, None
        at = stop


# --- over DataFrames ------------------------------------------------------------------------------------

def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``records(headers map, block binary)`` in partition order; ``(path, size, n)`` for every archive. The result
    is to be stored before it is used, so that it is computed once."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("n", pa.int64())])

    def write(batches):
        out, path, size, n = None, "", 0, 0
        for headers, block in text.rows_of(batches):
            if out is None:
                path, size, n = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0, 0
                system, place = _open(path)
                system.create_dir(place.rpartition("/")[0])
                out = system.open_output_stream(place, compression=None)
            data = member(record_bytes(dict(headers), block or b""))
            out.write(data)
            size, n = size + len(data), n + 1
            if size >= ROLL_BYTES:
                out.close()
                out = None
                yield text.batch_of([(path, size, n)], schema)
        if out is not None:
            out.close()
            yield text.batch_of([(path, size, n)], schema)

    return records.select("headers", "block").mapInArrow(write, "path string, size long, n long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of the archives in column ``path``: headers and block are null in a gap, ``gap`` is null in a
    record and else the check that failed first. Empty archives give no rows.

    Every archive is a task of its own: Spark neither merges tasks whose number is given nor puts two paths in one
    where there are as many tasks as paths. An archive from elsewhere is one task too, whatever its size, since where its
    records begin is only known by reading it from the start."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                        ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("gap", pa.string())])

    def read(batches):
        def rows():
            for (path,) in text.rows_of(batches):
                system, place = _open(path)
                with system.open_input_file(place) as file:
                    for start, stop, headers, block, gap in salvage(Archive(file, file.size()), path):
                        yield path, start, stop, None if headers is None else list(headers.items()), block, gap

        yield from text.in_batches(rows(), schema, 50)

    return one_each(archives.select("path")).mapInArrow(read, RECORD)


def one_each(paths: DataFrame) -> DataFrame:
    """The rows of ``paths``, each in a partition of its own. Their places in the sorted list are the partition numbers."""
    n = paths.count()
    if n < 2:
        return paths
    return paths.repartitionByRange(n, "path")


def page_records(pages: DataFrame, least_revisit: int = 100) -> DataFrame:
    """``(headers, block)`` for every row of ``pages``: payloads of at least ``least_revisit`` bytes that occur again are
    stored once, under the least ``page_id`` (all rows of that id), the others revisit it.

    A null html is an empty payload. A null id is never the one referred to unless all ids of a payload are null."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    # written and read again: the join below is then split where one payload holds very many rows
    first = text.stored(rows.where(F.col("n") >= least_revisit).groupBy("digest")
                        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
                        .where("copies > 1 AND first IS NOT NULL").select("digest", "first"), "first-payloads")
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    uri = lambda column: F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("")), F.lit(">"))
    names = {
        "WARC-Type": F.when(revisit, "revisit").otherwise("response"), "WARC-Record-ID": uri(F.col("page_id")),
        "WARC-Target-URI": F.col("url"), "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest")),
        "X-Payload-Length": F.col("n").cast("string"), "Content-Type": F.lit("application/http; msgtype=response"),
    }
    headers = F.create_map(*[c for name, value in names.items() for c in (F.lit(name), value)])
    more = F.create_map(F.lit("WARC-Refers-To"), uri(F.col("first")), F.lit("WARC-Profile"), F.lit(_PROFILE))
    http = F.encode(F.format_string(_HTTP.decode(), F.col("n")), "UTF-8")
    return rows.select(F.when(revisit, F.map_concat(headers, more)).otherwise(headers).alias("headers"),
                       F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))).alias("block"))


def pages_of(records: DataFrame) -> DataFrame:
    """What the records say about pages: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Length and
    digest of a response are taken from its payload, those of a revisit from its headers."""
    header = lambda name: F.col("headers")[name]
    number = lambda name: F.regexp_extract(header(name), r"^<urn:page:(-?\d*)>$", 1).try_cast("long")
    # the payload follows the first empty line of the block; the head is plain ASCII, so bytes can be counted in Latin-1
    head = F.instr(F.decode("block", "ISO-8859-1"), "\r\n\r\n")
    payload = F.substring("block", head + 4, F.octet_length("block"))
    response = header("WARC-Type") == "response"
    return records.where("gap IS NULL").select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(response, F.octet_length(payload)).otherwise(header("X-Payload-Length").cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2(payload, 256)).otherwise(F.substring_index(header("WARC-Payload-Digest"), ":", -1)).alias("payload_digest"),
        header("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"))
