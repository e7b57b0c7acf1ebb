"""Web archives in ZIP packages: writing, and reading by range.

A package is a ZIP file that holds a web archive as a *stored* (not
compressed) member below ``archive/`` and its index below ``indexes/``.  The
archive is a sequence of gzip members, one per WARC record; a line of the
index names offset and length of a record.  So a reader needs the directory
of the package and the index, and then reads any record by its range, without
unpacking anything.

* ``read_directory`` parses the end record, the ZIP64 records and the central
  directory of a package; ``stored_range`` finds where the bytes of a member
  lie.
* ``record_ranges`` is a table of byte ranges of whole records, some
  megabytes each, over all packages; ranges are dealt to tasks, so a very
  large package is read by many.  An archive without an index is one range,
  cut at its gzip members while it is read.
* ``read_records`` reads the ranges and parses the records.

Packages lie in the shared folder.  A task writes packages under names of its
own, and only those in its returned rows count, so a task that is run twice
or lost leaves files that nobody reads.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import stage, work_path

PACKAGE_BYTES = 256 << 20
PACKAGE_RECORDS = 200_000
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 20
LEAST_REVISIT = 100
PART_BITS = 33  # rows are numbered by task, see monotonically_increasing_id: its number stands above these bits
HOT_SHARE = 1000  # a digest is hot if it holds at least one of this many rows
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the formats.
END, END_64, LOCATOR_64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
CENTRAL, LOCAL = b"PK\x01\x02", b"PK\x03\x04"
FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
GZIP_WBITS = 31

MANIFEST = "package string, octets long, records long"
RANGES = "package string, start long, length long, sizes array<long>"
RECORDS = ("record_id string, record_type string, target_uri string, page_id long, payload_digest string, "
           "refers_to_id string, content_length long, payload binary")


class BadPackage(ValueError):
    """The file is no package that this module can read; the message says why."""


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ------------------------------------------------------------------ directory
@dataclass(frozen=True)
class Member:
    """An entry of a package's central directory."""
    name: str
    method: int
    flags: int
    packed: int
    size: int
    header: int  # where its local header begins


def _read_at(file: BinaryIO, at: int, n: int) -> bytes:
    if at < 0:
        raise BadPackage(f"a part would begin at byte {at}")
    file.seek(at)
    data = file.read(n)
    if len(data) < n:
        raise BadPackage(f"the file ends inside a part of {n} bytes at {at}")
    return data


def _end_record(file: BinaryIO, size: int) -> tuple[int, bytes]:
    """Place and bytes of the end record: the last one whose comment reaches the end of the file."""
    tail = min(size, 22 + FULL_16)
    data = _read_at(file, size - tail, tail)
    at = len(data) - 22
    while (at := data.rfind(END, 0, at + 4) if at >= 0 else -1) >= 0:
        if at + 22 + int.from_bytes(data[at + 20:at + 22], "little") == len(data):
            return size - tail + at, data[at:at + 22]
        at -= 1
    raise BadPackage("no end record")


def _extra_64(extra: bytes, wanted: list[bool]) -> list[int | None]:
    """Wide values of the ZIP64 field, in the order size, packed size, offset, where ``wanted``."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, values, here = extra[at + 4:at + 4 + length], [], 0
            for want in wanted:
                if want and here + 8 > len(field):
                    raise BadPackage("a ZIP64 field is too short")
                values.append(int.from_bytes(field[here:here + 8], "little") if want else None)
                here += 8 * want
            return values
        at += 4 + length
    if any(wanted):
        raise BadPackage("a ZIP64 field is missing")
    return [None] * len(wanted)


def read_directory(file: BinaryIO, size: int) -> Iterator[Member]:
    """Members of the package, in the order of its central directory.

    Reads the end of the file and the directory only, a piece at a time.
    Bytes before the package are allowed.  Several volumes and damaged
    directories raise :class:`BadPackage`.
    """
    if size < 22:
        raise BadPackage("shorter than an end record")
    end_at, end = _end_record(file, size)
    disk, first_disk, _, entries, length, start, _ = struct.unpack("<4xHHHHIIH", end)
    stop = end_at
    if FULL_16 in (disk, entries) or FULL_32 in (length, start):
        locator = _read_at(file, end_at - 20, 20) if end_at >= 20 else b""
        if locator.startswith(LOCATOR_64):
            _, wide_at, disks = struct.unpack("<4xIQI", locator)
            shift = 0
            wide = _read_at(file, wide_at, 56) if wide_at + 56 <= end_at else b""
            if not wide.startswith(END_64):  # bytes before the package move everything
                wide_at = end_at - 20 - 56
                wide = _read_at(file, wide_at, 56)
            if not wide.startswith(END_64) or disks > 1:
                raise BadPackage("no ZIP64 end record, or several volumes")
            disk, first_disk, _, entries, length, start = struct.unpack("<16xIIQQQQ", wide)
            stop = wide_at + shift
    if disk or first_disk:
        raise BadPackage("several volumes")
    moved = stop - (start + length)  # bytes before the package
    if moved < 0:
        raise BadPackage("the directory overlaps its end record")
    at, upto, held, seen = start + moved, stop, b"", 0
    while seen < entries:
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            more = min(READ_BYTES, upto - at)
            if not more:
                raise BadPackage(f"the directory ends after {seen} of {entries} members")
            held, at = held + _read_at(file, at, more), at + more
        if not held.startswith(CENTRAL):
            raise BadPackage(f"member {seen} has no directory header")
        flags, method = struct.unpack_from("<HH", held, 8)
        packed, full, names, extras, comment = struct.unpack_from("<IIHHH", held, 20)
        header = int.from_bytes(held[42:46], "little")
        name = held[46:46 + names]
        wide = _extra_64(held[46 + names:46 + names + extras], [full == FULL_32, packed == FULL_32, header == FULL_32])
        full, packed, header = (old if new is None else new for old, new in zip((full, packed, header), wide, strict=True))
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, flags, packed, full, header + moved)
        held, seen = held[46 + names + extras + comment:], seen + 1


def stored_range(file: BinaryIO, member: Member) -> tuple[int, int]:
    """Where the bytes of a stored member lie: their start and length in the package."""
    if member.method or member.flags & 1:
        raise BadPackage(f"{member.name} is compressed or encrypted and cannot be read by range")
    header = _read_at(file, member.header, 30)
    if not header.startswith(LOCAL):
        raise BadPackage(f"{member.name} has no local header")
    names, extras = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + names + extras, member.size


# -------------------------------------------------------------------- records
def _record(fields: list[tuple[str, str | None]], block: list[bytes]) -> bytes:
    head = [VERSION, *(f"{name}: {value}".encode() for name, value in fields if value is not None),
            b"Content-Length: %d" % sum(map(len, block))]
    return b"".join([b"\r\n".join(head), b"\r\n\r\n", *block, b"\r\n\r\n"])


def record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=row + (1 << 64))}>"


def written_record(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str,
                   refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the headers of the reply, which tell the length, and no payload."""
    revisit = refers_to is not None
    reply = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row)),
              ("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-Id", None if page_id is None else str(page_id)),
              ("WARC-Refers-To", record_id(refers_to) if revisit else None),
              ("WARC-Profile", PROFILE if revisit else None), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, [reply] if revisit else [reply, payload])


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode(errors="replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def parsed_record(data: bytes) -> tuple | None:
    """A record as a row of ``RECORDS``; null for the kinds that hold no reply."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not found:
        raise BadPackage("a record has no WARC header")
    fields = _fields(head)
    kind = fields.get("warc-type")
    length = int(fields.get("content-length", "0"))
    if len(rest) < length:
        raise BadPackage(f"record {fields.get('warc-record-id')} is cut off")
    if kind not in ("response", "revisit"):
        return None
    reply, _, payload = rest[:length].partition(b"\r\n\r\n")
    page, told = fields.get("page-id"), _fields(reply).get("content-length")
    return (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), None if page is None else int(page),
            fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, fields.get("warc-refers-to"),
            len(payload) if told is None else int(told), None if kind == "revisit" else payload)


# -------------------------------------------------------------------- writing
class _Package:
    """A package that is being written; its archive goes straight to the file, its index is kept until the end."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = file_system(self.path)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.octets, self.index = 0, []

    def add(self, record: bytes, digest: str, url: str | None) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, GZIP_WBITS)
        data = packer.compress(record) + packer.flush()
        self.archive.write(data)
        about = {"filename": ARCHIVE, "offset": self.octets, "length": len(data), "digest": digest}
        self.index.append(f"{quote(url or '-', safe='/:.')} {DATE} {json.dumps(about)}\n")
        self.octets += len(data)

    def full(self) -> bool:
        return self.octets >= PACKAGE_BYTES or len(self.index) >= PACKAGE_RECORDS

    def close(self) -> tuple[str, int, int]:
        self.archive.close()
        with self.zip.open(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "w") as index:
            index.write("".join(self.index).encode())
        self.zip.close()
        self.out.close()
        return self.path, self.octets, len(self.index)


def _revisits_of(folder: str, part: int) -> dict[int, int]:
    """Of the rows that one task numbered, those that are revisits, with the row they refer to."""
    system, path = file_system(f"{folder}/part={part}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    table = dataset.dataset(path, filesystem=system, format="parquet").to_table(columns=["row", "first"])
    return dict(zip(table["row"].to_pylist(), table["first"].to_pylist(), strict=True))


def _write(folder: str, revisits: str):
    def write(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done, part, first = None, [], None, {}
        for record in records:
            columns = [record.column(name) for name in ("row", "page_id", "url", "payload", "digest")]
            for row, page_id, url, payload, digest in zip(*columns, strict=True):
                package = package or _Package(folder)
                row, url = row.as_py(), url.as_py()
                if row >> PART_BITS != part:
                    part = row >> PART_BITS
                    first = _revisits_of(revisits, part)
                package.add(written_record(row, page_id.as_py(), url, payload.as_py(), digest.as_py(), first.get(row)),
                            digest.as_py(), url)
                if package.full():
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["package", "octets", "records"])
    return write


def _firsts(rows: DataFrame) -> DataFrame:
    """Per digest that several rows share: the row of the smallest page, and how many share it."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")  # rows without id come last
    return (rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
            .select("digest", F.col("first.row").alias("first"), "n"))


def _look_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left-joined with a table of one row per key and a count ``n`` of the rows it serves.

    A key with at least a ``HOT_SHARE``-th of all rows is hot; there are at
    most ``HOT_SHARE`` of them, so they are broadcast.  All other keys hold
    few rows and go through a shuffled join.
    """
    least = max(total // HOT_SHARE, 1)
    hot = F.broadcast(table.filter(F.col("n") > least).drop("n"))
    value = [name for name in hot.columns if name != key]
    found = rows.join(hot, key, "left")
    rest = (found.filter(F.col(value[0]).isNull()).drop(*value)
            .join(table.filter(F.col("n") <= least).drop("n").hint("merge"), key, "left"))
    return found.filter(F.col(value[0]).isNotNull()).unionByName(rest)


def write_packages(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``) and return the table of packages.

    The payload is the text in UTF-8; null counts as empty.  Of records with
    equal payloads of at least ``least_revisit`` bytes, the one with the
    smallest ``page_id`` is a response and the others are revisits of it; a
    row without id is the response only if no row of its payload has one, and
    of rows that repeat id and payload one is the response.  Shorter payloads
    are all responses.  A package ends with the task's rows or at
    ``PACKAGE_BYTES``; a record of any length fits.  An empty table makes no
    package; other columns are not read.

    Only row numbers and digests are shuffled.  What they tell is stored by
    the task that numbered the rows, and the writer of a row looks it up
    there, so no payload leaves its place.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = stage(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url",
        F.encode(text, "UTF-8").alias("payload"), F.sha2(text, 256).alias("digest")), "payloads")
    total = rows.count()
    firsts = stage(_firsts(rows.filter(F.octet_length("payload") >= least_revisit).select("digest", "page_id", "row")),
                   "first-pages")
    revisits = work_path(spark, "revisits")
    (_look_up(rows.select("row", "digest"), firsts, "digest", total).filter(F.col("first") != F.col("row"))
     .select("row", "first", F.shiftright("row", PART_BITS).alias("part"))
     .repartition("part").write.partitionBy("part").parquet(revisits))
    folder = work_path(spark, "packages")
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    return stage(rows.select("row", "page_id", "url", "payload", "digest")
                 .mapInArrow(_write(folder, revisits), MANIFEST), "package-list")


# -------------------------------------------------------------------- reading
def _index_lines(file: BinaryIO, start: int, length: int, packed: bool) -> Iterator[str]:
    """Lines of an index member, read a piece at a time."""
    unpacker, held = zlib.decompressobj(GZIP_WBITS) if packed else None, b""
    for at in range(start, start + length, READ_BYTES):
        data = _read_at(file, at, min(READ_BYTES, start + length - at))
        *lines, held = (held + (unpacker.decompress(data) if unpacker else data)).split(b"\n")
        yield from (line.decode() for line in lines)
    yield held.decode()


def package_ranges(file: BinaryIO, size: int) -> Iterator[tuple[int, int, list[int]]]:
    """Start, length and record sizes of ranges of whole records; no sizes where an archive has no index."""
    members = list(read_directory(file, size))
    archives = {m.name: stored_range(file, m) for m in members
                if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))}
    indexed = set()
    for member in members:
        if not member.name.startswith("indexes/") or not member.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            continue
        start, sizes, upto = 0, [], None
        for line in _index_lines(file, *stored_range(file, member), member.name.endswith(".gz")):
            if "{" not in line:
                continue
            about = json.loads(line[line.index("{"):])
            name = about["filename"] if "/" in about["filename"] else f"archive/{about['filename']}"
            if name not in archives:
                raise BadPackage(f"the index names {name}, which is no stored member")
            base, whole = archives[name]
            offset, length = int(about["offset"]), int(about["length"])
            if offset < 0 or length < 0 or offset + length > whole:
                raise BadPackage(f"an index line reaches beyond {name}")
            indexed.add(name)
            if sizes and (base + offset != upto or upto - start + length > RANGE_BYTES):
                yield start, upto - start, sizes
                sizes = []
            start = start if sizes else base + offset
            sizes.append(length)
            upto = base + offset + length
        if sizes:
            yield start, upto - start, sizes
    for name, (base, whole) in archives.items():
        if name not in indexed and whole:
            yield base, whole, []


def _list_ranges(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for record in records:
        for package in record.column("package").to_pylist():
            system, path = file_system(package)
            with system.open_input_file(path) as file:
                rows = [(package, *found) for found in package_ranges(file, file.size())]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(),
                                                                 pa.list_(pa.int64())), strict=True)],
                    names=["package", "start", "length", "sizes"])


def record_ranges(packages: DataFrame) -> DataFrame:
    """Byte ranges of whole records over all packages, from their directories and indexes alone."""
    return packages.select("package").mapInArrow(_list_ranges, RANGES)


def _plain_records(data: Iterator[bytes]) -> Iterator[bytes]:
    """Records of an archive that is not compressed, by the lengths they tell."""
    held = b""
    for piece in data:
        held += piece
        while (found := held.find(b"\r\n\r\n")) >= 0:
            upto = found + 4 + int(_fields(held[:found]).get("content-length", "0")) + 4
            if len(held) < upto:
                break
            yield held[:upto]
            held = held[upto:]
    if held.strip():
        raise BadPackage("an archive ends inside a record")


def _gzip_members(data: Iterator[bytes]) -> Iterator[bytes]:
    """What each gzip member of an archive holds."""
    unpacker, parts = zlib.decompressobj(GZIP_WBITS), []
    for piece in data:
        while piece:
            parts.append(unpacker.decompress(piece))
            piece = b""
            if unpacker.eof:
                yield b"".join(parts)
                piece, unpacker, parts = unpacker.unused_data, zlib.decompressobj(GZIP_WBITS), []
    if any(parts):
        raise BadPackage("an archive ends inside a gzip member")


def _range_records(file: BinaryIO, start: int, length: int, sizes: list[int]) -> Iterator[bytes]:
    if sizes:
        data = io.BytesIO(_read_at(file, start, length))
        for size in sizes:
            part = data.read(size)
            yield from _gzip_members(iter([part])) if part.startswith(b"\x1f\x8b") else iter([part])
        return
    pieces = (_read_at(file, at, min(READ_BYTES, start + length - at)) for at in range(start, start + length, READ_BYTES))
    packed = _read_at(file, start, min(2, length)) == b"\x1f\x8b"
    yield from (_gzip_members if packed else _plain_records)(pieces)


_ROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                  ("page_id", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()),
                  ("content_length", pa.int64()), ("payload", pa.binary())])


def _read(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for record in records:
        for where in record.to_pylist():
            system, path = file_system(where["package"])
            with system.open_input_file(path) as file:
                for data in _range_records(file, where["start"], where["length"], where["sizes"]):
                    row = parsed_record(data)
                    if row is None:
                        continue
                    if row[-1] is not None and row[4] and hashlib.sha256(row[-1]).hexdigest() != row[4]:
                        raise BadPackage(f"the payload of record {row[0]} does not have its digest")
                    rows.append(row)
                    held += len(data)
                    if held >= RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, x, strict=True)) for x in rows], _ROW)
                        rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, x, strict=True)) for x in rows], _ROW)


def read_records(packages: DataFrame) -> DataFrame:
    """Replies of all packages: response records with their payload, revisit records without.

    ``packages`` needs a column ``package``, the paths.  Records of other
    kinds (file information, requests) are passed over.  A payload that does
    not have the digest its record tells raises :class:`BadPackage`, as does
    a package that is damaged; none is skipped.  No package gives no rows.
    """
    ranges = stage(record_ranges(packages), "record-ranges")
    n = max(1, min(10_000, -(-ranges.count() // 4)))
    return ranges.repartition(max(n, packages.sparkSession.sparkContext.defaultParallelism)).mapInArrow(_read, RECORDS)


def replies(records: DataFrame) -> DataFrame:
    """``page_id``, length and digest of the full payload, kind of record, and the page a revisit refers to.

    A revisit is resolved through the id of the response it names: its digest
    must be that response's (an unresolved one keeps what its own record
    tells, and refers to no page).
    """
    rows = stage(records.select(
        "record_id", "page_id", "record_type", "refers_to_id",
        F.coalesce(F.octet_length("payload"), F.col("content_length")).cast("long").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest")), "replies")
    again = rows.filter("record_type = 'revisit'")
    counts = again.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    named = rows.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"),
        F.struct(F.col("page_id").alias("page"), F.col("payload_digest").alias("digest")).alias("whole"))
    found = _look_up(again, stage(named.join(counts, "refers_to_id"), "referred"), "refers_to_id", again.count())
    right = F.col("whole").isNull() | (F.col("whole.digest") == F.col("payload_digest"))
    checked = found.withColumn("refers_to", F.when(right, F.col("whole.page")).otherwise(F.raise_error(
        F.concat(F.lit("a revisit has another digest than "), "refers_to_id")).cast("long")))
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    whole = rows.filter("record_type <> 'revisit'").select(*shown, F.lit(None).cast("long").alias("refers_to"))
    return whole.unionByName(checked.select(*shown, "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in packages and list what is read back from them."""
    return replies(read_records(write_packages(pages)))


def payload_text(payload: Column) -> Column:
    """The text of a payload in UTF-8."""
    return F.decode(payload, "UTF-8")


def packages_in(spark: SparkSession, folder: str) -> DataFrame:
    """The table of packages for all ``*.wacz`` and ``*.zip`` files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        F.col("path").alias("package"))
    return files.filter(F.lower("package").rlike(r"\.(wacz|zip)$"))
