"""Packages of web archives: directories, ranges, records, and the round trip of pages."""

import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import warc
from tidewatch.session import stage


def package(members, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for name, data in members:
            with archive.open(zipfile.ZipInfo(name), "w", **options) as member:
                member.write(data)
    return out.getvalue()


def widened(data):
    """The same package with ZIP64 sizes, offsets and end records throughout."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        infos = archive.infolist()
    end = data.rindex(warc.END)
    start = int.from_bytes(data[end + 16:end + 20], "little")
    directory = b""
    for info in infos:
        extra = struct.pack("<HHQQQ", 1, 24, info.file_size, info.compress_size, info.header_offset)
        other = struct.pack("<HHI", 0x9999, 4, 7)
        name = info.filename.encode()
        directory += warc.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, info.flag_bits, info.compress_type, 0, 0, info.CRC,
                                                0xFFFFFFFF, 0xFFFFFFFF, len(name), len(other + extra), 3, 0, 0, 0,
                                                0xFFFFFFFF) + name + other + extra + b"hey"
    wide = warc.END_64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(infos), len(infos), len(directory), start)
    locator = warc.LOCATOR_64 + struct.pack("<IQI", 0, start + len(directory), 1)
    return (data[:start] + directory + wide + locator
            + warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


MEMBERS = [("archive/data.warc.gz", b"first " * 50), ("indexes/index.cdxj", b""), ("pages/é.txt", b"x")]


@pytest.mark.parametrize("change", [
    lambda data: data, widened, lambda data: b"#!/bin/sh junk PK\x05\x06\n" + data, lambda data: b"junk" * 9 + widened(data)])
def test_directories(change):
    data = change(package(MEMBERS))
    file = io.BytesIO(data)
    members = list(warc.read_directory(file, len(data)))
    assert [(m.name, m.size) for m in members] == [(name, len(text)) for name, text in MEMBERS]
    for member, (_, text) in zip(members, MEMBERS, strict=True):
        start, length = warc.stored_range(file, member)
        assert data[start:start + length] == text


def test_directory_with_a_comment_and_many_members(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 100)  # the directory comes in pieces
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.comment = b"a comment with PK\x05\x06 in it" * 3
        for k in range(500):
            archive.writestr(f"archive/{k}.warc", b"%d" % k)
    data = out.getvalue()
    members = list(warc.read_directory(io.BytesIO(data), len(data)))
    assert [m.name for m in members] == [f"archive/{k}.warc" for k in range(500)]


@pytest.mark.parametrize("data", [
    b"", b"x" * 10, b"x" * 1000, package(MEMBERS)[:-1], package(MEMBERS)[200:], package(MEMBERS).replace(warc.CENTRAL, b"PK\x01\x09"),
    widened(package(MEMBERS)).replace(warc.END_64, b"PK\x06\x09"),
    widened(package(MEMBERS)).replace(struct.pack("<HH", 1, 24), struct.pack("<HH", 2, 24))])
def test_damaged_directories(data):
    with pytest.raises(warc.BadPackage):
        members = list(warc.read_directory(io.BytesIO(data), len(data)))
        for member in members:
            warc.stored_range(io.BytesIO(data), member)


def test_compressed_members_cannot_be_read_by_range():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("archive/data.warc", b"a" * 1000)
    data = out.getvalue()
    with pytest.raises(warc.BadPackage):
        list(warc.package_ranges(io.BytesIO(data), len(data)))


RECORDS = [warc.written_record(k, k * 10, f"http://h/{k}", b"<p>%d</p>" % k * k, hashlib.sha256(b"<p>%d</p>" % k * k).hexdigest(), None)
           for k in range(40)] + [b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"]


def index(parts, name="data.warc.gz"):
    lines, at = [], 0
    for part in parts:
        lines.append(f"key 2024 {json.dumps({'filename': name, 'offset': str(at), 'length': str(len(part))})}\n")
        at += len(part)
    return "".join(lines).encode()


@pytest.mark.parametrize("form", ["index", "packed index", "no index", "plain", "plain with index", "shuffled index"])
def test_ranges_give_all_records(spark, tmp_path, monkeypatch, form):
    monkeypatch.setattr(warc, "READ_BYTES", 333)
    parts = [gzip.compress(r) for r in RECORDS]
    plain = form.startswith("plain")
    parts = RECORDS if plain else parts
    name = "data.warc" if plain else "data.warc.gz"
    lines = index(parts, name)
    if form == "shuffled index":
        lines = b"\n".join(sorted(lines.split(b"\n"), key=lambda line: hashlib.md5(line).digest()))
    members = [(f"archive/{name}", b"".join(parts))]
    if form == "packed index":
        members.append(("indexes/index.cdx.gz", gzip.compress(lines)))
    elif "index" in form and form != "no index":
        members.append(("indexes/index.cdxj", lines))
    data = package(members)
    file = io.BytesIO(data)
    ranges = list(warc.package_ranges(file, len(data)))
    assert sum(length for _, length, _ in ranges) == sum(map(len, parts))
    got = [r for where in ranges for r in warc._range_records(file, *where)]
    assert Counter(got) == Counter(RECORDS)
    (tmp_path / "one.wacz").write_bytes(data)
    read = warc.read_records(warc.packages_in(spark, str(tmp_path))).collect()
    assert sorted(r.page_id for r in read) == [k * 10 for k in range(40)]
    assert all(bytes(r.payload) == b"<p>%d</p>" % (r.page_id // 10) * (r.page_id // 10) for r in read)


def test_wrong_indexes_and_payloads(spark, tmp_path):
    data = package([("archive/data.warc.gz", b"x" * 10), ("indexes/index.cdxj", index([b"y" * 20]))])
    with pytest.raises(warc.BadPackage):
        list(warc.package_ranges(io.BytesIO(data), len(data)))
    wrong = gzip.compress(warc.written_record(1, 1, None, b"<p></p>", "0" * 64, None))
    (tmp_path / "one.wacz").write_bytes(package([("archive/data.warc.gz", wrong)]))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(warc.packages_in(spark, str(tmp_path))).collect()


PAGE = "page_id long, url string, html string"


def odd_pages():
    page = "<html>" + "word " * 60 + "</html>"
    rows = [(k, f"http://h/{k}", f"<p>{k % 30}</p>" * (k % 13)) for k in range(300)]
    rows += [(1000 + k, None, page) for k in range(50)] + [(1000, "http://again", page)] * 3  # repeats, also of the first
    rows += [(None, "u", page), (None, "u", "only without an id " * 9), (None, "v", "only without an id " * 9), (2000, "n", None),
             (2001, "n", ""), (2002, "http://a\r\nb: cé \U0001f600", "é" * 50), (2003, "x", "é" * 50),
             (2004, "y", "z" * 99), (2005, "y", "z" * 99), (2006, "long", "longer " * 700_000), (2007, "long", "longer " * 700_000),
             (-5, "minus", page)]
    return rows


def plain(rows):
    groups = defaultdict(list)
    for k, (page_id, _, html) in enumerate(rows):
        groups[html or ""].append((page_id is None, page_id or 0, k))
    out = Counter()
    for html, members in groups.items():
        data = html.encode()
        digest = hashlib.sha256(data).hexdigest()
        first = min(members)
        for member in members:
            again = len(data) >= 100 and member != first
            named = [None if none else page for none, page, _ in (member, first)]
            out[(named[0], len(data), digest, "revisit" if again else "response", named[1] if again else None)] += 1
    return out


@pytest.mark.parametrize("package_bytes", [1 << 28, 2000])
def test_round_trip(spark, monkeypatch, package_bytes):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", package_bytes)
    monkeypatch.setattr(warc, "RANGE_BYTES", 3000 if package_bytes == 2000 else 4 << 20)
    rows = odd_pages()
    frame = spark.createDataFrame(rows, PAGE).repartition(5).withColumns(
        {name: F.lit("clash") for name in ("row", "digest", "payload", "first", "n", "refers_to", "package")})
    got = warc.round_trip(frame)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_texts_and_addresses_come_back(spark):
    rows = odd_pages()[-12:]
    packages = warc.write_packages(spark.createDataFrame(rows, PAGE))
    read = {r.page_id: r for r in warc.read_records(packages).withColumn("text", warc.payload_text(F.col("payload"))).collect()}
    assert read[2002].text == "é" * 50 and read[2006].text == "longer " * 700_000 and read[2001].text == ""
    assert read[2002].target_uri == "http://a%0D%0Ab:%20c%C3%A9%20%F0%9F%98%80"
    assert read[2003].record_type == "revisit" and read[2003].payload is None


def test_given_pages(spark, sf):
    from tidewatch.llm.queries import QUERIES
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op11_warc"](spark, sf).collect())) == plain(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], PAGE)
    assert warc.round_trip(empty).count() == 0


def test_payloads_are_not_shuffled(spark, monkeypatch):
    """Rows find the response of their payload by a stored table; plans of what is written move numbers and digests only."""
    plans = {}
    monkeypatch.setattr(warc, "stage", lambda df, label: (
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()), stage(df, label))[1])
    rows = [(k, f"http://h/{k}", f"<p>{k % 5} {'words again ' * 50}</p>") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7, "page_id")
    packages = warc.write_packages(pages)
    assert "Exchange" not in plans["package-list"] and "Join" not in plans["package-list"]
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.replies(warc.read_records(packages)).collect())
    assert got == [(k, len(html), "response" if k < 5 else "revisit", None if k < 5 else k % 5) for k, _, html in rows]
    alone = spark.createDataFrame(rows[:3], pages.schema)  # no revisit at all
    assert {r.record_type for r in warc.round_trip(alone).collect()} == {"response"}
