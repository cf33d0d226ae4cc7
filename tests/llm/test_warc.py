"""WARC records in ZIP packages: round trips, roles, wide directories and faults."""

import gzip
import hashlib
import io
import os
import struct
import zipfile

import pytest

from ledgerloom.llm import warc
from ledgerloom.session import scratch_path

BIG = "x" * 1500
PAGES = (
    [(i, f"http://host.example/{i}", f"<p>page {i}</p>" * (i + 1)) for i in range(120)]
    + [(1000 + i, f"http://copies.example/{i}", BIG) for i in range(60)]
    + [(2000, None, None), (2001, "", ""), (None, "a b\n", BIG), (None, None, "y" * 2000), (None, None, "y" * 2000)]
    + [(2100, "ü ", BIG), (2100, "ü ", BIG), (3, "q", "é" * 500), (4, "q", "é" * 500), (5, "q", "é" * 499 + "e"), (6, "q", "é" * 499 + "e")]
    + [(2200, "long", "z" * 9_000_000)]
)
SCHEMA = "page_id long, url string, html string"


def expected(rows):
    best = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and page_id is not None:
            best[payload] = max(best.get(payload, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        response = best.get(payload)
        revisit = response is not None and response != page_id
        name = None if page_id is None else str(page_id)
        out.append((name, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", str(response) if revisit else None, None if revisit else payload, True))
    return sorted(out, key=str)


def found(records):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "intact"]
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in records.select(*names).collect()), key=str)


def file_of(path):
    return path.removeprefix("file:")


@pytest.mark.parametrize("options", [{}, {"zip64": True, "package_bytes": 2_000, "member_bytes": 500}])
def test_pages_come_back(spark, options):
    pages = spark.createDataFrame(PAGES, f"{SCHEMA}").selectExpr("*", "1 AS payload", "'x' AS digest", "'y' AS refers_to").repartition(4)
    manifest = warc.write_packages(pages, **options)
    assert found(warc.read_packages(manifest)) == expected(PAGES)
    assert found(warc.read_packages(manifest, range_bytes=700)) == expected(PAGES)
    urls = {r.url for r in warc.read_packages(manifest, payload=False).collect()}
    assert {"http://host.example/7", "a%20b%0A", "ü%20", None, ""} <= urls
    # other readers agree on the package and its records
    for row in manifest.collect():
        with zipfile.ZipFile(file_of(row.package)) as package:
            assert package.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in package.infolist())
            texts = [gzip.decompress(package.read(n)) for n in package.namelist() if n.startswith("archive/")]
            assert sum(t.count(b"WARC/1.1\r\n") for t in texts) == row.records


def test_copies_are_found_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "HOT_COPIES", 10)
    pages = spark.createDataFrame(PAGES, SCHEMA)
    assert found(warc.read_packages(warc.write_packages(pages))) == expected(PAGES)


def test_no_pages(spark):
    manifest = warc.write_packages(spark.createDataFrame([], SCHEMA))
    assert manifest.count() == 0 and warc.read_packages(manifest).count() == 0


def package_of(spark, members, comment=b"", zip64=False, compression=zipfile.ZIP_STORED):
    """A package made by the standard library, as a manifest."""
    folder = file_of(scratch_path(spark, "warc-test"))
    os.makedirs(folder)
    path = f"{folder}/a.wacz"
    with zipfile.ZipFile(path, "w", compression) as package:
        package.comment = comment
        for name, data in members:
            with package.open(name, "w", force_zip64=zip64) as out:
                out.write(data)
    return spark.createDataFrame([(path, os.path.getsize(path))], "package string, bytes long"), path


def payload_records(n):
    payloads = [bytes([97 + i % 26]) * (i * 50 + 1) for i in range(n)]
    return payloads, [gzip.compress(warc.record(str(i), "u", p, hashlib.sha1(p).hexdigest())) for i, p in enumerate(payloads)]


@pytest.mark.parametrize("zip64", [False, True])
def test_members_without_index_are_walked(spark, zip64):
    payloads, records = payload_records(40)
    members = [("archive/one.warc.gz", b"".join(records)), ("pages/pages.jsonl", b"{}"), ("archive/empty.warc.gz", b"")]
    manifest, _ = package_of(spark, members, comment=b"PK\x05\x06 is no end record here" + b"." * 40, zip64=zip64)
    got = warc.read_packages(manifest).orderBy("offset").collect()
    assert [bytes(r.payload) for r in got] == payloads
    assert [r.offset for r in got] == [sum(map(len, records[:i])) for i in range(40)]


def test_blocks_of_a_walk_may_cut_records(monkeypatch):
    payloads, records = payload_records(30)
    data = b"".join(records)
    monkeypatch.setattr(warc, "BLOCK_BYTES", 37)
    walked = list(warc._walk(io.BytesIO(b"??" + data), 2, 2 + len(data)))
    assert [warc.parse(plain)[2] for _, plain in walked] == payloads


def test_faults(spark):
    payloads, records = payload_records(3)
    packed, _ = package_of(spark, [("archive/one.warc.gz", b"".join(records))], compression=zipfile.ZIP_DEFLATED)
    with pytest.raises(Exception, match="not stored plainly"):
        warc.read_packages(packed).count()
    outside, path = package_of(spark, [("archive/a.warc.gz", records[0]), ("indexes/index.cdxj", b'k {"filename": "a.warc.gz", "offset": "9999", "length": 5}\n')])
    with pytest.raises(Exception, match="points behind"):
        warc.read_packages(outside).count()
    with pytest.raises(ValueError, match="not a ZIP package"):
        warc.members(io.BytesIO(b"x" * 100), 100)
    wrong = gzip.compress(warc.record("1", "u", b"changed", hashlib.sha1(b"original").hexdigest()))
    changed, _ = package_of(spark, [("archive/a.warc.gz", wrong)])
    assert [r.intact for r in warc.read_packages(changed).collect()] == [False]


def test_offsets_beyond_four_gigabytes():
    """A directory whose places do not fit 32 bits, without writing the bytes before it."""

    stream = io.BytesIO()
    writer = warc.PackageWriter(stream)
    writer.at = 5 << 30
    writer.add("archive/far.warc.gz", b"0123456789")
    total = writer.close()
    data = stream.getvalue()

    class Shifted:
        def seek(self, at):
            self.at = at - (5 << 30)

        def read(self, n):
            lead = b"\0" * min(n, max(0, -self.at))
            return lead + data[max(0, self.at) : self.at + n]

    found = warc.members(Shifted(), total)
    assert [(m.name, m.size) for m in found] == [("archive/far.warc.gz", 10)]
    assert data[found[0].start - (5 << 30) :][:10] == b"0123456789"
    assert struct.unpack_from("<4s", data, data.rfind(warc.END64))[0] == warc.END64
