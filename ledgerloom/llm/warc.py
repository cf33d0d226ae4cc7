"""WARC records in ZIP packages: written by tasks, then read back in ranges without unpacking anything.

A package is a ZIP archive in which nothing is compressed as a whole: ``archive/*.warc.gz`` holds one gzip
member per record, ``indexes/index.cdxj`` names file, offset and length of every record. Because the members
are stored, the place of a record in the package is the place of its archive member plus the index's offset.

* **Writing.** Each task streams its rows into packages of bounded size; an archive member is held until it is
  full, so memory follows the member and the longest single record. Names are random and the manifest, a table,
  lists only what the tasks that counted have written: a lost or repeated task leaves nothing that is read.
* **Reading.** A first pass over the manifest reads the end of each package, its central directory (with the
  ZIP64 records where offsets or counts need them), the local headers and the indexes, and yields ranges of
  bounded length. Those are dealt evenly, and a second pass reads them, a range at a time. A member that no
  index covers is walked from its start in blocks.

Packages lie in any file system that pyarrow knows (local, hdfs, s3, gs); tasks open them by themselves.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import BROADCAST_ROWS, materialize
from ledgerloom.session import scratch_path

LEAST_REVISIT = 1_000
HOT_COPIES = 20_000
PACKAGE_BYTES = 256 << 20
PACKAGE_RECORDS = 100_000
MEMBER_BYTES = 4 << 20
RANGE_BYTES = 4 << 20
TASK_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20
LEVEL = 3
BATCH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"  # the tables have no time of capture

ARCHIVES, INDEXES = "archive/", "indexes/"
# Signatures and layouts of the ZIP format
LOCAL, ENTRY, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR = b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORMAT, ENTRY_FORMAT, END_FORMAT = "<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"
END64_FORMAT, LOCATOR_FORMAT = "<4sQ2H2L4Q", "<4sLQL"
FULL16, FULL32, ZIP64 = 0xFFFF, 0xFFFFFFFF, 0x0001
# Fixed value: the profile of a revisit of an equal payload
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "package string, bytes long, members int, records long"
RANGES = "package string, member string, start long, stop long, offsets array<long>, lengths array<long>"
RECORDS = (
    "package string, member string, offset long, record_type string, page_id string, url string, refers_to string, "
    "payload_digest string, payload_bytes long, intact boolean"
)


# --- ZIP ---


class PackageWriter:
    """Writes a ZIP of stored members front to back. ``zip64`` forces the wide records where short ones would do."""

    def __init__(self, stream, zip64: bool = False) -> None:
        self.stream, self.zip64, self.at = stream, zip64, 0
        self.entries: list[tuple[bytes, int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        wide = self.zip64 or len(data) >= FULL32
        extra = struct.pack("<2H2Q", ZIP64, 16, len(data), len(data)) if wide else b""
        size = FULL32 if wide else len(data)
        self._put(struct.pack(LOCAL_FORMAT, LOCAL, 45 if wide else 20, 0, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, len(data), start))

    def close(self) -> int:
        """Write the directory; bytes of the package."""
        start = self.at
        for raw, crc, size, place in self.entries:
            wide_size, wide_place = self.zip64 or size >= FULL32, self.zip64 or place >= FULL32
            fields = [size, size] * wide_size + [place] * wide_place
            extra = struct.pack(f"<2H{len(fields)}Q", ZIP64, 8 * len(fields), *fields) if fields else b""
            short, at = FULL32 if wide_size else size, FULL32 if wide_place else place
            version = 45 if fields else 20
            self._put(struct.pack(ENTRY_FORMAT, ENTRY, version, version, 0, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra)
        size, count = self.at - start, len(self.entries)
        if self.zip64 or count >= FULL16 or start >= FULL32 or size >= FULL32:
            place = self.at
            self._put(struct.pack(END64_FORMAT, END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack(LOCATOR_FORMAT, LOCATOR, 0, place, 1))
            count, size, start = FULL16, FULL32, FULL32
        self._put(struct.pack(END_FORMAT, END, 0, 0, count, count, size, start, 0))
        return self.at


@dataclass
class Member:
    name: str
    start: int
    size: int


def _read(file, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"package ends early: {size} bytes wanted at {start}")
    return data


def _directory(file, length: int) -> tuple[int, int, int]:
    """Place, bytes and entries of the central directory, from the records at the end of the package."""
    tail_at = max(0, length - struct.calcsize(END_FORMAT) - FULL16)
    tail = _read(file, tail_at, length - tail_at)
    at = tail.rfind(END)
    # a comment may hold the signature; the right one is followed by just its comment
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP package: no end record")
    _, _, _, _, count, size, start, _ = struct.unpack_from(END_FORMAT, tail, at)
    locator = tail_at + at - struct.calcsize(LOCATOR_FORMAT)
    if locator >= 0 and (count == FULL16 or FULL32 in (size, start)):
        found = _read(file, locator, struct.calcsize(LOCATOR_FORMAT))
        if found[:4] == LOCATOR:
            place = struct.unpack(LOCATOR_FORMAT, found)[2]
            fields = struct.unpack(END64_FORMAT, _read(file, place, struct.calcsize(END64_FORMAT)))
            if fields[0] != END64:
                raise ValueError("broken ZIP64 end record")
            count, size, start = fields[7:10]
    return start, size, count


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Values whose 32 bits are full, from the ZIP64 field, which holds just those in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == ZIP64:
            place = at + 4
            for i, value in enumerate(values):
                if value == FULL32:
                    values[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + size
    return values


def members(file, length: int) -> list[Member]:
    """Stored members of a package and where their bytes begin; an archive or index that is packed is an error."""
    start, size, count = _directory(file, length)
    data, at, found = _read(file, start, size), 0, []
    for _ in range(count):
        fields = struct.unpack_from(ENTRY_FORMAT, data, at)
        if fields[0] != ENTRY:
            raise ValueError("broken central directory")
        flags, method, names, extras, comments = fields[3], fields[4], fields[10], fields[11], fields[12]
        body = at + struct.calcsize(ENTRY_FORMAT)
        name = data[body : body + names].decode()
        plain, packed, place = _wide(data[body + names : body + names + extras], [fields[9], fields[8], fields[16]])
        at = body + names + extras + comments
        if not name.startswith((ARCHIVES, INDEXES)) or name.endswith("/"):
            continue
        if method or flags & 1:
            raise ValueError(f"{name} is not stored plainly")
        local = struct.unpack(LOCAL_FORMAT, _read(file, place, struct.calcsize(LOCAL_FORMAT)))
        if local[0] != LOCAL or packed != plain:
            raise ValueError(f"broken local header of {name}")
        found.append(Member(name, place + struct.calcsize(LOCAL_FORMAT) + local[9] + local[10], packed))
    return found


# --- WARC ---


def _line(value: str) -> str:
    """A value of one header line: control characters and spaces are written in hexadecimal."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in value)


def _name(page_id: str) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A response, or a revisit of the record ``refers_to``, which has the HTTP header of the payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id or '')}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines if line)}


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header of a record, length of the full payload, and the payload that the record itself holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = memoryview(rest)[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or not head.startswith(b"WARC/"):
        raise ValueError("broken WARC record")
    end = rest.find(b"\r\n\r\n")
    http = _fields(rest[:end])
    return fields, int(http["content-length"]), bytes(block[end + 4 :])


def _page(name: str | None) -> str | None:
    return None if name is None else name.removeprefix("<urn:page:").removesuffix(">") or None


# --- writing ---


def _store(folder: str):
    from pyarrow import fs

    # Hadoop writes file:/x for file:///x
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def with_roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Columns page_id (text), url, payload (bytes), payload_digest (hexadecimal SHA-1) and refers_to (text).

    Of the pages with equal payloads of ``least`` bytes or more, that with the largest page_id is the response,
    and so is every row that repeats this id; the others refer to it. Pages without an id never answer for others.
    Payloads that many pages share are looked up by broadcast: those above ``HOT_COPIES`` copies are at most one
    in that many rows. The rest meets by shuffle if it is too large for a broadcast, at most ``HOT_COPIES`` rows a key.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    long = F.octet_length("payload") >= least
    groups = rows.filter(long).groupBy(F.unhex("payload_digest").alias("digest"))
    shared = groups.agg(
        F.max("page_id").alias("response_id"), F.min("page_id").alias("least_id"), F.count("*").alias("copies"), F.count("page_id").alias("named")
    )
    # a group matters if some row of it is not the response
    shared = shared.filter((F.col("least_id") != F.col("response_id")) | ((F.col("named") > 0) & (F.col("named") < F.col("copies"))))
    shared = materialize(shared.select("digest", "response_id", "copies"), "warc-shared")
    # a key of its own for what has no group, so that nothing gathers under null
    key = F.when(long, F.unhex("payload_digest")).otherwise(F.unhex(F.hex(F.xxhash64("page_id", "payload"))))
    keyed = rows.withColumn("digest", key)
    if shared.count() <= BROADCAST_ROWS:
        found = keyed.join(F.broadcast(shared.drop("copies")), "digest", "left")
    else:
        hot = shared.filter(F.col("copies") > HOT_COPIES).select("digest", F.col("response_id").alias("hot_id"))
        rest = shared.filter(F.col("copies") <= HOT_COPIES).select(F.col("digest").alias("__rest"), "response_id")
        met = keyed.join(F.broadcast(hot), "digest", "left")
        own = F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("page_id", "payload"))))
        found = met.withColumn("__key", own).join(rest, F.col("__key") == F.col("__rest"), "left")
        found = found.withColumn("response_id", F.coalesce("hot_id", "response_id"))
    follows = ~F.col("page_id").eqNullSafe(F.col("response_id"))
    refers_to = F.when(F.col("response_id").isNotNull() & follows, F.col("response_id").cast("string"))
    return found.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "payload_digest", refers_to.alias("refers_to"))


def _key(url: str) -> str:
    """Sort key of an index line: host read from its end, then path."""
    parts = urlsplit(url) if "//" in url else None
    return url if parts is None else ",".join(reversed(parts.netloc.split("."))) + ")" + parts.path + ("?" + parts.query if parts.query else "")


class _Package:
    """One package while it is written."""

    def __init__(self, folder: str, zip64: bool) -> None:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.stream = store.open_output_stream(f"{root}/{self.path.rsplit('/', 1)[1]}")
        self.zip = PackageWriter(self.stream, zip64)
        self.buffer, self.lines, self.members = bytearray(), [], 0

    def put(self, url: str, kind: str, data: bytes, member_bytes: int) -> None:
        entry = {"url": url, "filename": f"data-{self.members:05d}.warc.gz", "offset": len(self.buffer), "length": len(data), "type": kind}
        self.lines.append(f"{_line(_key(url))} {json.dumps(entry)}")
        self.buffer += data
        if len(self.buffer) >= member_bytes:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            self.zip.add(f"{ARCHIVES}data-{self.members:05d}.warc.gz", bytes(self.buffer))
            self.members += 1
            self.buffer = bytearray()

    def close(self) -> tuple[str, int, int, int]:
        self.flush()
        self.zip.add(f"{INDEXES}index.cdxj", "".join(line + "\n" for line in sorted(self.lines)).encode())
        size = self.zip.close()
        self.stream.close()
        return self.path, size, self.members, len(self.lines)


def _write(folder: str, package_bytes: int, member_bytes: int, level: int, zip64: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        names = [f.split()[0] for f in MANIFEST.split(", ")]

        def done(row) -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(c)[at].as_py() for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))
                package = package or _Package(folder, zip64)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, payload, digest, refers_to)) + packer.flush()
                package.put(url or "", "response" if refers_to is None else "revisit", data, member_bytes)
                if package.zip.at >= package_bytes or len(package.lines) >= PACKAGE_RECORDS:
                    yield done(package.close())
                    package = None
        if package is not None:
            yield done(package.close())

    return run


def write_packages(
    pages: DataFrame,
    folder: str | None = None,
    package_bytes: int = PACKAGE_BYTES,
    member_bytes: int = MEMBER_BYTES,
    level: int = LEVEL,
    zip64: bool = False,
) -> DataFrame:
    """Write one record per row and return the manifest of the packages: package, bytes, members, records.

    ``pages`` needs page_id, url and html; other columns are left out. A null html is an empty payload, a null url
    leaves its header out, a null page_id gives a record without a number. Repeated rows are written again. An
    empty table gives no package. ``folder`` must be one that every executor reaches; without it, a new one below
    ``spark.checkpoint.dir``. The manifest lies there too.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = with_roles(pages)
    return materialize(rows.mapInArrow(_write(folder, package_bytes, member_bytes, level, zip64), MANIFEST), "warc-manifest")


# --- reading ---


def _open(path: str):
    store, name = _store(path)
    return store.open_input_file(name)


def _cover(places: list[tuple[int, int]], most: int) -> Iterator[list[tuple[int, int]]]:
    """Runs of records that lie side by side, of at most ``most`` bytes unless one record is longer."""
    run: list[tuple[int, int]] = []
    for offset, length in sorted(places):
        if run and (offset != run[-1][0] + run[-1][1] or offset + length - run[0][0] > most):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def _ranges(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column("package").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                rows = []
                with _open(path) as file:
                    found = members(file, length)
                    index = defaultdict(list)
                    for member in (m for m in found if m.name.startswith(INDEXES)):
                        for line in _read(file, member.start, member.size).decode().splitlines():
                            entry = json.loads(line[line.index("{") :])
                            index[ARCHIVES + entry["filename"]].append((int(entry["offset"]), int(entry["length"])))
                for member in (m for m in found if m.name.startswith(ARCHIVES)):
                    if member.name not in index:
                        rows.append((path, member.name, member.start, member.start + member.size, [], []))
                    for part in _cover(index[member.name], range_bytes):
                        first, last = part[0][0], sum(part[-1])
                        if last > member.size:
                            raise ValueError(f"the index of {path} points behind {member.name}")
                        rows.append((path, member.name, member.start + first, member.start + last, [o for o, _ in part], [n for _, n in part]))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = [f.split()[0] for f in RANGES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _walk(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every gzip member of a range, read in blocks."""
    at, begun, unpacker, parts = start, start, zlib.decompressobj(31), []
    left = b""
    while left or at < stop:
        if not left:
            left = _read(file, at, min(BLOCK_BYTES, stop - at))
            at += len(left)
        parts.append(unpacker.decompress(left))
        left = unpacker.unused_data
        if unpacker.eof:
            yield begun - start, b"".join(parts)
            begun, unpacker, parts = at - len(left), zlib.decompressobj(31), []
    if parts:
        raise ValueError("an archive member ends inside a record")


def _records(payload: bool):
    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * payload
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()] + [pa.binary()] * payload

    def one(path: str, member: str, offset: int, data: bytes) -> tuple:
        fields, size, body = parse(data)
        kind, stated = fields["warc-type"], base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        held = kind == "response"
        digest = hashlib.sha1(body).hexdigest() if held else stated
        intact = digest == stated and (not held or len(body) == size)
        row = (path, member, offset, kind, _page(fields["warc-record-id"]), fields.get("warc-target-uri"), _page(fields.get("warc-refers-to")), digest, size, intact)
        return (*row, body if held else None) if payload else row

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                with _open(r["package"]) as file:
                    if r["offsets"]:
                        data = memoryview(_read(file, r["start"], r["stop"] - r["start"]))
                        first = r["offsets"][0]
                        found = ((o, zlib.decompress(data[o - first : o - first + n], 31)) for o, n in zip(r["offsets"], r["lengths"], strict=True))
                    else:
                        found = _walk(file, r["start"], r["stop"])
                    for offset, plain in found:
                        rows.append(one(r["package"], r["member"], offset, plain))
                        held += len(plain)
                        if held > BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_packages(manifest: DataFrame, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the packages of a manifest (package, bytes), with :data:`RECORDS` and, if asked for, ``payload``.

    ``payload_digest`` is computed from the payload where the record holds it, else the stated one (a revisit);
    ``intact`` says whether it is the stated one and the length agrees. ``payload_bytes`` is that of the full
    payload in both cases, ``payload`` is null for a revisit. Broken packages, archives that are packed and indexes
    that point outside their archive are errors. No package is unpacked, and no task reads more than a range at once.
    """
    found = manifest.select("package", "bytes").mapInArrow(_ranges(range_bytes), RANGES)
    schema = RECORDS + (", payload binary" if payload else "")
    # ranges are tiny rows that stand for much reading: the number of tasks follows the bytes they point at
    tasks = max(1, -(-(manifest.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    return found.repartition(tasks, "package", "start").mapInArrow(_records(payload), schema)
