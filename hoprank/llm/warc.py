"""WARC records in ZIP packages, read by byte ranges without extraction.

A package is a ZIP file with two stored (uncompressed) members, as web archive
packages have them: ``archive/data.warc.gz``, a gzip member per record, and
``indexes/index.cdx``, a line per record with its offset and length.  Each writing
task streams one package to shared storage under a name of its own attempt; only the
names that the job has committed count, so a lost executor or a repeated task leaves
nothing but an unread file.

Reading: the tail of each file gives the end-of-central-directory record or, for more
than 65,534 members or 4 GB, the ZIP64 one; the central directory gives the members,
their local headers the data; the index members give the records.  Record ranges are
dealt over the tasks in runs of about SPLIT bytes, and each run is one range read.

Records with equal payloads of at least REVISIT_LEAST bytes are written once: the one
with the largest page_id is the response, the others revisit it.

Defined results: null html is an empty payload; a null url leaves out the target URI;
rows that share the largest page_id of a payload are all responses; a null page_id
counts as smaller than any other; other columns are not written; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

REVISIT_LEAST = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Repeated payloads whose digests every task may hold (about 40 MB); with more of them the rows are laid out by digest.
REPEATED_ROWS = 300_000
#: Bytes of records that a reading task fetches at once.
SPLIT = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WRITTEN = "path string, records long, bytes long"
RANGES = "path string, start long, sizes array<long>"
READ = ("page_id long, record_id string, record_type string, refers string, url string, payload_bytes long,"
        " payload_digest string, sound boolean")


# ---------------------------------------------------------------- writing

def _record_id(page_id) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the record of ``refers_to``."""
    kind = "response" if refers_to is None else "revisit"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_record_id(page_id)}>"), ("WARC-Date", DATE),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        clean = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.insert(2, ("WARC-Target-URI", clean))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_record_id(refers_to)}>")]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def write_package(stream, records: Iterator[tuple[str, bytes]]) -> int:
    """Stream (record id, record) into a package; the number of records."""
    lines, at = [], 0
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(DATA, "w", force_zip64=True) as member:
            for name, raw in records:
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                member.write(packed)
                lines.append(json.dumps({"id": name, "offset": at, "length": len(packed)}))
                at += len(packed)
        with z.open(INDEX, "w", force_zip64=True) as member:
            for k in range(0, len(lines), 1000):
                member.write(("\n".join(lines[k:k + 1000]) + "\n").encode())
    return len(lines)


def _writer(folder: str):
    def run(batches):
        from uuid import uuid4

        def records():
            for rb in batches:
                for page_id, url, body, digest, refers_to in zip(*(rb.column(c) for c in (
                        "page_id", "url", "body", "digest", "refers_to"))):
                    page_id = page_id.as_py()
                    yield _record_id(page_id), record(page_id, url.as_py(), body.as_py(), digest.as_py(), refers_to.as_py())

        fs, path = pafs.FileSystem.from_uri(folder)
        name = f"pages-{uuid4().hex}.wacz"
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{name}") as out:
            n = write_package(out, records())
            size = out.tell()
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})
    return run


def told(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """The rows with payload, digest and, for revisits, the page that they refer to.

    Only the digests of payloads that occur again are told to the rows: payloads are neither shuffled nor sorted,
    and a large group of copies stays where it was read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        C.body(F.col("html")).alias("body")).withColumn("digest", F.sha1("body"))
    large = rows.filter(F.length("body") >= least)
    last = (large.groupBy(F.col("digest").alias("_d")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1").drop("n"))
    last = C.written(last, "repeated")
    if last.count() <= REPEATED_ROWS:
        last = F.broadcast(last)
    return rows.join(last, (F.col("digest") == F.col("_d")) & (F.length("body") >= least), "left").withColumn(
        "refers_to", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).select(
        "page_id", "url", "body", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_LEAST) -> DataFrame:
    """Write a record per row; path, records and bytes of each committed package."""
    return C.written(told(pages, least).mapInArrow(_writer(folder), WRITTEN), "packages")


# ---------------------------------------------------------------- the directory of a package

class Member:
    def __init__(self, name: str, method: int, size: int, header: int):
        self.name, self.method, self.size, self.header = name, method, size, header


def directory(f, size: int) -> list[Member]:
    """The members that the central directory of a ZIP file lists (``f``: read_at(nbytes, offset))."""
    tail_at = max(0, size - 65557)                       # the end record and the longest comment
    tail = f.read_at(size - tail_at, tail_at)
    end = len(tail) - 22
    while end >= 0 and not (tail[end:end + 4] == b"PK\x05\x06"
                            and end + 22 + int.from_bytes(tail[end + 20:end + 22], "little") == len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end + 3)
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    begin = tail_at + end                                # where the directory's end is
    where = begin - 20
    locator = f.read_at(20, where) if where >= 0 else b""
    if locator[:4] == b"PK\x06\x07":
        at = int.from_bytes(locator[8:16], "little")
        record64 = f.read_at(56, at)
        if record64[:4] != b"PK\x06\x06":                # data stands before the archive: the record ends at the locator
            at = where - 56
            record64 = f.read_at(56, at)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where its locator says")
        count, length, start = struct.unpack("<QQQ", record64[32:56])
        begin = at
    shift = begin - length - start                       # bytes that stand before the archive
    raw, at, out = f.read_at(length, start + shift), 0, []
    for _ in range(count):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, = struct.unpack("<H", raw[at + 10:at + 12])
        packed, plain, n, extra, comment = struct.unpack("<IIHHH", raw[at + 20:at + 34])
        header, = struct.unpack("<I", raw[at + 42:at + 46])
        name = raw[at + 46:at + 46 + n].decode("utf-8", "replace")
        fields = raw[at + 46 + n:at + 46 + n + extra]
        while len(fields) >= 4:
            kind, width = struct.unpack("<HH", fields[:4])
            if kind == 1:                                # ZIP64: the values that don't fit, in this order
                wide = fields[4:4 + width]
                values = [int.from_bytes(wide[i:i + 8], "little") for i in range(0, len(wide) - 7, 8)]
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header = values.pop(0) if header == 0xFFFFFFFF else header
            fields = fields[4 + width:]
        out.append(Member(name, method, packed, header + shift))
        at += 46 + n + extra + comment
    return out


def data_start(f, m: Member) -> int:
    """Where a stored member's bytes begin: behind its local header."""
    head = f.read_at(30, m.header)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {m.name}")
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed; only stored members can be read by ranges")
    name, extra = struct.unpack("<HH", head[26:30])
    return m.header + 30 + name + extra


# ---------------------------------------------------------------- reading

def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _index(batches):
    """Runs of neighbouring records of each package: path, first byte, record lengths."""
    for rb in batches:
        for path in rb.column("path").to_pylist():
            with _open(path) as f:
                members = {m.name: m for m in directory(f, f.size())}
                base = data_start(f, members[DATA])
                at, to = data_start(f, members[INDEX]), members[INDEX].size
                to, rest, start, sizes, total = at + to, b"", None, [], 0
                while at < to:
                    piece = rest + f.read_at(min(SPLIT, to - at), at)
                    at += min(SPLIT, to - at)
                    *lines, rest = piece.split(b"\n")
                    for line in lines:
                        entry = json.loads(line)
                        if start is None:
                            start = base + entry["offset"]
                        sizes.append(entry["length"])
                        total += entry["length"]
                        if total >= SPLIT:
                            yield _run(path, start, sizes)
                            start, sizes, total = None, [], 0
                if sizes:
                    yield _run(path, start, sizes)


def _run(path: str, start: int, sizes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()),
                                       pa.array([sizes], pa.list_(pa.int64()))], names=["path", "start", "sizes"])


def parse(raw: bytes) -> dict:
    """A record's fields: its payload's length and digest, or for a revisit the digest that it names."""
    head, _, block = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = block[:int(field["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    named = base64.b32decode(field["warc-payload-digest"].removeprefix("sha1:")).hex()
    own = hashlib.sha1(payload).hexdigest() if field["warc-type"] == "response" else None
    name = field["warc-record-id"].strip("<>")
    page = name.rpartition(":")[2]
    return {"page_id": None if page == "null" else int(page), "record_id": name, "record_type": field["warc-type"],
            "refers": field.get("warc-refers-to", "").strip("<>") or None, "url": field.get("warc-target-uri"),
            "payload_bytes": len(payload) if own else None, "payload_digest": own or named,
            "sound": own in (None, named), "payload": payload}


def _records(batches):
    for rb in batches:
        for path, start, sizes in zip(*(rb.column(c).to_pylist() for c in ("path", "start", "sizes"))):
            with _open(path) as f:
                raw, at, rows = f.read_at(sum(sizes), start), 0, []
                for size in sizes:
                    rows.append(parse(zlib.decompress(raw[at:at + size], 31)))
                    rows[-1].pop("payload")
                    at += size
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                (c, pa.bool_() if c == "sound" else pa.int64() if c in ("page_id", "payload_bytes") else pa.string())
                for c in ("page_id", "record_id", "record_type", "refers", "url", "payload_bytes", "payload_digest",
                          "sound")]))


def read_archives(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """The records of the packages named in column ``path``; raises if a digest isn't that of the payload."""
    ranges = C.written(packages.select("path").repartition("path").mapInArrow(_index, RANGES), "ranges")
    rows = ranges.repartition("path", "start").mapInArrow(_records, READ)
    return rows.withColumn("payload_bytes", F.when(F.col("sound"), F.col("payload_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("payload digest does not match in "), "record_id")).cast("long"))).drop("sound")


def resolve(records: DataFrame) -> DataFrame:
    """Give revisits the payload length of the response that they refer to."""
    wanted = records.filter("record_type = 'revisit'").select(F.col("refers").alias("_w"), F.col("payload_digest").alias("_x")).distinct()
    target = (records.filter("record_type = 'response'")
              .join(wanted, (F.col("record_id") == F.col("_w")) & (F.col("payload_digest") == F.col("_x")), "left_semi")
              .groupBy(F.col("record_id").alias("_r"), F.col("payload_digest").alias("_p"))
              .agg(F.max("payload_bytes").alias("_n"), F.max("page_id").alias("refers_to")))
    return records.join(target, (F.col("refers") == F.col("_r")) & (F.col("payload_digest") == F.col("_p")), "left").select(
        "page_id", F.coalesce("payload_bytes", "_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def warc_query(spark, sf_dir: str) -> DataFrame:
    packages = write_archives(C.table(spark, sf_dir, "pages"), C.scratch_path(spark, "archives"))
    return resolve(C.written(read_archives(spark, packages), "records"))


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d FROM pages),
l AS (SELECT d, max(page_id) m, count(*) c FROM p WHERE n >= {REVISIT_LEAST} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) payload_bytes, p.d AS payload_digest,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM m THEN m END refers_to
FROM p LEFT JOIN l ON l.d = p.d AND p.n >= {REVISIT_LEAST}
"""
