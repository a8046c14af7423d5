"""WARC archives as a PySpark Python data source (``format("warc")``).

Reading plans whole files into partitions of a target size, evaluates filters
on the record type and other header columns right after a record's headers
are parsed, and skips the payload of records that are not wanted without
reading or inflating it. Writing makes one archive per task. The archives of
a commit are listed in a manifest, so files of failed or repeated tasks are
never read.

Paths are opened through ``pyarrow.fs`` (``file:``, ``hdfs:``, ``s3:``...), on
the driver for planning and on executors for the data: they must name shared
storage.

gzip archives have one member per record. Its header carries the ``sl`` extra
field (lengths of the member, packed and unpacked), by which a reader skips
it; members without the field are inflated to find their end.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import materialize

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_length long, headers map<string,string>, payload binary"
)
#: Columns that come from the record's own headers; filters on them are pushed down.
HEADER_COLUMNS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


# ------------------------------------------------------------------ records
def http_head(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP headers (with the length
    of the payload it stands for) and no payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    n = row["payload_length"] if row.get("payload_length") is not None else len(payload)
    block = http_head(n) + (b"" if revisit else payload)
    head = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", row.get("payload_digest")),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", row.get("refers_to")),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)
    lines = b"WARC/1.1\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in head if v is not None)
    return lines + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its packed and unpacked
    lengths. A record of 4 GiB or more does not fit the field and has none."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    packed = 10 + 2 + 12 + len(body) + 8
    if packed >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, packed, len(data))
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(CRLF)[1:]:
        k, sep, v = line.partition(b":")
        if sep:
            out[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


class Unpacked:
    """The unpacked bytes of one gzip member, inflated no further than asked."""

    def __init__(self, f, packed: int | None, header: bytes):
        self.f, self.buf, self.header = f, b"", header
        self.left = None if packed is None else packed - len(header)
        self.z = zlib.decompressobj(-15)

    def fill(self, n: int) -> None:
        while len(self.buf) < n and not self.z.eof:
            step = 16384 if self.left is None else min(16384, self.left)
            raw = self.z.unconsumed_tail or self.f.read(step)
            if not self.z.unconsumed_tail and self.left is not None:
                self.left -= len(raw)
            if not raw:
                raise ValueError("archive ends inside a record")
            self.buf += self.z.decompress(raw, max(n - len(self.buf), 4096))

    def upto(self, mark: bytes) -> bytes:
        at = self.buf.find(mark)
        while at < 0 and not self.z.eof:
            self.fill(len(self.buf) + 4096)
            at = self.buf.find(mark)
        if at < 0:
            raise ValueError("record without an end of headers")
        out, self.buf = self.buf[: at + len(mark)], self.buf[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.buf = self.buf[:n], self.buf[n:]
        return out

    def close(self, f) -> None:
        """To the next member: a seek if the packed length is known."""
        if self.left is not None:
            f.seek(self.left, 1)
            return
        while not self.z.eof:
            self.buf = b""
            self.fill(1 << 20)
        f.seek(8 - len(self.z.unused_data), 1)


class Plain:
    """A record of an archive that is not compressed."""

    def __init__(self, f):
        self.f, self.left = f, 0

    def upto(self, mark: bytes) -> bytes:
        out = b""
        while not out.endswith(mark):
            line = self.f.readline()
            if not line:
                raise ValueError("archive ends inside a record")
            out += line
        return out

    def take(self, n: int) -> bytes:
        return self.f.read(n)


def _gzip_header(f) -> tuple[bytes, int | None] | None:
    head = f.read(10)
    if not head:
        return None
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    packed = None
    if head[3] & 4:
        size = f.read(2)
        extra = f.read(struct.unpack("<H", size)[0])
        head += size + extra
        at = 0
        while at + 4 <= len(extra):
            n = struct.unpack("<H", extra[at + 2 : at + 4])[0]
            if extra[at : at + 2] == b"sl" and n == 8:
                packed = struct.unpack("<I", extra[at + 4 : at + 8])[0]
            at += 4 + n
    for bit in (8, 16):  # file name, comment
        while head[3] & bit:
            c = f.read(1)
            head += c
            if c in (b"\x00", b""):
                break
    if head[3] & 2:
        head += f.read(2)
    return head, packed


def read_records(f, packed: bool, wanted: Callable[[dict], bool], payload: bool) -> Iterator[tuple[dict, int | None, bytes | None]]:
    """(headers, payload length, payload or None) of the wanted records.
    Headers are parsed first; a record that is not wanted costs no more."""
    while True:
        if packed:
            got = _gzip_header(f)
            if got is None:
                return
            rec = Unpacked(f, got[1], got[0])
        else:
            first = f.readline()
            while first == CRLF:
                first = f.readline()
            if not first:
                return
            rec = Plain(f)
        head = rec.upto(CRLF + CRLF) if packed else first + rec.upto(CRLF)
        while not head.endswith(CRLF + CRLF):
            head += rec.upto(CRLF)
        headers = parse_headers(head)
        left = int(headers.get("content-length", 0))
        if wanted(headers):
            size, body = left, None
            if headers.get("content-type", "").startswith("application/http") and left:
                http = rec.upto(CRLF + CRLF)
                left -= len(http)
                size = int(parse_headers(http).get("content-length", left))
            if payload and headers.get("warc-type") != "revisit":
                body, left = rec.take(left), 0
                if len(body) < size and headers.get("warc-truncated") is None:
                    raise ValueError("archive ends inside a payload")
            yield headers, size, body
        if packed:
            rec.close(f)
        else:
            f.seek(left, 1)


# -------------------------------------------------------------- data source
def _filesystem(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


def _holds(f, value: str | None) -> bool:
    if isinstance(f, Not):
        return value is not None and not _holds(f.child, value)
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return value.endswith(f.value)
    return f.value in value  # StringContains


def _can_push(f) -> bool:
    if isinstance(f, Not):
        return isinstance(f.child, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and _can_push(f.child)
    kinds = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
    return isinstance(f, kinds) and f.attribute[0] in HEADER_COLUMNS


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.target = int(options.get("partitionbytes", 64 << 20))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _can_push(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        import pyarrow.fs as pafs

        fs, root = _filesystem(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        manifests = [x.path for x in found if re.fullmatch(r"_committed-.*\.json", x.base_name)]
        listed: set[str] = set()
        for m in manifests:
            with fs.open_input_stream(m) as s:
                listed.update(json.loads(s.read()))
        files = [x for x in found if x.is_file and re.search(r"\.warc(\.gz)?$", x.path) and (not manifests or x.base_name in listed)]
        groups: list[list] = []
        room = 0
        for x in sorted(files, key=lambda x: (-x.size, x.path)):
            if not groups or room < x.size:
                groups.append([])
                room = max(self.target, x.size)
            groups[-1].append(x.path)
            room -= x.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        import pyarrow as pa

        fs, _ = _filesystem(self.path)
        tests = [(HEADER_COLUMNS[(f.child if isinstance(f, Not) else f).attribute[0]], f) for f in self.filters]
        wanted = lambda h: all(_holds(f, h.get(k)) for k, f in tests)
        text, binary = pa.string(), pa.binary()
        schema = pa.schema([(k, text) for k in HEADER_COLUMNS] + [("payload_length", pa.int64()), ("headers", pa.map_(text, text)), ("payload", binary)])
        rows, held = [], 0

        def batch():
            cols = [pa.array([h.get(k) for h, _, _ in rows], text) for k in HEADER_COLUMNS.values()]
            cols += [pa.array([n for _, n, _ in rows], pa.int64()), pa.array([list(h.items()) for h, _, _ in rows], pa.map_(text, text)), pa.array([p for _, _, p in rows], binary)]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for path in partition.paths:
            with fs.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as f:
                for r in read_records(f, path.endswith(".gz"), wanted, self.payload):
                    rows.append(r)
                    held += 400 + len(r[2] or b"")
                    if held > 4 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.level = int(options.get("level", 1))
        self.gzip = str(options.get("compression", "gzip")).lower() == "gzip"

    def write(self, iterator):
        fs, root = _filesystem(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, None
        try:
            for batch in iterator:
                for lo in range(0, batch.num_rows, 256):
                    for row in batch.slice(lo, 256).to_pylist():
                        if out is None:
                            fs.create_dir(root, recursive=True)
                            out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        data = record_bytes(row)
                        out.write(gzip_member(data, self.level) if self.gzip else data)
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages):
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(m.file for m in messages if m and m.file)).encode())

    def abort(self, messages):
        fs, root = _filesystem(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{root}/{m.file}")


class WarcDataSource(DataSource):
    """Options: path; reading: payload (true), partitionBytes (64 MB);
    writing (append): compression (gzip or none), level (1)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("warc archives are appended to a folder; overwrite is not supported")
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known and turns on Spark's filter push-down
    into Python data sources, which it has off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ----------------------------------------------------------------- archives
def page_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """WARC records of pages: of equal payloads of at least ``least`` bytes
    the row with the smallest id is a response and the others revisit it.

    Null html is an empty payload. Rows with a null id are responses unless
    an equal payload has an id; repeated rows with the smallest id are all
    responses. Only payloads that occur at least twice enter the join, as a
    written table whose size decides between a broadcast and a shuffle."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    groups = p.where(F.col("payload_length") >= least).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(groups.where((F.col("n") > 1) & F.col("first_id").isNotNull()).select("d", "first_id"), "warc-repeated")
    j = p.join(repeated, p["digest"] == repeated["d"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return j.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.lit(date).alias("date"),
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(records: DataFrame, path: str, **options: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
