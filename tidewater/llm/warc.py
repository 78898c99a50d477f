"""Operator 12, from legacy ARC archives to WARC archives and back to rows.

An ARC file is a version block and then records: one header line, as many bytes as it declares, a line break. Version 1
has five fields on the line, version 2 ten (status, checksum, location, offset and file name besides). The converter
reads the fields from the right, as addresses may hold spaces, and makes for every record what WARC wants and ARC lacks:
an identifier (a version-5 UUID of the record's file and offset), a date in ISO form from one of 8 to 14 digits, a type
(response if the block is an HTTP answer, warcinfo for version blocks, resource for the rest) and SHA-1 digests in base 32 of
block and payload. A record whose payload another one has as well becomes a revisit of the one with the smallest page_id and
keeps its HTTP header alone.

Payloads never travel through a shuffle. Reading the ARC files gives an index (file, offset, length, digests), the first
record of each payload is told from the index, and the tasks that write WARC seek each record in its ARC file. Archives are
gzip members, a record each, of at most FILE_BYTES and one record more, in the shared checkpoint folder; tasks write them
under names of their own, and a table of the files that committed tasks have written says which count, so that a lost
executor or a second attempt leaves nothing double. Read and written by pyarrow's file systems, in bounded buffers.

Very long payloads are in memory one at a time. Ties: of rows with the same smallest page_id one is the response. Nulls: a
null html is an empty payload, a null url is about:blank, and a null page_id is response only if no row with an id has
the payload; it has refers_to null then as well. Repeated rows are records each. Empty tables give no rows and no files.
Columns besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import batch, discard_folder, map_batches, materialize, new_folder, read_table, tasks

#: Compressed bytes after which a task begins a new file.
FILE_BYTES = 64 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
READ_BYTES = 1 << 16
LEVEL = 4

# Fixed values of the two formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}

#: The date of pages that have none.
DATE = "19960101000000"
PAGE_HEADER = b"X-Page-Id"


class Bytes:
    """The bytes of an archive, plain or of gzip members, in order. at: where in the file the record at hand begins; place: what
    of the file has been used up."""

    def __init__(self, raw: BinaryIO, at: int = 0):
        self.raw, self.ready, self.place, self.at = raw, b"", at, at
        self.head = raw.read(READ_BYTES)
        self.packed = self.head[:2] == b"\x1f\x8b"
        self.inflate = None

    def _more(self) -> bool:
        """Get some bytes ready; False at the end."""
        while True:
            if not self.head:
                self.head = self.raw.read(READ_BYTES)
            if not self.head:
                if self.inflate is not None:
                    raise ValueError(f"the archive ends inside the member at {self.at}")
                return False
            if not self.packed:
                self.ready, self.head = self.ready + self.head, b""
                return True
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            took = len(self.head)
            got = self.inflate.decompress(self.head)
            self.head = self.inflate.unused_data
            self.place += took - len(self.head)
            if self.inflate.eof:
                self.inflate = None
            if got:
                self.ready += got
                return True

    def begin(self) -> bool:
        """Go to the next record, past empty lines; False if there is none."""
        while True:
            if not self.ready:
                self.at = self.place
                if not self._more():
                    return False
            rest = self.ready.lstrip(b"\r\n")
            if not self.packed:
                self.place += len(self.ready) - len(rest)
                self.at = self.place
            self.ready = rest
            if rest:
                return True

    def line(self) -> bytes:
        """A line without its break."""
        while b"\n" not in self.ready:
            if not self._more():
                raise ValueError(f"no end of a header line in the record at {self.at}")
        out, _, self.ready = self.ready.partition(b"\n")
        if not self.packed:
            self.place += len(out) + 1
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        """Exactly n bytes."""
        parts, have = [self.ready], len(self.ready)
        while have < n:
            self.ready = b""
            if not self._more():
                raise ValueError(f"the record at {self.at} declares {n} bytes and has {have}")
            parts.append(self.ready)
            have += len(self.ready)
        whole = b"".join(parts)
        self.ready = whole[n:]
        if not self.packed:
            self.place += n
        return whole[:n]

    def close_member(self) -> int:
        """The place behind the record: that of the next member, or of the next byte."""
        while self.packed and self.inflate is not None:
            if not self._more():
                break
        return self.place


class Record(NamedTuple):
    """A record of an ARC file."""

    at: int
    end: int
    version: int
    url: str
    ip: str
    date: str
    mime: str
    status: int | None
    block: bytes


def arc_fields(line: bytes, version: int) -> tuple[str, str, str, str, int | None, int]:
    """url, IP address, date, content type, status and length of a header line."""
    want = len(FIELDS[version].split())
    parts = line.decode("utf-8", "replace").rsplit(" ", want - 1)
    if len(parts) != want or not parts[-1].isdigit():
        raise ValueError(f"not a header line of version {version}: {line[:200]!r}")
    url, ip, date, mime, *more = parts
    status = int(more[0]) if version == 2 and more[0].isdigit() else None
    return url, ip, date, mime, status, int(parts[-1])


def arc_version(block: bytes) -> int:
    """The version that a version block states on its first line."""
    first = block.split(b"\n", 1)[0].split(b" ")[0].strip()
    if first not in (b"1", b"2"):
        raise ValueError(f"unknown version of an archive: {block[:80]!r}")
    return int(first)


def _record(data: Bytes, version: int) -> Record:
    """The record at hand. A version block's own header line has five fields or ten, and its first line tells the version."""
    at, line = data.at, data.line()
    about = line.startswith(b"filedesc://")
    if not about and not version:
        raise ValueError(f"no version block before {line[:80]!r}")
    url, ip, date, mime, status, n = arc_fields(line, (2 if len(line.split(b" ")) >= len(FIELDS[2].split()) else 1) if about else version)
    block = data.take(n)
    return Record(at, data.close_member(), arc_version(block) if about else version, url, ip, date, mime, status, block)


def arc_records(raw: BinaryIO) -> Iterator[Record]:
    """The records of an ARC file, its version block first."""
    data, version = Bytes(raw), 0
    while data.begin():
        r = _record(data, version)
        version = r.version
        yield r


def arc_record(stored: bytes, at: int, version: int) -> Record:
    """A record from the bytes that stand at a place of a file."""
    data = Bytes(io.BytesIO(stored), at)
    data.begin()
    return _record(data, version)


def iso_date(digits: str) -> str:
    """An archive date of 4 to 14 digits, what is missing being the least, as WARC writes dates."""
    if not digits.isdigit() or not 4 <= len(digits) <= 14:
        raise ValueError(f"not an archive date: {digits!r}")
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its empty line, and the payload. Old servers end lines with a bare line feed."""
    ends = [(k, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (k := block.find(mark)) >= 0]
    if not ends:
        return block, b""
    k, n = min(ends)
    return block[: k + n], block[k + n :]


def warc_type(r: Record) -> str:
    if r.url.startswith("filedesc://"):
        return "warcinfo"
    return "response" if r.block.startswith(b"HTTP/") else "resource"


def payload(r: Record) -> bytes:
    return split_http(r.block)[1] if warc_type(r) == "response" else r.block


def header_value(header: bytes, name: bytes) -> str | None:
    """The first value of a header's field; names count without case."""
    for line in header.split(b"\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC has it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(path: str, at: int) -> str:
    """The identifier of the record that stands at a place of an ARC file."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{at}')}>"


def warc_record(head: dict[str, str | None], block: bytes) -> bytes:
    """A record of WARC 1.1; fields that are None are left out."""
    head = head | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def converted(r: Record, path: str, first: dict | None) -> bytes:
    """The WARC record of an ARC record; first tells url, date and id of the response with the same payload, if it isn't this."""
    kind, own = warc_type(r), record_id(path, r.at)
    head = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": iso_date(r.date), "WARC-Target-URI": r.url, "WARC-IP-Address": None if r.ip in ("0.0.0.0", "-", "") else r.ip}
    if kind == "warcinfo":
        head = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": iso_date(r.date), "WARC-Filename": path.rpartition("/")[2], "Content-Type": "text/plain"}
        return warc_record(head, r.block)
    body, block = payload(r), r.block
    head["WARC-Payload-Digest"] = f"sha1:{digest(body)}"
    head["Content-Type"] = "application/http; msgtype=response" if kind == "response" else r.mime
    if first is not None and kind == "response":
        head |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": first["id"], "WARC-Refers-To-Target-URI": first["url"], "WARC-Refers-To-Date": iso_date(first["date"])}
        block = split_http(block)[0]
    return warc_record(head, block)


def warc_records(raw: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; digests are checked."""
    data = Bytes(raw)
    while data.begin():
        if not data.line().startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {data.at}")
        head: dict[str, str] = {}
        while line := data.line():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        block = data.take(int(head["content-length"]))
        if head.get("warc-block-digest", "").removeprefix("sha1:") not in ("", digest(block)):
            raise ValueError(f"the block of the record at {data.at} isn't what its digest says")
        yield head, block


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of an address, and the path there."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Writer:
    """Files of gzip members, a record each, in a folder; a new one after FILE_BYTES. first(name) gives what begins a file."""

    def __init__(self, folder: str, ending: str, first: Callable[[str], bytes], most: int = FILE_BYTES):
        self.folder, self.ending, self.first, self.most = folder, ending, first, most
        self.system, self.root = opened(folder)
        self.out, self.done = None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.system.create_dir(self.root, recursive=True)
            name = f"{uuid.uuid4().hex}.{self.ending}.gz"  # of this attempt alone
            self.out, self.name, self.records, self.size = self.system.open_output_stream(f"{self.root}/{name}", compression=None), f"{self.folder}/{name}", 0, 0
            self._put(self.first(name))
        self._put(record)
        self.records += 1
        if self.size >= self.most:
            self.close()

    def _put(self, record: bytes) -> None:
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = squeeze.compress(record) + squeeze.flush()
        self.out.write(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


FILES = "path string, records long, bytes long"
FILES_ARROW = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _files(writer: Writer) -> pa.RecordBatch:
    writer.close()
    return batch(FILES_ARROW, *(list(zip(*writer.done, strict=True)) or [[]] * 3))


def arc_head(name: str, version: int) -> bytes:
    """The version block of a file."""
    body = f"{version} 0 tidewater\n{FIELDS[version]}\n\n".encode()
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def page_record(page_id: int | None, url: str | None, html: str | None, version: int, name: str = "-") -> bytes:
    """A page as a record of an ARC file: an HTTP answer that names the page's id."""
    body = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
    head += "" if page_id is None else f"{PAGE_HEADER.decode()}: {page_id}\r\n"
    block = head.encode() + b"\r\n" + body
    where = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")
    more = f" 200 {hashlib.md5(body).hexdigest()} - 0 {name}" if version == 2 else ""
    return f"{where} 0.0.0.0 {DATE} text/html{more} {len(block)}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, folder: str, versions: tuple[int, ...] = (1, 2), most: int = FILE_BYTES) -> DataFrame:
    """Pages as ARC files in a folder, and the table of them (path, records, bytes). A task writes one version, tasks take
    turns."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = versions[TaskContext.get().partitionId() % len(versions)]
        writer = Writer(folder, "arc", lambda name: arc_head(name, version), most)
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                writer.add(page_record(page_id, url, html, version))
        yield _files(writer)

    of = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialize(map_batches(of, kernel, FILES), "arc-files")


INDEX = "path string, at long, size long, version int, url string, date string, kind string, page_id long, n long, same binary"
INDEX_ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary())])
ROWS = 2000


def _in_batches(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch(schema, *zip(*held, strict=True))
            held = []
    if held:
        yield batch(schema, *zip(*held, strict=True))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for b in batches:
        yield from b["path"].to_pylist()


def _whole_number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for path in _paths(batches):
            system, p = opened(path)
            with system.open_input_stream(p, compression=None) as raw:
                for r in arc_records(raw):
                    body, kind = payload(r), warc_type(r)
                    page = header_value(split_http(r.block)[0], PAGE_HEADER) if kind == "response" else None
                    yield path, r.at, r.end - r.at, r.version, r.url, r.date, kind, _whole_number(page), len(body), hashlib.sha256(body).digest()

    return _in_batches(INDEX_ARROW, rows())


def arc_index(files: DataFrame) -> DataFrame:
    """Where every record of the ARC files (path) stands, and what tells equal payloads: their SHA-256."""
    return materialize(map_batches(files.select("path").repartition(tasks(files.sparkSession), "path"), _index, INDEX), "arc-index")


def first_of_payload(index: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The index with first_path, first_at, first_url and first_date of the response that a record repeats, or null."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "at", "url", "date")
    answers = index.filter((F.col("kind") == "response") & (F.col("n") >= least_bytes))
    firsts = answers.groupBy("same").agg(F.min(order).alias("f"), F.count("*").alias("c")).filter("c > 1")
    # a table of its own, so that both sides of the join are plain shuffles and one very common payload can be split
    firsts = materialize(firsts.select(F.col("same").alias("same_as"), *(F.col(f"f.{c}").alias(f"first_{c}") for c in ("path", "at", "url", "date"))), "arc-firsts")
    joined = index.join(firsts, (index.same == firsts.same_as) & (index.kind == "response"), "left")
    itself = (F.col("path") == F.col("first_path")) & (F.col("at") == F.col("first_at"))
    keep = lambda c: F.when(~itself, F.col(c)).alias(c)
    return materialize(joined.select("path", "at", "size", "version", *(keep(f"first_{c}") for c in ("path", "at", "url", "date"))), "arc-plan")


def write_warc(plan: DataFrame, folder: str, most: int = FILE_BYTES) -> DataFrame:
    """The records of a plan of first_of_payload as WARC files in a folder, and the table of these."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"software: tidewater\r\nformat: WARC File Format 1.1\r\n"
        info = lambda name: warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, 0), "WARC-Date": iso_date(DATE), "WARC-Filename": name, "Content-Type": "application/warc-fields"}, about)
        writer, now, raw = Writer(folder, "warc", info, most), None, None
        for b in batches:
            for row in b.to_pylist():
                if row["path"] != now:
                    now, place = row["path"], 0
                    if raw is not None:
                        raw.close()
                    system, p = opened(now)
                    raw = io.BufferedReader(system.open_input_file(p), READ_BYTES)
                if row["at"] != place:  # a task's first record of a file; the others follow each other
                    raw.seek(row["at"])
                stored, place = raw.read(row["size"]), row["at"] + row["size"]
                first = None if row["first_path"] is None else {"id": record_id(row["first_path"], row["first_at"]), "url": row["first_url"], "date": row["first_date"]}
                writer.add(converted(arc_record(stored, row["at"], row["version"]), now, first))
        if raw is not None:
            raw.close()
        yield _files(writer)

    placed = plan.repartitionByRange(tasks(plan.sparkSession), "path", "at").sortWithinPartitions("path", "at")
    return materialize(map_batches(placed, kernel, FILES), "warc-files")


READ = "record_id string, type string, url string, date string, digest string, refers_to_id string, page_id long, payload_bytes long"
READ_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for path in _paths(batches):
            system, p = opened(path)
            with system.open_input_stream(p, compression=None) as raw:
                for head, block in warc_records(raw):
                    kind, page, n = head["warc-type"], None, len(block)
                    said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind in ("response", "revisit"):
                        http, body = split_http(block)
                        page, n = _whole_number(header_value(http, PAGE_HEADER)), len(body)
                        if kind == "revisit":
                            n = _whole_number(header_value(http, b"Content-Length"))
                        elif digest(body) != said:
                            raise ValueError(f"the payload of {head['warc-record-id']} isn't what its digest says")
                    yield head["warc-record-id"], kind, head.get("warc-target-uri"), head["warc-date"], said, head.get("warc-refers-to"), page, n

    return _in_batches(READ_ARROW, rows())


def read_warc(files: DataFrame) -> DataFrame:
    """record_id, type, url, date, digest, refers_to_id, page_id and payload_bytes (of a revisit: as its HTTP header declares
    them) of every record of the WARC files (path)."""
    return materialize(map_batches(files.select("path").repartition(tasks(files.sparkSession), "path"), _read, READ), "warc-records")


def arc_to_warc(files: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, most: int = FILE_BYTES) -> DataFrame:
    """ARC files (path) as WARC files in a folder; the table of these (path, records, bytes)."""
    return write_warc(first_of_payload(arc_index(files), least_bytes), folder, most)


def archived_pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (page_id of the response) of the pages among
    records of read_warc."""
    pages = records.filter(F.col("type").isin("response", "revisit"))
    # only responses that are referred to; both sides are plain shuffles of written tables
    to = records.filter("type = 'response' and page_id is not null").select(F.col("record_id").alias("_to"), F.col("page_id").alias("refers_to"))
    joined = pages.join(to, pages.refers_to_id == to._to, "left")
    return joined.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    files = arc_to_warc(write_arc(read_table(spark, sf_dir, "pages"), arc), warc)
    records = read_warc(files)
    discard_folder(spark, arc)
    discard_folder(spark, warc)
    return archived_pages(records)


#: Base 32 of the SHA-1: five bits a letter, from the hexadecimal digits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: right('000' || bin(('0x' || substr(x, i::INTEGER + 1, 1))::UTINYINT), 4)), '') AS bits FROM d)
SELECT page_id, n AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i::INTEGER + 1, 1)::INTEGER + 8 * substr(bits, 5 * i::INTEGER + 2, 1)::INTEGER
        + 4 * substr(bits, 5 * i::INTEGER + 3, 1)::INTEGER + 2 * substr(bits, 5 * i::INTEGER + 4, 1)::INTEGER + substr(bits, 5 * i::INTEGER + 5, 1)::INTEGER, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
