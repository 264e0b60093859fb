"""WARC records in ZIP packages, read by ranges without extraction.

A package is a ZIP archive of stored members: ``archive/*.warc.gz`` (each record
a gzip member of its own), ``indexes/index.cdxj`` (one line for each record:
key, time, JSON with file name, offset, length, digest) and ``datapackage.json``.
The reader takes packages of any writer: it parses the central directory (with
ZIP64), finds the members' data, reads plain indexes and gzipped ones (by the
ranges of their ``.idx`` where there is one), and reads single records by their
offsets in the index. An archive that no index names is an error.

Packages lie in any store that pyarrow opens by URI; a path without a scheme is
qualified by Spark's default file system first. Each writing task makes
files under new names and returns them; only returned files count, so a repeated
task leaves no double records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import NULL_ID, fresh_path, lookup, written

PACKAGE_BYTES = 64 << 20
SLICE_BYTES = 4 << 20
#: A fixed capture time for pages that carry none.
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ------------------------------------------------------------------ records

def target_uri(url: str | None, page_id: int) -> str:
    """The url with white space, control and other characters that no URI has in percent form."""
    return urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"


def record(kind: str, page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record with its block; a revisit has the HTTP head only."""
    target = target_uri(url, page_id)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", target), ("WARC-Date", date),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    else:
        block += payload
    head.append(("Content-Length", str(len(block))))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut short")
    return fields, rest[:size]


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


# ----------------------------------------------------------------- ZIP reading

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class ZipDirectory:
    """The members of a ZIP archive, from read(offset, length) and the archive's size."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._members()}

    def _end(self) -> tuple[int, int, int]:
        """Number of entries, size and offset of the central directory."""
        tail_at = max(0, self.size - 22 - 65535)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            (where,) = struct.unpack_from("<Q", locator, 8)
            end = self.read(where, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, offset = struct.unpack_from("<QQQ", end, 32)
        return count, length, offset

    def _members(self):
        count, length, offset = self._end()
        body, at = self.read(offset, length), 0
        for _ in range(count):
            if body[at:at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", body, at + 10)
            stored, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", body, at + 20)
            header, = struct.unpack_from("<I", body, at + 42)
            flags, = struct.unpack_from("<H", body, at + 8)
            name = body[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = body[at + 46 + n_name:at + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: only the saturated fields, in this order
                    wide, w = extra[e + 4:e + 4 + n], 0
                    if size == 0xFFFFFFFF:
                        size, w = struct.unpack_from("<Q", wide, w)[0], w + 8
                    if stored == 0xFFFFFFFF:
                        stored, w = struct.unpack_from("<Q", wide, w)[0], w + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", wide, w)[0]
                e += 4 + n
            yield Member(name, method, size, stored, header)
            at += 46 + n_name + n_extra + n_comment

    def data_offset(self, member: Member) -> int:
        """Where a stored member's bytes begin."""
        if member.method:
            raise ValueError(f"{member.name} is compressed; ranges need stored members")
        local = self.read(member.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + n_name + n_extra


class Opened:
    """A file in any store, read by ranges."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.size = fs.get_file_info(path).size
        self.file = fs.open_input_file(path)

    def read(self, offset: int, length: int) -> bytes:
        got = self.file.read_at(length, offset)
        if len(got) != length:
            raise ValueError("a range ends after the file")
        return got


def qualified(spark, path: str) -> str:
    """The path with its scheme: the same place on the driver and on every executor."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:/"):
        uri = uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


# ----------------------------------------------------------------- writing

class PackageWriter:
    """Streams records into one package; the index is kept until the end."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.warc = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, raw: bytes, url: str | None, page_id: int, digest: str, kind: str) -> None:
        body = gzip_member(raw)
        self.warc.write(body)
        entry = {"url": target_uri(url, page_id), "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200",
                 "digest": f"sha1:{digest}", "offset": self.at, "length": len(body), "filename": "data.warc.gz"}
        self.lines.append(f"{entry['url']} 19700101000000 {json.dumps(entry)}")
        self.at += len(body)

    def close(self) -> None:
        self.warc.close()
        self.zip.writestr("indexes/index.cdxj", "\n".join(sorted(self.lines)) + "\n")
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [
            {"name": "data.warc.gz", "path": "archive/data.warc.gz", "bytes": self.at}, {"name": "index.cdxj", "path": "indexes/index.cdxj"}]}))
        self.zip.close()
        self.out.close()


def write_packages(pages: DataFrame, path: str | None = None, revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row; the packages written: package, records, bytes.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at
    least revisit_bytes bytes, the rows with the largest page id are responses
    and the others revisit it; smaller payloads are all responses. A null page
    id counts as the least id, a null url becomes urn:page:ID. Repeated rows
    are repeated records. Payloads are told apart by SHA-256 and length; equal
    ones are aggregated before any shuffle, and the rows of a payload that very
    many pages share are spread over all tasks.
    """
    path = qualified(pages.sparkSession, path or fresh_path(pages.sparkSession, "warc"))
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
                        F.unhex(F.sha2(html, 256)).alias("same"))
    newest = written(rows.groupBy("same").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")), "warc-newest")
    rows = lookup(rows, newest.select("same", "newest"), "same", newest.select("same", "n")).select("page_id", "url", "html", "newest")

    def run(batches):
        writer, made = None, None
        for batch in batches:
            for page_id, url, html_, newest_ in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "newest"))):
                if writer is None:
                    made = [f"{path}/{uuid.uuid4().hex}.wacz", 0]
                    writer = PackageWriter(made[0])
                payload = html_.encode()
                digest = sha1_base32(payload)
                kind = "response" if page_id == newest_ or len(payload) < revisit_bytes else "revisit"
                writer.add(record(kind, page_id, url, payload, digest, newest_), url, page_id, digest, kind)
                made[1] += 1
                if writer.at >= PACKAGE_BYTES:
                    writer.close()
                    yield pa.RecordBatch.from_pydict({"package": [made[0]], "records": [made[1]], "bytes": [writer.at]})
                    writer = None
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"package": [made[0]], "records": [made[1]], "bytes": [writer.at]})

    return written(rows.mapInArrow(run, "package string, records long, bytes long"), "warc-packages")


# ----------------------------------------------------------------- reading

INDEXES = (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")


def index_lines(file: Opened, directory: ZipDirectory, uri: str):
    """The lines of all indexes, each with its JSON."""
    members = {n: m for n, m in directory.members.items() if n.startswith("indexes/")}
    for name, member in members.items():
        if not name.endswith(INDEXES):
            continue
        start = directory.data_offset(member)
        if not name.endswith(".gz"):
            parts = [(0, member.size)]
        else:
            plain = name.rpartition("/")[2]
            beside = [m for n, m in members.items() if n.endswith(".idx")]
            lines = [line.split("\t") for m in beside for line in file.read(directory.data_offset(m), m.size).decode("utf-8").splitlines() if line and line[0] != "!"]
            # an .idx line: first key, index file, offset, length, ...
            parts = [(int(f[2]), int(f[3])) for f in lines if len(f) >= 4 and f[1].rpartition("/")[2] == plain] or [(0, member.size)]
        for at, size in parts:
            body = file.read(start + at, size)
            for line in (gunzip(body) if name.endswith(".gz") else body).decode("utf-8").splitlines():
                if line.strip() and not line.startswith("!"):
                    at_json = line.find("{")
                    if at_json < 0:
                        raise ValueError(f"{uri}: {name} has a line without JSON")
                    yield json.loads(line[at_json:])


def gunzip(body: bytes) -> bytes:
    """All members of gzipped bytes."""
    out = []
    while body:
        d = zlib.decompressobj(31)
        out.append(d.decompress(body))
        if not d.eof:
            raise ValueError("gzipped bytes are cut short")
        body = d.unused_data
    return b"".join(out)


def _locate(batches):
    """Runs of neighbouring records in each package: where they begin in the file, and their lengths."""
    for batch in batches:
        for uri in batch.column("package").to_pylist():
            file = Opened(uri)
            directory = ZipDirectory(file.read, file.size)
            entries: dict[str, set[tuple[int, int]]] = {}
            for entry in index_lines(file, directory, uri):
                entries.setdefault(entry["filename"].rpartition("/")[2], set()).add((int(entry["offset"]), int(entry["length"])))
            archives = {n.rpartition("/")[2]: m for n, m in directory.members.items() if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))}
            for name, member in archives.items():
                if member.size and name not in entries:
                    raise ValueError(f"{uri}: no index names the records of {name}")
            for name, places in entries.items():
                if name not in archives:
                    raise ValueError(f"{uri}: an index names {name}, which isn't there")
                start = directory.data_offset(archives[name])
                run: list[tuple[int, int]] = []
                for place in sorted(places):
                    if run and (place[0] != sum(run[-1]) or place[0] - run[0][0] >= SLICE_BYTES):
                        yield _run(uri, start, run)
                        run = []
                    run.append(place)
                if run:
                    yield _run(uri, start, run)


def _run(uri, start, run):
    return pa.RecordBatch.from_pydict({"package": [uri], "offset": [start + run[0][0]], "lengths": [[n for _, n in run]]}, schema=pa.schema([("package", pa.string()), ("offset", pa.int64()), ("lengths", pa.list_(pa.int64()))]))


#: Kinds of records whose block is kept.
WITH_PAYLOAD = ("response", "resource")


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """What a record carries: the body of an HTTP response, or the whole block of other ones."""
    if fields["warc-type"] not in WITH_PAYLOAD:
        return None
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def same_digest(stated: str, payload: bytes) -> bool | None:
    """Whether a stated digest (algorithm:value, in base 32 or hexadecimal) is the payload's; None for an unknown algorithm."""
    kind, _, value = stated.rpartition(":")
    kind = kind.lower().replace("-", "") or "sha1"
    if kind not in hashlib.algorithms_guaranteed or kind.startswith("shake"):
        return None
    raw = hashlib.new(kind, payload, usedforsecurity=False).digest()
    return value.strip().rstrip("=").upper() in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())


def _read(batches):
    for batch in batches:
        for uri, offset, lengths in zip(*(batch.column(c).to_pylist() for c in ("package", "offset", "lengths"))):
            body, at, out = Opened(uri).read(offset, sum(lengths)), 0, []
            for n in lengths:
                raw = body[at:at + n]
                at += n
                fields, block = parse_record(gunzip(raw) if raw[:2] == b"\x1f\x8b" else raw)
                payload, stated = payload_of(fields, block), fields.get("warc-payload-digest")
                if payload is not None:
                    if stated and same_digest(stated, payload) is False:
                        raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
                    digest = sha1_base32(payload)
                else:
                    digest = stated[5:] if stated and stated.lower().startswith("sha1:") else None
                refers = fields.get("warc-refers-to")
                out.append((fields["warc-record-id"].strip("<>"), fields.get("warc-target-uri"), fields["warc-type"], digest, refers.strip("<>") if refers else None, payload))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (*[pa.string()] * 5, pa.binary()))],
                                             ["record_id", "url", "record_type", "payload_digest", "refers_to", "payload"])


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of packages: record_id, url, record_type, payload_digest, refers_to, payload.

    packages has a column package with their URIs (and bytes, if known). Ids
    are the records' own, as text without angle brackets. payload_digest is the
    bare SHA-1 in base 32, computed where there is a payload (of responses and
    resources; others have none), else as the record states it. A payload that
    does not match the digest its record states, an archive without an index and
    a broken package end the job. No package, or one without records: no rows.
    """
    known = "bytes" in packages.columns
    total = (packages.agg(F.sum("bytes")).first()[0] if known else packages.count() * PACKAGE_BYTES) or 0
    places = packages.select("package").repartition(max(1, min(2_000, -(-total // PACKAGE_BYTES) * 4))).mapInArrow(_locate, "package string, offset long, lengths array<long>")
    return places.repartition(max(1, -(-total // SLICE_BYTES))).mapInArrow(_read, "record_id string, url string, record_type string, payload_digest string, refers_to string, payload binary")


def page_number(record_id: str):
    """The page of a record written by write_packages, from the id column; null for other ids."""
    return F.regexp_extract(record_id, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")


def payload_table(records: DataFrame) -> DataFrame:
    """page_id, record_id, payload_bytes, payload_digest, record_type, refers_to, both of the full payload: a revisit has its response's.

    page_id and refers_to are page numbers, null for records of other writers.
    A revisit whose response isn't among the records is no whole record and is
    left out, as are records that are neither.
    """
    rows = written(records.select("record_id", F.octet_length("payload").cast("long").alias("bytes"), "payload_digest", "record_type", "refers_to"), "warc-records")
    responses = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("same")).agg(F.max(F.struct("bytes", "payload_digest")).alias("full"))
    revisits = rows.where("record_type = 'revisit'").withColumn("same", F.col("refers_to"))
    revisits = lookup(revisits, responses, "same", revisits.groupBy("same").agg(F.count("*").alias("n")))
    own = rows.where("record_type = 'response'").withColumn("full", F.struct("bytes", "payload_digest"))
    out = own.unionByName(revisits.select(*rows.columns, "full"))
    null_id = F.lit(NULL_ID)
    return out.select(F.nullif(page_number("record_id"), null_id).alias("page_id"), "record_id", F.col("full.bytes").alias("payload_bytes"), F.col("full.payload_digest").alias("payload_digest"),
                      "record_type", F.nullif(page_number("refers_to"), null_id).alias("refers_to"))
