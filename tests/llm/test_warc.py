import gzip
import hashlib
import io
import json
import zipfile

import pytest

from riskloom.llm import warc
from riskloom.llm.warc import ZipDirectory, parse_record, payload_table, read_packages, record, sha1_base32, write_packages


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, newest string").repartition(2)


ROWS = [(1, "http://a.example/x y?q=é", "<p>same</p>", "c"), (2, None, "<p>same</p>", "c"), (3, "http://b.example/", "<p>other €</p>", None), (4, "u", None, None), (5, "u", "", None),
        (6, "u\r\nWARC-Type: bad", "a\r\n\r\nb WARC/1.1", None), (None, "n", "<p>same</p>", None), (7, "big", "x" * 300_000, None), (3, "http://b.example/", "<p>other €</p>", None), (-4, "m", "<p>low</p>", None)]


def expected(rows, least=0):
    out = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == body]
        newest = max((x for x in ids if x is not None), default=None)
        response = i == newest or len(body) < least
        out.append((i, len(body), sha1_base32(body), "response" if response else "revisit", None if response else newest))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip_of_odd_rows(spark, least):
    packages = write_packages(pages(spark, ROWS), revisit_bytes=least)
    records = read_packages(packages)
    assert sorted((tuple(r) for r in payload_table(records).drop("record_id").collect()), key=str) == expected(ROWS, least)
    assert {r.record_id: bytes(r.payload) for r in records.collect() if r.record_id in ("urn:page:6", "urn:page:7")} == {"urn:page:6": ROWS[5][2].encode(), "urn:page:7": ROWS[7][2].encode()}


def test_empty_table(spark):
    assert payload_table(read_packages(write_packages(pages(spark, [])))).count() == 0


def test_many_small_packages_and_slices(spark, monkeypatch, tmp_path):
    rows = [(i, f"http://h{i}", f"page {i % 7} " * (i % 7 + 1), None) for i in range(60)]
    packages = write_packages(pages(spark, rows), path=str(tmp_path / "out"))
    assert sorted((tuple(r) for r in payload_table(read_packages(packages)).drop("record_id").collect()), key=str) == expected(rows)
    for r in packages.collect():  # any ZIP tool reads a package
        with zipfile.ZipFile(r.package.removeprefix("file:")) as z:
            assert z.testzip() is None and {"archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"} == set(z.namelist())


def test_a_broken_payload_ends_the_read(spark, tmp_path):
    path = str(tmp_path / "bad.wacz")
    writer = warc.PackageWriter(path)
    writer.add(record("response", 1, "u", b"payload", sha1_base32(b"other"), None), "u", 1, "x", "response")
    writer.close()
    with pytest.raises(Exception, match="does not match its digest"):
        read_packages(spark.createDataFrame([(path, 1, 10)], "package string, records long, bytes long")).collect()


FOREIGN = [  # id, type, content type, digest header, block, refers to
    ("urn:uuid:aa-1", "warcinfo", "application/warc-fields", None, b"software: other\r\n", None),
    ("urn:uuid:aa-2", "response", "application/http; msgtype=response", None, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>one</p>", None),
    ("urn:uuid:aa-3", "response", "application/http", "sha256:" + hashlib.sha256(b"two").hexdigest(), b"HTTP/1.1 200 OK\r\n\r\ntwo", None),
    ("urn:uuid:aa-4", "resource", "text/plain", "sha1:" + sha1_base32(b"three").lower(), b"three", None),
    ("urn:uuid:aa-5", "revisit", "application/http", "blake9:xyz", b"HTTP/1.1 200 OK\r\n\r\n", "urn:uuid:aa-3"),
    ("urn:uuid:aa-6", "request", "application/http", None, b"GET / HTTP/1.1\r\n\r\n", None),
    ("urn:uuid:aa-7", "revisit", "application/http", None, b"", "urn:uuid:gone")]


def foreign(path, index, gz=True):
    """A package as another program writes it, with one of several kinds of index."""
    data, entries = b"", []
    for id_, kind, content, digest, block, refers in FOREIGN:
        head = [f"WARC-Record-ID: <{id_}>", f"WARC-Type: {kind}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
        head += [f"WARC-Payload-Digest: {digest}"] * bool(digest) + [f"WARC-Refers-To: <{refers}>"] * bool(refers) + ["WARC-Target-URI: http://x/"] * (kind != "warcinfo")
        raw = ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
        body = gzip.compress(raw) if gz else raw
        entries.append(f"com,x)/{len(entries)} 2020 " + json.dumps({"filename": "a.warc.gz" if gz else "a.warc", "offset": str(len(data)), "length": str(len(body))}))
        data += body
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a.warc.gz" if gz else "archive/a.warc", data)
        if index == "plain":
            z.writestr("indexes/index.cdxj", "\n".join(entries))
        elif index != "none":
            blocks = [gzip.compress("\n".join(entries[i:i + 3]).encode() + b"\n") for i in range(0, len(entries), 3)]
            z.writestr("indexes/index.cdx.gz", b"".join(blocks))
            if index == "idx":
                at, lines = 0, ['!meta 0 {"format": "cdxj-gzip-1.0"}']
                for n, b in enumerate(blocks):
                    lines.append(f"com,x)/{3 * n}\tindex.cdx.gz\t{at}\t{len(b)}\t{n}")
                    at += len(b)
                z.writestr("indexes/index.idx", "\n".join(lines))


@pytest.mark.parametrize("index, gz", [("plain", True), ("gz", True), ("idx", True), ("idx", False)])
def test_packages_of_other_writers(spark, tmp_path, index, gz):
    path = str(tmp_path / "other.wacz")
    foreign(path, index, gz)
    records = read_packages(spark.createDataFrame([(path,)], "package string"))
    rows = {r.record_id: r for r in records.collect()}
    assert len(rows) == len(FOREIGN) and {i: r.record_type for i, r in rows.items()} == {f[0]: f[1] for f in FOREIGN}
    want = {"urn:uuid:aa-2": b"<p>one</p>", "urn:uuid:aa-3": b"two", "urn:uuid:aa-4": b"three"}
    assert {i: bytes(r.payload) for i, r in rows.items() if r.payload is not None} == want
    assert all(rows[i].payload_digest == sha1_base32(b) for i, b in want.items()) and rows["urn:uuid:aa-5"].payload_digest is None
    table = {r.record_id: (r.page_id, r.payload_bytes, r.payload_digest) for r in payload_table(records).collect()}
    assert table == {"urn:uuid:aa-2": (None, 10, sha1_base32(b"<p>one</p>")), "urn:uuid:aa-3": (None, 3, sha1_base32(b"two")), "urn:uuid:aa-5": (None, 3, sha1_base32(b"two"))}


def test_an_archive_without_an_index_is_an_error(spark, tmp_path):
    path = str(tmp_path / "bare.wacz")
    foreign(path, "none")
    with pytest.raises(Exception, match="no index names"):
        read_packages(spark.createDataFrame([(path,)], "package string")).collect()


def test_a_folder_without_a_scheme_is_qualified(spark, tmp_path):
    packages = write_packages(pages(spark, ROWS), path=str(tmp_path / "plain"))
    assert all(r.package.startswith("file:/") for r in packages.collect())


def directory(raw):
    return ZipDirectory(lambda at, n: raw[at:at + n], len(raw))


def archive(comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        for i in range(4):
            z.writestr(f"m{i}", bytes([65 + i]) * (10 + i))
        z.writestr("packed", b"q" * 500, zipfile.ZIP_DEFLATED)
    return out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(monkeypatch, wide):
    if wide:  # sizes, offsets and counts all in ZIP64 fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    for comment in (b"", b"a comment with PK\x05\x06 inside, of some more length"):
        raw = archive(comment)
        assert (b"PK\x06\x06" in raw) == wide
        d = directory(raw)
        assert list(d.members) == ["m0", "m1", "m2", "m3", "packed"]
        for i in range(4):
            m = d.members[f"m{i}"]
            at = d.data_offset(m)
            assert raw[at:at + m.size] == bytes([65 + i]) * (10 + i)
        with pytest.raises(ValueError, match="compressed"):
            d.data_offset(d.members["packed"])


def test_many_entries_need_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(str(i)), b"")
    assert len(directory(out.getvalue()).members) == 66_000


def test_no_archive():
    with pytest.raises(ValueError):
        directory(b"not a zip archive at all, but some bytes")
    with pytest.raises(ValueError):
        parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
