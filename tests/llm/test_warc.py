import base64
import hashlib
import zipfile

from sitetally.llm import warc_zip

PAGES = [(1, "http://a.example/é x\r\ny", "<p>one</p>"), (2, "http://b.example", "<p>one</p>"), (3, None, None),
         (4, "http://d.example", ""), (None, "http://e.example", "<p>one</p>"), (5, "u", "WARC/1.1\r\n\r\nnot a header"),
         (2**60 + 1, "big", "same"), (2**60, "big", "same"), (7, "rep", "again"), (7, "rep", "again"),
         (8, "long", "z" * 300_000), (None, "n", "only null"), (None, "n", "only null")]
SCHEMA = "page_id long, url string, html string, digest string, refers_to int, largest int"


def expected():
    top = {}
    for page, _, html in PAGES:
        html = html or ""
        if page is not None:
            top[html] = max(page, top.get(html, page))
    out = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        first = top.get(html or "")
        refers = first if first is not None and page != first else None
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip_over_several_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x", 1, 2) for p in PAGES], SCHEMA).repartition(3)
    manifest = warc_zip.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=200)
    rows = warc_zip.read_archives(manifest).collect()
    keys = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[k] for k in keys) for r in rows), key=str) == expected()
    big = next(r for r in rows if r.page_id == 8)
    assert bytes(big.payload) == b"z" * 300_000
    lean = warc_zip.read_archives(manifest, payloads=False).collect()
    assert all(r.payload is None for r in lean) and len(lean) == len(rows)
    assert warc_zip.read_archives(warc_zip.write_archives(pages.where("false"), f"file://{tmp_path}/e")).count() == 0


def test_central_directory_with_zip64(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
        z.writestr("one.txt", b"1" * 500)
        z.writestr("indexes/two.txt", b"second")
    src = warc_zip.RangeFile(f"file://{path}")
    members = warc_zip.central_directory(src)
    assert b"PK\x06\x06" in path.read_bytes()
    assert src.read(*warc_zip.member_range(src, members["indexes/two.txt"])) == b"second"
    assert src.read(*warc_zip.member_range(src, members["one.txt"])) == b"1" * 500


def test_compressed_member_is_refused(tmp_path):
    import pytest
    path = tmp_path / "c.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 1000)
    src = warc_zip.RangeFile(f"file://{path}")
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.member_range(src, warc_zip.central_directory(src)["a"])
    with pytest.raises(ValueError, match="end record"):
        (tmp_path / "n").write_bytes(b"nothing")
        warc_zip.central_directory(warc_zip.RangeFile(f"file://{tmp_path}/n"))
