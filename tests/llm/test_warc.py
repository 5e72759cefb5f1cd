import base64
import hashlib
import io
import struct
from urllib.parse import urlsplit

import pytest
import zstandard

from weftgraph.llm import warc

PAGES = "page_id long, url string, html string, path string, key int"


def expected(rows, least=0):
    """(page_id, payload bytes, digest, type, refers_to) in plain Python."""
    data = [(p, u, (h or "").encode()) for p, u, h in rows]
    order = lambda p, u: (p is not None, p or 0, u is not None, u or "")
    out = []
    for p, u, b in data:
        top = max((order(q, v), q) for q, v, c in data if c == b)
        again = len(b) >= least and order(p, u) != top[0]
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top[1] if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_equals_plain_python_on_the_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = pages.unionByName(pages.selectExpr("page_id + 1000 as page_id", "url", "html").where("page_id % 3 = 0"))
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    want = expected(rows)
    assert sum(r[3] == "revisit" for r in want) > 10
    assert found(warc.op11(pages)) == want


@pytest.mark.parametrize("least, most", [(0, warc.BROADCAST_ROWS), (6, 0)])
def test_nulls_ties_repeats_long_pages_and_clashing_columns(spark, monkeypatch, least, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    rows = [(1, "http://a/\r\nX: y", None), (2, None, ""), (None, "u", ""), (3, "http://a/ñ <b>", "page ñ\r\n\r\n"), (4, "", "page ñ\r\n\r\n"), (4, "z", "page ñ\r\n\r\n"), (4, "z", "page ñ\r\n\r\n"), (5, "http://l", "<p>\u0000long</p>" * 400_000), (6, "http://s", "short"), (7, "http://s", "short"), (None, None, "null id"), (None, "v", "null id")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], PAGES).repartition(3)
    assert found(warc.op11(df, least)) == expected(rows, least)
    assert warc.op11(df.where("false")).count() == 0


def test_payloads_come_back_whole_from_small_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    files = warc.write_archives(pages, f"file://{tmp_path}/warc")
    records = warc.read_archives(files)
    assert files.count() > 2 and files.agg({"records": "sum"}).first()[0] == records.count() == pages.count() + files.count()
    for f in files.collect():  # what lies on disk is the format itself
        raw = open(f.path.removeprefix("file://"), "rb").read()
        assert len(raw) == f.bytes and raw[:4] == struct.pack("<I", warc.DICTIONARY_FRAME) and sum(1 for _ in warc.frames(io.BytesIO(raw))) == f.records
    back = {r.page_id: (r.url, bytes(r.payload).decode()) for r in records.where("record_type = 'response'").collect()}
    assert back == {r.page_id: (r.url, r.html) for r in pages.collect()} and all(urlsplit(u).scheme for u, _ in back.values())


def archive(records, dictionary=b"", raw=False):
    stream = io.BytesIO()
    writer = warc.ArchiveWriter(stream, b"" if raw else dictionary)
    if raw:
        stream.write(struct.pack("<II", warc.DICTIONARY_FRAME, len(dictionary)) + dictionary)
        writer.packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    for r in records:
        writer.add(r)
    return stream.getvalue()


GOOD = [warc.record("response", f"<urn:uuid:{i}>", "2024-01-01T00:00:00Z", [("Content-Type", warc.HTTP_TYPE), ("WARC-Payload-Digest", f"sha1:{warc.digest(b'x' * i)}")], warc.http_block(b"x" * i, b"x" * i)) for i in (0, 1, 300_000)]


@pytest.mark.parametrize("raw", [False, True])
def test_dictionary_is_read_from_the_leading_frame(raw):
    dictionary = warc.train([f"<html><body>row {i} of the table {i * 7919 % 1000}</body></html>".encode() * 3 for i in range(400)])
    assert dictionary[:4] == struct.pack("<I", warc.RAW_DICTIONARY)
    data = archive(GOOD, dictionary, raw)
    assert [c for _, c in warc.frames(io.BytesIO(data))] == GOOD
    skipped = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert [c for _, c in warc.frames(io.BytesIO(data + skipped + skipped))] == GOOD
    at = [o for o, _ in warc.frames(io.BytesIO(data))]
    assert at == sorted(set(at)) and at[0] > 8
    with pytest.raises(warc.WarcError):  # the same frames without their dictionary
        list(warc.frames(io.BytesIO(data[at[0] :])))


def test_blocks_of_every_kind_and_frames_without_a_size():
    for content in (b"", b"a" * 1_000_000, bytes(range(256)) * 3000, hashlib.sha512(b"").digest() * 7):
        for packer in (zstandard.ZstdCompressor(write_content_size=False), zstandard.ZstdCompressor(write_checksum=True), zstandard.ZstdCompressor(level=19)):
            packed = packer.compress(content)
            assert warc.frame_length(warc._Source(io.BytesIO(packed + b"next"))) == len(packed)
            assert [c for _, c in warc.frames(io.BytesIO(packed * 2))] == [content] * 2


def test_damaged_files_raise():
    data = archive(GOOD)
    for bad in (data[:-1], data + b"\x00", data + b"12345678", data[:20], struct.pack("<II", warc.DICTIONARY_FRAME, 4) + b"abcd" + data, struct.pack("<II", warc.DICTIONARY_FRAME, 900)):
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(bad)))
    flipped = bytearray(data)
    flipped[-6] ^= 1
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(bytes(flipped))))


BAD = {
    "version": GOOD[1].replace(b"WARC/1.1", b"WARC/2.0"),
    "mandatory": GOOD[1].replace(b"WARC-Date", b"X-Date"),
    "repeated": GOOD[1].replace(b"WARC-Date", b"WARC-Type: x\r\nWARC-Date"),
    "short length": GOOD[1].replace(b"Content-Length: 79", b"Content-Length: 78"),
    "no number": GOOD[1].replace(b"Content-Length: 79", b"Content-Length: -2"),
    "no end": GOOD[1][:-2],
    "two records": GOOD[0] + GOOD[1],
    "block digest": GOOD[1].replace(b"\r\n\r\nx\r\n", b"\r\n\r\ny\r\n"),
    "colon": GOOD[1].replace(b"WARC-Date:", b"WARC-Date"),
    "revisit": warc.record("revisit", "<a>", "d", [("Content-Type", warc.HTTP_TYPE)], warc.http_block(b"x", b"")),
    "http length": warc.record("response", "<a>", "d", [("Content-Type", warc.HTTP_TYPE)], warc.http_block(b"xy", b"x")),
    "payload digest": warc.record("response", "<a>", "d", [("Content-Type", warc.HTTP_TYPE), ("WARC-Payload-Digest", "sha1:A")], warc.http_block(b"x", b"x")),
}


@pytest.mark.parametrize("what", BAD)
def test_bad_records_raise(what):
    assert BAD[what] not in GOOD
    with pytest.raises(warc.WarcError):
        warc.row("f", 0, BAD[what])


def test_folded_lines_case_and_plain_blocks():
    data = warc.record("resource", "<a>", "d", [("content-TYPE", "text/plain;\r\n  charset=utf-8")], b"body")
    found = warc.row("f", 9, data)
    assert (found["payload"], found["payload_bytes"], found["record_type"], found["page_id"]) == (b"body", 4, "resource", None)
    assert warc.parse(data)[0]["content-type"] == "text/plain; charset=utf-8"


def test_reader_that_is_not_strict_tells_what_failed(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive([GOOD[0], BAD["no end"], GOOD[1]])[:-3])
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "path string")
    rows = sorted(warc.read_archives(paths, strict=False).collect(), key=lambda r: (r.offset, r.error or ""))
    assert [r.error is None for r in rows].count(True) == 1 and len(rows) == 3
    with pytest.raises(Exception, match="WarcError"):
        warc.read_archives(paths).collect()


def test_revisits_need_their_response(spark):
    again = warc.record("revisit", "<r>", "d", [("Content-Type", warc.HTTP_TYPE), ("WARC-Payload-Digest", "sha1:A"), ("WARC-Refers-To", "<lost>")], warc.http_block(b"x", b""))
    df = spark.createDataFrame([warc.row("f", 0, r) for r in (again, GOOD[0])], warc.ROW)
    with pytest.raises(warc.WarcError, match="no response"):
        warc.resolved(df)
