"""WARC archives: exact round trips, and the archives as plain gzip files."""

import base64
import gzip
import hashlib

from astrolake.llm import warc


def plain_expectation(rows):
    largest = {}
    for page, _, text in rows:
        data = (text or "").encode()
        if page is not None:
            largest[data] = max(page, largest.get(data, page))
    out = []
    for page, _, text in rows:
        data = (text or "").encode()
        first = largest.get(data)
        revisit = first is not None and first != page
        out.append((
            None if page is None else str(page), "revisit" if revisit else "response", len(data),
            base64.b32encode(hashlib.sha1(data).digest()).decode(),
            str(first) if revisit else None,
        ))
    return sorted(out, key=str)


def read(df):
    return sorted(((r._id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to)
                   for r in df.collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    index = warc.write_archives(pages, "page_id", "url", "html")
    found = warc.read_records(index)
    assert read(found) == plain_expectation(rows)
    texts = {str(a): c for a, _, c in rows}
    for row in found.where("record_type = 'response'").collect():
        assert bytes(row.payload).decode() == texts[row._id]


def test_copies_nulls_and_ties(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c\n", None), (4, "u", ""),
            (None, "u", "x"), (2, None, "x"), (5, "u", "é\r\n\r\n日"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(df, "page_id", "url", "html")
    assert read(warc.read_records(index)) == plain_expectation(rows)
    only = warc.read_records(index.where("_id = '5'")).collect()
    assert [bytes(r.payload).decode() for r in only] == ["é\r\n\r\n日"]


def test_least_size_keeps_small_payloads_apart(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                               "page_id long, url string, html string")
    index = warc.write_archives(df, "page_id", "url", "html", least=3)
    kinds = {r._id: r.record_type for r in warc.read_records(index).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_archives_are_gzip_members_at_the_indexed_places(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", "<p>" * i) for i in range(20)],
                               "page_id long, url string, html string")
    for row in warc.write_archives(df, "page_id", "url", "html").collect():
        with open(row.file, "rb") as archive:
            archive.seek(row.offset)
            data = gzip.decompress(archive.read(row.length))
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        assert f"WARC-Target-URI: {row.url}\r\n".encode() in data


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, _digest int, file int")
    assert warc.read_records(warc.write_archives(df, "page_id", "url", "html")).collect() == []


def test_near_records_share_a_read():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP, 5), ("a", 21 + 2 * warc.GAP, 5),
            ("b", 0, 7)]
    assert list(warc.ranges(rows)) == [
        ("a", 0, 20 + warc.GAP, 0, 3), ("a", 21 + 2 * warc.GAP, 26 + 2 * warc.GAP, 3, 4),
        ("b", 0, 7, 4, 5)]
