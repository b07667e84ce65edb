import hashlib

import numpy as np
import pytest

from quillspark.llm import warc as w
from tests.llm.helpers import as_dict, saved

SF = "/root/testdata/sf0.001"
BIG = "<p>" + "x" * 200 + "</p>"
INSIDE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [(5, "http://a/ b\r\nX: y", BIG), (2, "u", BIG), (3, None, None), (4, "", ""), (9, "u", "short"), (7, "u", "short"), (8, "u", INSIDE * 3), (6, "é", "漢字" * 40), (1, "u", INSIDE * 3), (11, "u", "y" * 99), (12, "u", "y" * 99), (13, "u", "\x1f\x8b\x08 not gzip")]


def brute(rows):
    first, out = {}, {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        b = (h or "").encode()
        of = first.setdefault(b, i) if len(b) >= 100 else i
        out[i] = {"page_id": i, "payload_bytes": len(b), "payload_digest": hashlib.sha256(b).hexdigest(), "record_type": "response" if of == i else "revisit", "refers_to": None if of == i else of}
    return out


def test_query(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumnsRenamed({})
    from pyspark.sql import functions as F

    df = df.withColumns({"digest": F.lit("d"), "size": F.lit(1), "path": F.lit("p")})
    assert as_dict(w.op5_warc(spark, saved(df, tmp_path, "pages")), "page_id") == brute(ROWS)
    assert w.op5_warc(spark, saved(df.limit(0), tmp_path / "e", "pages")).count() == 0
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert as_dict(w.op5_warc(spark, SF), "page_id") == brute(rows)


@pytest.mark.parametrize("compress", [True, False])
def test_small_ranges_and_payloads(spark, tmp_path, compress):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    archives = w.write_warc(df, f"file://{tmp_path}/a", compress)
    got = w.read_warc(archives, payload=True, split=37 if compress else 101).filter("record_type in ('response', 'revisit')").collect()
    want = brute(ROWS)
    assert sorted(r.page_id for r in got) == sorted(want)
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload) == (dict((i, h) for i, _, h in ROWS)[r.page_id] or "").encode()
    if not compress:  # records inside payloads are candidates, but none is on the chain
        with open(archives.first().path.removeprefix("file://"), "rb") as f:
            assert f.read().count(b"<urn:page:99>") == 3


def test_pointer_jumping_keeps_the_chain_only():
    at = np.array([0, 5, 7, 10, 12, 20])
    after = np.array([10, 12, 20, 20, 13, 30])
    assert w.reached(at, after).tolist() == [True, False, False, True, False, True]
    n = np.arange(1000)
    assert w.reached(n, n + 1).all()


def test_repeated_rows_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(2, "u", BIG), (2, "u", BIG), (None, "u", BIG), (4, "u", BIG)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in w.op5_warc(spark, saved(df, tmp_path, "pages")).collect()), key=str)
    assert got == [(2, "response", None), (2, "response", None), (4, "revisit", 2), (None, "revisit", 2)]


@pytest.mark.parametrize("compress", [True, False])
def test_long_urls_lose_no_pages(spark, tmp_path, compress):
    """Headers beyond 64 KiB, and of more than one step of reading, with other pages after them."""
    long = {21: "data:text/html," + "".join(chr(97 + i * i % 23) for i in range(120_000)), 23: "http://a/?q=" + " " * 400_000}
    rows = [(20, "u", "first"), (21, long[21], "long"), (22, "u", INSIDE), (23, long[23], BIG), (24, "u", BIG), (25, "u", "last")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives = w.write_warc(df, f"file://{tmp_path}/a", compress)
    for split in (1 << 14, 8 << 20):
        got = as_dict(w.read_warc(archives, split=split).filter("record_type in ('response', 'revisit')"), "page_id")
        assert {i: {k: r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")} for i, r in got.items()} == brute(rows)
        assert got[21]["url"] == long[21] and got[23]["url"] == long[23].replace(" ", "%20")


@pytest.mark.parametrize("compress", [True, False])
def test_a_broken_chain_fails(spark, tmp_path, compress):
    archives = w.write_warc(spark.createDataFrame([(i, "u", f"page {i}") for i in range(9)], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/a", compress)
    path = archives.first().path.removeprefix("file://")
    with open(path, "rb") as f:
        whole = f.read()
    assert w.read_warc(archives).count() == 10
    for bad in (whole[: len(whole) // 2] + b"?" * 40 + whole[len(whole) // 2 :], b"?" * len(whole), whole[:-7]):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(Exception, match="no record starts at byte"):
            w.read_warc(spark.createDataFrame([(f"file://{path}", len(whole))], "path string, size long"), split=50).count()
