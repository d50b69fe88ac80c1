"""Pages that once ended a job: references of thousands of digits, deep nesting."""

import html
import time

import pytest

from axisfield.llm import html_paths, warc

TEXT = "A sentence of the text, which is long enough to be told from a menu, has marks, and ends here."


@pytest.mark.parametrize("reference", ["&#" + "9" * 5000 + ";", "&#" + "0" * 5000 + "65;", "&#x" + "F" * 9000, "&#x" + "0" * 5000 + "41;", "&#8;", "&#00A", "&#x0g", "&#", "&#;", "&#1114112;", "&#99999999", "&amp;#65;", "&lt;&nosuch;&eacute"])
def test_references_of_any_length(reference):
    want = html.unescape(reference) if len(reference) < 100 else "A" if reference.strip(";").endswith(("65", "41")) else "�"
    assert html_paths.decoded(reference) == want
    page = f"<body><article><p>{TEXT} {reference} {TEXT}</p></article></body>"
    assert html_paths.main_text(page) == " ".join(f"{TEXT} {want} {TEXT}".split())
    assert warc.plain_text(page) == " ".join(f"{TEXT} {want} {TEXT}".split())


def test_deep_nesting_ends():
    began = time.time()
    for n in (4000, 20_000):
        page = f"<body><article>{'<div><p>' + TEXT}" + ("<div><p>" + TEXT) * n + "</article></body>"
        got = html_paths.main_text(page)
        assert got.count(TEXT) == n + 1
    assert time.time() - began < 60


def test_what_lies_deep_is_still_left_out():
    deep = "<div>" * 300
    page = f"<body><article><p>{TEXT}</p><p>{TEXT}</p>{deep}<nav><ul><li>menu <b>item</b></li></ul></nav><p>{TEXT}</p></article></body>"
    assert html_paths.main_text(page) == "\n\n".join([TEXT] * 3)


def test_headers_stay_lines_and_long_bodies_say_so(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("http://a/\r\nWARC-Type: request", "<p>x</p>")], "url string, html string")
    record = rows.select(warc.response_record(F.col("url"), F.col("html"), "2024-01-01T00:00:00Z").alias("record"))
    got = {r.record_type: r for r in warc.derive(record).collect()}
    assert got["conversion"].target_uri == "http://a/%0D%0AWARC-Type: request" and "undecoded" not in got["metadata"].block.decode()
    import gzip

    body = gzip.compress(b"<p>" + b"x" * 5000)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n" + body
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: %d\r\n\r\n" % len(block) + block
    cut = warc.derive(spark.createDataFrame([(bytearray(raw),)], "record binary"), most=1000).collect()
    assert [r.record_type for r in cut] == ["metadata"] and '"undecoded": true' in cut[0].block.decode()
    assert len(warc.derive(spark.createDataFrame([(bytearray(raw),)], "record binary")).collect()) == 2
