"""Source headers in metadata records."""

import json

from axisfield.llm import warc


def test_repeated_headers_are_kept_in_order():
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/html\r\nVia: x\r\nSet-Cookie: b=2\r\nVia: y\r\n\r\n<p>text</p>"
    concurrent = b"WARC-Concurrent-To: <urn:uuid:1>\r\nWARC-Concurrent-To: <urn:uuid:2>\r\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:0>\r\n" + concurrent + b"Content-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    source = json.loads(warc.derivatives(record)[0]["block"])["source"]
    assert source["http"] == [["Set-Cookie", "a=1"], ["Content-Type", "text/html"], ["Via", "x"], ["Set-Cookie", "b=2"], ["Via", "y"]]
    assert [v for k, v in source["warc"] if k == "WARC-Concurrent-To"] == ["<urn:uuid:1>", "<urn:uuid:2>"]
