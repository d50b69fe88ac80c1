"""Records, pages, media and texts that are broken, hostile or of other makers."""

import base64
import gzip
import hashlib
import json
import struct
import time
import zlib

import pytest

from axisfield.llm import html_paths, ogg, tokens, warc
from axisfield.llm.queries import tokenizer


def record(http: bytes, more: bytes = b"", length: bytes | None = None) -> bytes:
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:0>\r\n" + more + b"Content-Length: " + (length or b"%d" % len(http)) + b"\r\n\r\n" + http + b"\r\n\r\n"


def http(body: bytes, *fields: bytes, kind: bytes = b"text/html") -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: " + kind + b"\r\n" + b"".join(f + b"\r\n" for f in fields) + b"\r\n" + body


def kinds(x: bytes) -> list[str]:
    return [d["record_type"] for d in warc.derivatives(x)]


@pytest.mark.parametrize("body", [b"-6\r\nabcdef\r\n", b"zz\r\nab", b"5\r\nab", b"+5\r\nabcde\r\n0\r\n", b"0x5\r\nabcde\r\n0\r\n", b""])
def test_bad_chunks_give_metadata_alone(body):
    assert kinds(record(http(body, b"Transfer-Encoding: chunked"))) == ["metadata"]


def test_good_chunks():
    out = warc.derivatives(record(http(b"3;x=y\r\n<p>\r\n5\r\nhello\r\n0\r\n\r\n", b"Transfer-Encoding: chunked")))
    assert out[1]["block"] == b"hello"


@pytest.mark.parametrize("length", ["\u00b2".encode(), b"-1", b"1e3", b"9" * 40, b""])
def test_lengths_that_are_none(length):
    assert warc.derivatives(record(http(b"x"), length=length or b" ")) == []


@pytest.mark.parametrize("charset", [b"idna", b"undefined", b"punycode", b"hex", b"no-such-set", b"utf-7"])
def test_charsets_that_are_no_text(charset):
    out = warc.derivatives(record(http(b"<p>plain words", kind=b"text/html; charset=" + charset)))
    assert out[1]["block"] == b"plain words"


def test_codings():
    page = b"<title>T</title><p>words</p>"
    raw = zlib.compressobj(wbits=-15)
    for name, body in ((b"gzip", gzip.compress(page[:9]) + gzip.compress(page[9:])), (b"deflate", zlib.compress(page)), (b"deflate", raw.compress(page) + raw.flush())):
        assert warc.derivatives(record(http(body, b"Content-Encoding: " + name)))[1]["block"] == b"T\nwords"
    assert warc._decoded(gzip.compress(bytes(10_000)), [("Content-Encoding", "gzip")], most=9_999) is None
    assert len(warc._decoded(gzip.compress(bytes(10_000)), [("Content-Encoding", "gzip")], most=10_000)) == 10_000
    assert kinds(record(http(gzip.compress(page)[:-9], b"Content-Encoding: gzip"))) == ["metadata"]
    assert kinds(record(http(page, b"Content-Encoding: br"))) == ["metadata"]


def test_digests():
    block = http(b"x")
    for name, made in (("sha1", hashlib.sha1), ("sha256", hashlib.sha256), ("md5", hashlib.md5)):
        own = made(block).digest()
        for value in (own.hex(), base64.b32encode(own).decode(), base64.b64encode(own).decode()):
            assert warc.derivatives(record(block, f"WARC-Block-Digest: {name}:{value}\r\n".encode()))[0]["digest_holds"] is True
        assert warc.derivatives(record(block, f"WARC-Block-Digest: {name}:{'0' * len(own.hex())}\r\n".encode()))[0]["digest_holds"] is False
    assert warc.derivatives(record(block, b"WARC-Block-Digest: blake3:00\r\n"))[0]["digest_holds"] is None


def test_links_are_those_of_markup():
    page = b"<a data-href=/no href=/a&amp;b>x</a><!-- <a href=/c> --><script src=/s>'<a href=/d>'</script><img src='/i'><a>none</a>"
    links = json.loads(warc.derivatives(record(http(page)))[0]["block"])["links"]
    assert [(x["tag"], x["url"]) for x in links] == [("a", "/a&b"), ("script", "/s"), ("img", "/i")]


@pytest.mark.parametrize("page", ["<a " * 200_000, "<title" * 100_000, "<title>" * 100_000, "<" * 500_000, "<p>" * 50_000 + "words, and more.", "<div><ul>" * 20_000, "".join(f"<x{i}>a, b.</x{i}>" for i in range(5_000))])
def test_hostile_pages_take_no_time(page):
    began = time.time()
    html_paths.main_text(page)
    warc.plain_text(page)
    assert time.time() - began < 20


def test_smoothing_is_that_of_all_pairs():
    paths = {tuple(p.split("/")): [float(i + 1), float(i * i)] for i, p in enumerate(("html/body/p", "html/body/div/p", "html/body", "html/body/div/ul/li", "html", "x/p"))}
    paths[()] = [2.0, 3.0]

    def away(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return len(a) + len(b) - 2 * k

    near = html_paths._smoothed(paths)
    for p in paths:
        assert near[p] == pytest.approx([sum(v[i] * html_paths.ALIKE ** away(p, q) for q, v in paths.items()) for i in range(2)])


def page(serial, sequence, granule, packets, flags=0):
    lacing, body = bytearray(), b""
    for x in packets:
        lacing += bytes([255] * (len(x) // 255) + [len(x) % 255])
        body += x
    return ogg._page(flags, granule, serial, sequence, bytes(lacing), body)


def test_vorbis_packets_inside_a_page_have_no_time():
    head = b"\x01vorbis" + struct.pack("<IBIIIIB", 0, 1, 44100, 0, 0, 0, 0xB8) + b"\1"
    media = page(5, 0, 0, [head], ogg.FIRST) + page(5, 1, 2048, [b"a" * 50, b"b" * 50]) + page(5, 2, 44100, [b"c"], ogg.LAST)
    s = ogg._demuxed(media)["streams"][0]
    assert (s["codec"], s["rate"]) == ("vorbis", 44100)
    assert [(p["granule"], p["seconds"]) for p in s["packets"][1:]] == [(None, None), (2048, 2048 / 44100), (44100, 1.0)]


def test_opus_and_flac_packets_state_their_durations():
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 48000, 0, 0)
    # CELT 20 ms in one frame, two frames, and three frames
    media = page(9, 0, 0, [head], ogg.FIRST) + page(9, 1, 0, [b"OpusTags"]) + page(9, 2, 5760, [bytes([31 << 3]), bytes([31 << 3 | 1]), bytes([31 << 3 | 3, 3])]) + page(9, 3, 6000, [bytes([31 << 3]), bytes([31 << 3])], ogg.LAST)
    s = ogg._demuxed(media)["streams"][0]
    assert [p["granule"] for p in s["packets"]] == [0, 0, 960, 2880, 5760, 6720, 6000]
    assert s["packets"][4]["seconds"] == (5760 - 312) / 48000
    flac = b"\x7fFLAC\1\0\0\1fLaC\0\0\0\x22" + bytes(10) + (44100 << 12).to_bytes(4, "big")[:4] + bytes(20)
    assert ogg.codec(flac)[:2] == ("flac", 44100)
    assert ogg._flac_samples(b"\xff\xf8\xc9\x08\0\0") == 4096 and ogg._flac_samples(b"\xff\xf8\x69\x08\x05\x0f\0") == 16 and ogg._flac_samples(b"\xff\xf8\x79\x08\xc2\x80\x0f\xff\0") == 4096


def test_chained_files_begin_new_streams():
    first, second = ogg.mux(b"first" * 300), ogg.mux(b"second" * 300)
    got = ogg._demuxed(first + second)
    assert [(s["serial"], s["link"]) for s in got["streams"]] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    of = lambda link: b"".join(p["data"] for s in got["streams"] if s["link"] == link for p in s["packets"])
    assert of(0) == b"first" * 300 and of(1) == b"second" * 300


def test_ids_of_control_characters():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), tokens.WordIds(path)
    for text in ("a\x1cb", "a\x01b", "a\x7fb", "a\x0bb", "a\x0cb", "a\x85b", "\x00", "a\u00adb", "\ufeffa", "A\u0130b", "don't  DO\tthat\r\n", *(f"x{chr(c)}y 1" for c in range(256))):
        assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids), repr(text)
