"""WARC derivatives: metadata and plain-text conversion records of response records.

`derive` reads whole response records (WARC header, HTTP header, body), undoes chunked
transfer and gzip or deflate content coding, and writes for each a metadata record (JSON
of the source's WARC and HTTP headers as ordered [name, value] pairs, page title and links) and, for HTML and plain text, a
conversion record (text/plain). Both keep WARC-Target-URI and WARC-Date, name the response
in WARC-Refers-To, and carry the digest of their own block; the metadata keeps the source's
digests and states whether they hold (of SHA-1, SHA-2 and MD5, in base 32, base 64 or
hexadecimal; null if the source has none of these).

Defined results: a null or cut record, one without an id or a length of ASCII digits, or one of
another type, gives no derivatives; a body that can't be decoded (a bad chunk size, an
unknown coding, more than `MOST_BYTES` once inflated) gives metadata alone; a character set
that is unknown or no text encoding is read as UTF-8; repeated records give repeated rows;
equal records have equal derivatives (their ids are made from the source's id). Links are those
of tags outside scripts, styles and comments, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisfield.llm.html_paths import INLINE, RAW, attribute, decoded, tokens

RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("record_type", T.StringType()), ("record_id", T.StringType()), ("refers_to", T.StringType()), ("target_uri", T.StringType()), ("warc_date", T.StringType()), ("content_type", T.StringType()),
    ("content_length", T.LongType()), ("block_digest", T.StringType()), ("source_payload_digest", T.StringType()), ("digest_holds", T.BooleanType()), ("block", T.BinaryType()), ("record", T.BinaryType()))])
# fixed values: the attribute of each tag that holds its link
_LINKS = {"a": "href", "img": "src", "link": "href", "script": "src", "iframe": "src"}
# fixed values: codecs that Python counts as text and that no page is in
_NO_CHARSETS = frozenset("idna punycode undefined unicode_escape raw_unicode_escape".split())
_CHUNK = re.compile(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", re.S)
#: Bytes that a body may have once inflated; a larger one is taken as one that can't be decoded.
MOST_BYTES = 1 << 28


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def holds(stated: str | None, data: bytes) -> bool | None:
    """Whether a stated digest is that of the data; null for none and for algorithms that are not verified."""
    name, _, value = (stated or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("sha1", "sha256", "sha384", "sha512", "md5"):
        return None
    own = hashlib.new(name, data).digest()
    plain = lambda x: x.decode().rstrip("=")
    return value.lower() == own.hex() or value.upper().rstrip("=") == plain(base64.b32encode(own)) or value.rstrip("=") in (plain(base64.b64encode(own)), plain(base64.urlsafe_b64encode(own)))


def headers(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line and the fields, continued lines joined."""
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            fields.append((k.strip(), v.strip()))
    return lines[0], fields


def _get(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def _unchunk(body: bytes) -> bytes:
    """The chunks' data; ValueError for a size that is no hexadecimal number or a chunk that is cut."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = _CHUNK.fullmatch(body[at : end if end >= 0 else len(body)])
        if not size:
            raise ValueError("no chunk size")
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        if end < 0 or end + 2 + n > len(body):
            raise ValueError("a cut chunk")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _inflated(body: bytes, wbits: int, most: int) -> bytes:
    """All members of a compressed body; ValueError beyond `most` bytes."""
    out, room = [], most
    while body:
        member = zlib.decompressobj(wbits)
        out.append(member.decompress(body, room + 1))
        room -= len(out[-1])
        if room < 0 or not member.eof:
            raise ValueError("too long or cut")
        body = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _decoded(body: bytes, fields: list[tuple[str, str]], most: int = MOST_BYTES) -> bytes | None:
    try:
        if "chunked" in (_get(fields, "Transfer-Encoding") or "").lower():
            body = _unchunk(body)
        coding = (_get(fields, "Content-Encoding") or "identity").strip().lower()
        if coding in ("gzip", "x-gzip"):
            return _inflated(body, 31, most)
        if coding == "deflate":
            # with or without the zlib header
            try:
                return _inflated(body, 15, most)
            except zlib.error:
                return _inflated(body, -15, most)
        return body if coding in ("identity", "") else None
    except (ValueError, zlib.error):
        return None


def _read(page: str) -> tuple[str | None, list[dict], str]:
    """A page's title, its links and its text: a line per block, without scripts, styles and markup."""
    title, links, parts, in_title = None, [], [], False
    for closing, tag, attributes, text in tokens(page, frozenset({"title"})):
        if text:
            if in_title and title is None:
                title = " ".join(decoded(text).split())
            parts.append(" ".join(f"x{text}x".split())[1:-1])
            continue
        in_title = tag == "title" and not closing
        if tag in _LINKS and not closing and (url := attribute(attributes, _LINKS[tag])) is not None:
            links.append({"tag": tag, "url": url})
        if tag not in INLINE and tag != "a" and (tag not in RAW or tag == "title"):
            parts.append("\n")
    lines = (" ".join(decoded(x).split()) for x in "".join(parts).split("\n"))
    return title, links, "\n".join(x for x in lines if x)


def plain_text(page: str) -> str:
    return _read(page)[2]


def _text(content: bytes, charset: str | None) -> str:
    name = (charset or "utf-8").lower().replace("-", "_")
    try:
        return content.decode("utf-8" if name in _NO_CHARSETS else name, "replace")
    except (LookupError, ValueError):
        return content.decode("utf-8", "replace")


def _record(kind: str, source: str, uri: str | None, date: str | None, content_type: str, block: bytes, payload: str | None, holds: bool | None) -> dict:
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return {"record_type": kind, "record_id": own, "refers_to": source, "target_uri": uri, "warc_date": date, "content_type": content_type, "content_length": len(block), "block_digest": digest(block), "source_payload_digest": payload, "digest_holds": holds, "block": block, "record": head.encode() + block + b"\r\n\r\n"}


def derivatives(record: bytes | None, most: int = MOST_BYTES) -> list[dict]:
    head, gap, rest = (record or b"").partition(b"\r\n\r\n")
    version, fields = headers(head)
    source, length = _get(fields, "WARC-Record-ID"), _get(fields, "Content-Length") or ""
    if not gap or not version.startswith("WARC/") or _get(fields, "WARC-Type") != "response" or not source or not re.fullmatch("[0-9]{1,18}", length) or len(rest) < int(length):
        return []
    block = rest[: int(length)]
    http, _, body = block.partition(b"\r\n\r\n")
    status, sent = headers(http)
    uri, date = _get(fields, "WARC-Target-URI"), _get(fields, "WARC-Date")
    stated = {"WARC-Block-Digest": (_get(fields, "WARC-Block-Digest"), block), "WARC-Payload-Digest": (_get(fields, "WARC-Payload-Digest"), body)}
    checks = [x for x in (holds(*pair) for pair in stated.values()) if x is not None]
    verified = all(checks) if checks else None
    content = _decoded(body, sent, most)
    kind = (_get(sent, "Content-Type") or "").lower()
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind)
    text = None if content is None or not kind.startswith(("text/", "application/xhtml")) else _text(content, charset[1] if charset else None)
    about = {"source": {"warc": fields, "http_status": status, "http": sent}, "digests": {k: a for k, (a, _) in stated.items()}, "digest_holds": verified}
    if content is None:
        about["undecoded"] = True
    plain = text
    if text is not None and "html" in kind:
        about["title"], about["links"], plain = _read(text)
    payload = stated["WARC-Payload-Digest"][0]
    out = [_record("metadata", source, uri, date, "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"), payload, verified)]
    if plain is not None:
        out.append(_record("conversion", source, uri, date, "text/plain; charset=utf-8", plain.encode("utf-8", "replace"), payload, verified))
    return out


def derive(responses: DataFrame, record: str = "record", most: int = MOST_BYTES) -> DataFrame:
    """A row per derivative record, with the other columns of its response (those named like a result are replaced).

    A body that is over `most` bytes once inflated, or can't be decoded, has no conversion record; its metadata say "undecoded".
    """
    kept = [f for f in responses.schema if f.name not in {record, *RECORD.names}]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in RECORD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = [(i, d) for i, x in enumerate(some.column(record)) for d in derivatives(x.as_py(), most)]
                rows = pa.array([i for i, _ in made], pa.int64())
                yield pa.RecordBatch.from_arrays([*(some.column(f.name).take(rows) for f in kept), *(pa.array([d[f.name] for _, d in made], t) for f, t in zip(RECORD, kinds, strict=True))], names=[*(f.name for f in kept), *RECORD.names])

    return responses.select(*(F.col(f"`{f.name}`") for f in kept), record).mapInArrow(run, T.StructType([*kept, *RECORD.fields]))


def response_record(uri: Column, body: Column, date: str, content_type: str = "text/html; charset=utf-8") -> Column:
    """A response record of a page, with an id made from its address and body and with its digests, in SQL functions.

    Digests are stated in hexadecimal, as SQL has no base 32.
    """
    http = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    h = F.md5(F.concat_ws("\n", uri, body))
    own = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    # a line break in an address would be a header line of its own
    safe = F.replace(F.replace(F.coalesce(uri, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), own, F.lit(">\r\nWARC-Target-URI: "), safe, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Block-Digest: sha1:"), F.sha1(http.cast("binary")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.sha1(body.cast("binary")), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, http, F.lit("\r\n\r\n")).cast("binary")
