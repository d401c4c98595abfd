"""WARC derivatives: from responses to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import slices
from .markup import IN_HEAD, OPEN, TEXT, attributes, scan

VERSION = b"WARC/1.1"
#: Names of the resulting record columns.
FIELDS = "record_type string, record_id string, refers_to string, target_uri string, block_digest string, source_digest string, content_length long, record binary"
#: Elements of which no text is converted, and those that begin a line.
HIDDEN = frozenset("head noscript script style template title".split())
BREAKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li ul ol tr table article section nav header footer blockquote pre hr".split())
#: Codecs that pages may name; any other is read as UTF-8.
CODECS = frozenset(
    """ascii big5 big5hkscs cp437 cp850 cp852 cp855 cp866 cp874 cp932 cp949 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256
    cp1257 cp1258 euc_jp euc_kr gb18030 gb2312 gbk iso2022_jp iso8859-1 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6
    iso8859-7 iso8859-8 iso8859-9 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 johab koi8-r koi8-u mac-cyrillic
    mac-roman shift_jis tis-620 utf-8 utf-16 utf-16-be utf-16-le utf-32""".split()
)
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
CHARSET = re.compile(rb"charset\s*+=\s*+[\"']?([\w.:-]++)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    """A name-based identifier: the same parts give the same one, so a task that runs again writes
    the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def _line(value: object) -> str:
    """A header value on one line."""
    lines = str(value).splitlines()
    return lines[0] if len(lines) == 1 else " ".join(x.strip() for x in lines)


def write_record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_line(v)}".encode(errors="replace") for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC file, plain or one gzip member per record. Header
    names are in lower case, continued lines are joined."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = _headers(data[at:stop])
        size = int(headers["content-length"])
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


def _pairs(head: bytes) -> list[tuple[str, str]]:
    """(name in lower case, value) of all headers of a head, in order; continued lines are joined."""
    lines = re.sub(rb"\r?\n[ \t]++", b" ", head).split(b"\n")[1:]
    pairs = (line.partition(b":") for line in lines if b":" in line)
    return [(k.decode(errors="replace").strip().lower(), v.decode(errors="replace").strip()) for k, _, v in pairs]


def _headers(head: bytes) -> dict[str, str]:
    """The last value of each header."""
    return dict(_pairs(head))


def unchunked(body: bytes) -> bytes:
    """A body in chunks as one; what comes after a broken chunk is left out."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1
    return b"".join(out)


def _inflated(body: bytes, window: int) -> bytes:
    """As far as the data goes and is sound; a second member of a gzip body follows the first."""
    out = []
    while body:
        unpack = zlib.decompressobj(window)
        try:
            out.append(unpack.decompress(body))
        except zlib.error:
            for i in range(0, len(body), 1 << 12):  # what comes before the fault
                try:
                    unpack = zlib.decompressobj(window) if i == 0 else unpack
                    out.append(unpack.decompress(body[i : i + (1 << 12)]))
                except zlib.error:
                    break
            break
        body = unpack.unused_data if unpack.eof and window == 31 else b""
    return b"".join(out)


def content(body: bytes, http: list[tuple[str, str]]) -> tuple[bytes, bytes]:
    """(payload, content): without the transfer's chunks; and unpacked. An unknown packing has no
    content."""
    named = {k: [v.strip().lower() for k2, v in http if k2 == k for v in v.split(",")] for k in ("transfer-encoding", "content-encoding")}
    if "chunked" in named["transfer-encoding"]:
        body = unchunked(body)
    data = body
    for packing in reversed(named["content-encoding"]):
        if packing in ("gzip", "x-gzip"):
            data = _inflated(data, 31)
        elif packing == "deflate":
            data = _inflated(data, 15) or _inflated(data, -15)
        elif packing == "zstd":
            try:
                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            except zstandard.ZstdError:
                data = b""
        elif packing not in ("", "identity"):
            data = b""
    return body, data


def charset_of(page: bytes, declared: str = "") -> str:
    """The codec of a page: its byte order mark, else what the header, else what its first bytes
    name, if that is one of CODECS; else UTF-8."""
    for mark, codec in MARKS:
        if page.startswith(mark):
            return codec
    for found in (CHARSET.search(declared.encode()), CHARSET.search(page[:1024])):
        if found:
            try:
                name = codecs.lookup(found[1].decode()).name
            except (LookupError, UnicodeError):
                continue
            if name in CODECS:
                return name
    return "utf-8"


def _decoded(page: bytes, charset: str) -> str:
    """``page`` as text; another codec than CODECS is taken as UTF-8, and so is one that fails."""
    try:
        name = codecs.lookup(charset).name
        return page.decode(name if name in CODECS else "utf-8", errors="replace")
    except (LookupError, UnicodeError):
        return page.decode("utf-8", errors="replace")


def read_page(text: str) -> tuple[str, str | None, list[str]]:
    """(plain text, title, targets of links) in one pass. Hidden elements and tags go, block tags
    break lines, references are resolved, white space inside lines becomes one space, and empty
    lines go."""
    parts: list[str] = []
    title: str | None = None
    links: list[str] = []
    hidden: list[str] = []
    for what, name, raw in scan(text):
        if what == TEXT:
            if not hidden:
                parts.append(name)
            elif hidden[-1] == "title" and title is None:
                title = " ".join(html.unescape(name).split())
            continue
        if what == OPEN and hidden == ["head"] and name not in IN_HEAD:
            hidden.clear()  # any other element ends the head
        if what == OPEN and name == "a":
            target = attributes(raw).get("href")
            if target is not None and not hidden:
                links.append(html.unescape(target))
        if name in HIDDEN:
            if what == OPEN:
                hidden.append(name)
            elif name in hidden:
                del hidden[hidden.index(name) :]
        elif name in BREAKS and not hidden:
            parts.append("\n")
    lines = (" ".join(line.split()) for line in html.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line), title, links


def plain_text(page: bytes, charset: str = "utf-8") -> str:
    """The text of a page: see ``read_page``."""
    return read_page(_decoded(page, charset))[0]


def derive(headers: dict[str, str], block: bytes) -> Iterator[tuple]:
    """One response -> its metadata record and its conversion record, as values of FIELDS."""
    at = min((i for i in (block.find(b"\r\n\r\n"), block.find(b"\n\n")) if i >= 0), default=len(block))
    head, body = block[:at], block[at + (4 if block[at : at + 4] == b"\r\n\r\n" else 2) :]
    http = _pairs(head)
    source, uri, date = (headers.get(k, "") for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    payload, page = content(body, http)
    mark = headers.get("warc-payload-digest") or digest(payload)
    charset = charset_of(page, dict(http).get("content-type", ""))
    text, title, links = read_page(_decoded(page, charset))
    facts: list[tuple[str, object]] = [
        ("status", head.split(b"\n", 1)[0].strip().decode(errors="replace")),
        *((f"http-{k}", v) for k, v in http),
        ("charset-detected", charset),
        ("source-payload-digest", mark),
        ("source-block-digest", headers.get("warc-block-digest", digest(block))),
        *([("title", title)] if title is not None else []),
        *(("outlink", u) for u in links),
    ]
    common = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    fields = "".join(f"{k}: {_line(v)}\r\n" for k, v in facts).encode(errors="replace")
    for kind, shown, made in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text.encode(errors="replace"))):
        own, block_mark = record_id(kind, source), digest(made)
        lines = [("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("WARC-Block-Digest", block_mark)]
        if kind == "conversion":
            lines.append(("WARC-Source-Payload-Digest", mark))
        yield kind, own, source, uri, block_mark, mark, len(made), write_record([*lines, ("Content-Type", shown)], made)


def response_record(url: str | None, page: str | None, key: object, date: str) -> bytes:
    """A WARC response for a page of a table."""
    body = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    lines = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url)), ("WARC-Target-URI", url or ""), ("WARC-Date", date),
        ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return write_record(lines, block)


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    kinds = [types[f.split()[1]] for f in FIELDS.split(", ")]
    for whole in batches:
        for batch in slices(whole, "warc", 4 << 20):
            out = [x for data in batch.column("warc").to_pylist() if data for h, b in read_records(data) if h.get("warc-type") == "response" for x in derive(h, b)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def derivatives(records: DataFrame) -> DataFrame:
    """``records(warc BINARY)``, each value holding whole WARC records -> FIELDS, two rows for each
    response. Other record types and null values have no row; identifiers depend on the response's
    alone, so repeated rows repeat them. A response without a digest gets one from its payload. Bodies
    are taken out of chunks, gzip, deflate and zstandard; of another packing, no text is converted.
    A charset that is not one of CODECS is read as UTF-8, and faulty bytes are replaced. A page of any
    form is read in time linear in its length. Extra columns are not read; no rows give no rows.
    """
    return records.select("warc").mapInArrow(_derived, FIELDS)


def _responses(batches: Iterator[pa.RecordBatch], date: str = "2020-01-01T00:00:00Z") -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html", 4 << 20):
            cols = [batch.column(c).to_pylist() for c in ("url", "html", "page_id")]
            yield pa.RecordBatch.from_arrays([pa.array([response_record(*v, date) for v in zip(*cols)], pa.binary())], ["warc"])


def responses(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as WARC response records; null values are empty."""
    return pages.select("page_id", "url", "html").mapInArrow(_responses, "warc binary")
