import gzip
import hashlib

import pytest

from poolweave.llm import warc

from .helpers import FOLDER

PAGE = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><p>One&nbsp;two <b>three</b><br>four<script>var t='</p>';</script><a href='/x'>l</a></p></body></html>"


def test_text_of_a_page():
    assert warc.plain_text(PAGE.encode()) == "One two three\nfourl" or warc.plain_text(PAGE.encode()) == "One two three\nfour l"
    assert warc.plain_text(b"") == ""
    assert warc.plain_text("é".encode("latin-1"), "latin-1") == "é"
    assert warc.plain_text("é".encode(), "no-such-charset") == "é"
    assert warc.plain_text(b"1 < 2 &lt; 3") == "1 < 2 < 3"


def test_records_round_trip_plain_and_compressed():
    one = warc.write_record([("WARC-Type", "response"), ("X-Long", "a\r\n b")], b"block\r\n\r\nwith breaks")
    two = warc.write_record([("WARC-Type", "request")], b"")
    for data in (one + two, gzip.compress(one) + gzip.compress(two)):
        got = list(warc.read_records(data))
        assert [b for _, b in got] == [b"block\r\n\r\nwith breaks", b""]
        assert got[0][0]["x-long"] == "a b"
    with pytest.raises(ValueError):
        list(warc.read_records(b"nothing"))


def test_derivatives_link_to_their_response(spark):
    rows = [(1, "http://a.com/x", PAGE), (2, None, None), (3, "http://b.com/", ""), (1, "http://a.com/x", PAGE), (4, "http://c.com", "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 as record_id", "'x' as warc")
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 10
    for r in got:
        (headers, block), = warc.read_records(bytes(r.record))
        assert headers["warc-type"] == r.record_type and headers["warc-record-id"] == r.record_id
        assert headers["warc-refers-to"] == r.refers_to and r.refers_to.startswith("<urn:uuid:")
        assert headers["warc-block-digest"] == r.block_digest == warc.digest(block)
        assert int(headers["content-length"]) == len(block) == r.content_length
    first = [r for r in got if r.target_uri == "http://a.com/x"]
    assert len({r.refers_to for r in first}) == 1 and len({r.record_id for r in first}) == 2
    facts = next(bytes(r.record) for r in first if r.record_type == "metadata")
    assert b"title: A & B" in facts and b"outlink: /x" in facts and b"http-content-type: text/html; charset=utf-8" in facts
    assert all(r.source_digest == warc.digest(PAGE.encode()) for r in first)
    assert warc.derivatives(warc.responses(pages.filter("false"))).count() == 0


def test_other_records_and_charsets():
    body = "<p>ü".encode("latin-1")
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html;charset=ISO-8859-1\r\n\r\n" + body
    record = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "d"), ("WARC-Payload-Digest", "sha1:GIVEN")], block)
    (headers, data), = warc.read_records(record)
    made = {x[0]: x for x in warc.derive(headers, data)}
    assert bytes(made["conversion"][-1]).endswith("ü\r\n\r\n".encode())
    assert made["metadata"][5] == "sha1:GIVEN" and b"404 Not Found" in made["metadata"][-1]


def test_whole_pages_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = warc.derivatives(warc.responses(pages)).select("record_type", "record").collect()
    assert len(got) == 2 * pages.count()
    texts = [bytes(r.record).split(b"\r\n\r\n", 1)[1] for r in got if r.record_type == "conversion"]
    assert all(b"<p>" not in t and b"var t" not in t for t in texts) and hashlib.sha1(b"").hexdigest()


def response(body, *headers):
    lines = [b"HTTP/1.1 200 OK", *headers]
    return {"warc-record-id": "<urn:x>"}, b"\r\n".join(lines) + b"\r\n\r\n" + body


def made(body, *headers):
    out = {x[0]: warc.read_records(x[-1]) for x in warc.derive(*response(body, *headers))}
    return {k: next(v)[1] for k, v in out.items()}


@pytest.mark.parametrize("charset", ["idna", "undefined", "utf-7", "unicode_escape", "raw_unicode_escape", "punycode", "rot13", "base64", "hex", "zlib", "mbcs", "", "\xff", "x" * 5000, "utf-16"])
def test_hostile_charsets(charset):
    body = f"<meta charset='{charset}'><p>text \xfc \\ud800 +2AA-".encode("utf-8", "replace")
    got = made(body, b"Content-Type: text/html; charset=" + charset.encode("utf-8", "replace"))
    assert got["conversion"].decode() is not None
    if charset != "utf-16":
        assert b"text \xc3\xbc" in got["conversion"]


@pytest.mark.parametrize("bit", [b"<!--", b"<script>", b"<title>", b"<a href='", b"<a href=\"x\" ", b"<", b"</", b"<a =", b"<p a", b"&", b"&#", b"charset", b"<style><!--", b"<head>", b"<a " + b"x" * 50])
def test_two_megabytes_of_unclosed_marks(bit):
    import time

    body = bit * (2_000_000 // len(bit))
    began = time.process_time()
    made(body)
    assert time.process_time() - began < 10


def test_packed_bodies():
    import zlib

    import zstandard

    text = ("<p>" + "word " * 3000).encode()
    want = ("word " * 3000).strip().encode()
    chunks = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(text[i : i + 700]), text[i : i + 700]) for i in range(0, len(text), 700)) + b"0\r\n\r\n"
    packed = gzip.compress(text)
    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(text) + raw.flush()
    assert made(chunks, b"Transfer-Encoding: chunked")["conversion"] == want
    assert made(packed, b"Content-Encoding: gzip")["conversion"] == want
    assert made(gzip.compress(text[:900]) + gzip.compress(text[900:]), b"Content-Encoding: x-gzip")["conversion"] == want
    assert made(zlib.compress(text), b"Content-Encoding: deflate")["conversion"] == want
    assert made(deflated, b"Content-Encoding: deflate")["conversion"] == want
    assert made(zstandard.compress(text), b"Content-Encoding: zstd")["conversion"] == want
    assert made(b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed), packed), b"Transfer-Encoding: chunked", b"Content-Encoding: gzip")["conversion"] == want
    assert made(text, b"Content-Encoding: br")["conversion"] == b""
    assert made(text, b"Content-Encoding: gzip")["conversion"] == b""
    assert want.startswith(made(packed[:-20], b"Content-Encoding: gzip")["conversion"][:200].rstrip())
    assert made(b"zz\r\nno chunk", b"Transfer-Encoding: chunked")["conversion"] == b""


def test_repeated_headers_stay():
    facts = made(b"x", b"Set-Cookie: a=1", b"Set-Cookie: b=2", b"X-Long: one", b" two")["metadata"]
    assert b"http-set-cookie: a=1\r\nhttp-set-cookie: b=2\r\n" in facts and b"http-x-long: one two" in facts


def slow_text(page):
    """Text of a page by cutting it up character by character, for small pages."""
    out, at, hidden = [], 0, None
    while at < len(page):
        if page.startswith("<!--", at):
            at = page.find("-->", at) + 3 if "-->" in page[at:] else len(page)
        elif page[at] == "<" and page[at + 1 : at + 2].replace("/", "x").isalpha():
            end = page.index(">", at)
            name = page[at + 1 : end].split()[0].lower()
            at = end + 1
            if hidden:
                hidden = None if name == "/" + hidden else hidden
            elif name in ("script", "style", "noscript", "template", "title"):
                hidden = name
            elif name.lstrip("/") in warc.BREAKS:
                out.append("\n")
        else:
            out.append("" if hidden else page[at])
            at += 1
    import html

    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x)


def test_small_pages_by_brute_force():
    import random

    rng = random.Random(6)
    bits = ["<p>", "</p>", "<b>", "</b>", "<br>", "word", " ", "\n", "&amp;", "&lt;", "<!-- c -->", "<div class='x'>", "</div>", "<style>p</style>", "<script>x</script>", "<title>t</title>", "1 < 2", "é", "<li>", "</LI>"]
    for _ in range(400):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert warc.plain_text(page.encode()) == slow_text(page)
