"""One pass over HTML, linear whatever the page: tags and texts in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

OPEN, CLOSE, TEXT = "open", "close", "text"
#: Behind the name: attributes, whose values may hold > in quotes; no way back, so it is linear.
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)*+)>")
_VALUE = re.compile(r"([^\s\"'>/=]++)(\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
#: Elements whose content is text without tags, up to their end tag.
RAW = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
#: Elements that may stand in the head; any other ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def attributes(raw: str) -> dict[str, str]:
    """Attributes with a value, names in lower case, the first of equal names."""
    out: dict[str, str] = {}
    for name, given, *values in _VALUE.findall(raw):
        if given:
            out.setdefault(name.lower(), "".join(values))
    return out


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """(OPEN, name, raw attributes), (CLOSE, name, ''), (TEXT, text with its character references, '').

    Comments, declarations and processing instructions are passed over; one without an end reaches
    to the end of the page, like a tag without an end. The content of RAW elements is one text.
    A < that opens nothing is text.
    """
    at = begin = 0
    while (mark := page.find("<", at)) >= 0:
        after = page[mark + 1 : mark + 2]
        if after in ("!", "?") or (after == "/" and not page[mark + 2 : mark + 3].isalpha()):
            if begin < mark:
                yield TEXT, page[begin:mark], ""
            comment = page.startswith("<!--", mark)
            if comment and page.startswith((">", "->"), mark + 4):
                stop = page.find(">", mark) + 1
            else:
                end = page.find("-->", mark + 4) if comment else page.find(">", mark)
                stop = end + (3 if comment else 1) if end >= 0 else len(page)
            at = begin = stop
            continue
        if not (after == "/" or (after.isascii() and after.isalpha())):
            at = mark + 1
            continue
        if begin < mark:
            yield TEXT, page[begin:mark], ""
        found = _TAG.match(page, mark)
        if not found:
            if page.find(">", mark) < 0 or (after != "/" or page[mark + 2].isascii()):
                return
            at = begin = page.find(">", mark) + 1  # </ and a letter that names no element: a comment
            continue
        name = found[1].lower()
        at = begin = found.end()
        if after == "/":
            yield CLOSE, name, ""
            continue
        yield OPEN, name, found[2]
        if name in _ENDS:
            end = _ENDS[name].search(page, at)
            stop = end.start() if end else len(page)
            if at < stop:
                yield TEXT, page[at:stop], ""
            at = begin = stop
        elif name == "plaintext":
            break
    if begin < len(page):
        yield TEXT, page[begin:], ""
