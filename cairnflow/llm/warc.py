"""WARC derivatives: metadata and plain-text conversion records from responses.

``responses`` writes pages as WARC/1.1 response records; ``derive`` reads any response
records and makes of each a metadata record and a conversion record.  Both refer to the
response by its identifier, share its target and date, carry over its other source headers
with the prefix ``WARC-Source-`` and the digests of its block and payload, and have digests
of their own.  Transfer and content encodings are undone first; a payload that isn't text
(an image, say) gets a metadata record alone.  Identifiers are made from content, so a task
that runs again makes the same.  One pass, no shuffle; text is taken out in linear time.
"""

from __future__ import annotations

import re
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterator
from hashlib import sha1
from html import unescape
from uuid import UUID

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, strings

VERSION = b"WARC/1.1"
#: Headers of a record that its derivatives state under their own names.
OWN = {"warc-type", "warc-record-id", "content-length", "content-type", "warc-date", "warc-target-uri", "warc-block-digest", "warc-payload-digest"}
#: Elements whose content isn't shown, and those whose content has no tags.
HIDDEN, BARE = ("script", "style"), ("title", "textarea")
BLOCKS = frozenset("p div br hr li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer blockquote pre title head body".split())
#: What ``<`` opens: a tag with its attributes, up to its end or the page's (or a quote that opens no value), a comment, or a declaration.
MARK = re.compile(r"""<(?:(/?[A-Za-z][^\s/>]*+)((?>[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>|\Z)?+|!--|[!?])""")
#: In a tag: its end, or the quote that opens a value.
STOP = re.compile(r""">|=\s*["']""")
HREF = re.compile(r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
CLOSES = {tag: re.compile(f"(?i)</{tag}") for tag in HIDDEN + BARE}
SPACE = re.compile(r"[ \t\r\f\v]+")
CHARSET = re.compile(rb"(?i)charset\s*=\s*[\"']?([\w.:-]+)")
#: What has text to convert, besides all of text/*.
TEXTUAL = re.compile(r"(?i)^\s*(?:text/|application/(?:xhtml\+xml|xml|json|javascript|[\w.-]+\+(?:xml|json))\b)")
MARKUP = re.compile(r"(?i)html|xml")


def digest(data: bytes) -> str:
    return "sha1:" + b32encode(sha1(data).digest()).decode()


def identifier(*parts: bytes) -> str:
    """urn:uuid of the content, as a version 5 UUID is made of a hash."""
    h = bytearray(sha1(b"\0".join(parts)).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x50, h[8] & 0x3F | 0x80
    return f"<urn:uuid:{UUID(bytes=bytes(h))}>"


def one_line(value: str) -> str:
    """A header's value can't hold line ends."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {one_line(v)}".encode("utf-8", "replace") for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block) of a record; ValueError if it is none, or its block is cut short."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and headers:  # a continued line
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}")
        else:
            name, colon, value = text.partition(":")
            if not colon:
                raise ValueError("a header without a colon")
            headers.append((name.strip(), value.strip()))
    length = int(value_of(headers, "Content-Length") or -1)
    if length < 0 or length > len(rest):
        raise ValueError("the block is cut short")
    return headers, rest[:length]


def value_of(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


class Page:
    """What one pass over a page's markup finds: its text, title and links.

    Tags are told from text as browsers do: ``<`` before a letter or a slash and a letter opens
    a tag, which ends at the first ``>`` outside quoted values; ``<!`` and ``<?`` open comments.
    What never ends hides the rest.  No place is searched twice for the same end, so time is
    linear whatever the page holds.
    """

    def __init__(self, html: str):
        self.html, self.none = html, set()  # ends that don't come any more
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title: str | None = None
        at = 0
        for_mark, parts = MARK.search, self.parts
        while True:
            m = for_mark(html, at)
            if m is None:
                parts.append(readable(html[at:]))
                break
            start = m.start()
            if start > at:
                parts.append(readable(html[at:start]))
            at = self.markup(m) if m[1] is None or m[3] is None else m.end()
            tag = m[1]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in SHOWN:
                parts.append("\n")
            elif tag == "a":
                link = HREF.search(html, m.end(1), at)
                if link:
                    self.links.append(unescape(next(x for x in link.groups() if x is not None)))
            if tag in CLOSES:
                at = self.content(tag, at)

    def after(self, end: str, at: int) -> int:
        """Past the next ``end`` from ``at`` on; past the page's end if there is none."""
        k = -1 if end in self.none else self.html.find(end, at)
        if k < 0:
            self.none.add(end)
            return len(self.html)
        return k + len(end)

    def markup(self, m: re.Match) -> int:
        """The place after a comment, a declaration, or a tag with a quote that opens no value."""
        if m[1] is None:
            return self.after("-->" if m[0] == "<!--" else ">", m.end())
        end = m.end()
        while True:
            stop = STOP.search(self.html, end)
            if stop is None:
                return len(self.html)
            end = stop.end()
            if stop[0] == ">":
                return end
            end = self.after(stop[0][-1], end)

    def content(self, tag: str, at: int) -> int:
        """Takes in what an element without tags holds; gives the place after its end."""
        close = None if tag in self.none else CLOSES[tag].search(self.html, at)
        if close is None:
            self.none.add(tag)
        stop = close.start() if close else len(self.html)
        if tag in BARE:
            inside = unescape(self.html[at:stop])
            self.parts.append(inside)
            if tag == "title":
                self.parts.append("\n")
                self.title = inside if self.title is None else self.title
        return self.after(">", close.end()) if close else stop

    def text(self) -> str:
        """What a reader sees: a line for each block, without blank lines."""
        return tidy("".join(self.parts))


SHOWN = BLOCKS | {f"/{tag}" for tag in BLOCKS}


def readable(text: str) -> str:
    return unescape(text) if "&" in text else text


def tidy(text: str) -> str:
    lines = map(str.strip, SPACE.sub(" ", text.replace("\xa0", " ")).split("\n"))
    return "\n".join([x for x in lines if x])


def plain_text(html: str) -> str:
    """What a reader sees: no scripts, styles, comments or tags; a line for each block, without blank lines."""
    return Page(html).text()


def unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; what isn't chunked is left as it is, as archives often keep it decoded."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at, at + 1024)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return data
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if at + n > len(data):
            return data
        out.append(data[at : at + n])
        at += n + 2


#: Bytes that a body may have once its content encodings are undone.
MOST_DECODED = 256 << 20
#: Encoded bytes that are undone at a time where a decoder doesn't bound what it gives.
PIECE = 1 << 10


def in_pieces(payload: bytes, start: Callable) -> bytes:
    """One or more streams of a decoder that ``start`` makes: it takes bytes, and says (what came out, whether it is at its end, bytes beyond).  Zeros may follow the last, as some archives pad."""
    out, size, at = [], 0, 0
    if payload.endswith(bytes(9)):  # a stream may end with up to eight
        payload = payload.rstrip(b"\0") + bytes(8)
    while at < len(payload) and not (at and payload.count(0, at, at + 9) == len(payload) - at):
        step, ended = start(), False
        while at < len(payload) and not ended:
            piece = payload[at : at + PIECE]
            got, ended, beyond = step(piece)
            at += len(piece) - len(beyond)
            size += len(got)
            out.append(got)
            if size > MOST_DECODED:
                raise ValueError("it is too long once decoded")
        if not ended:
            raise ValueError("it is cut")
    return b"".join(out)


def inflated(payload: bytes, kind: int) -> bytes:
    """One or more zlib, gzip or raw deflate streams; ``kind`` as zlib's wbits."""

    def start() -> Callable:
        stream = zlib.decompressobj(kind)
        return lambda piece: (stream.decompress(piece), stream.eof, stream.unused_data)

    return in_pieces(payload, start)


def unzstd(payload: bytes) -> bytes:
    import zstandard

    def start() -> Callable:
        stream = zstandard.ZstdDecompressor().decompressobj()
        return lambda piece: (stream.decompress(piece), stream.eof, stream.unused_data)

    try:
        return in_pieces(payload, start)
    except zstandard.ZstdError as e:
        raise ValueError(str(e)) from e


def unbrotli(payload: bytes) -> bytes:
    try:
        import brotli
    except ImportError as e:
        raise LookupError("isn't supported without the library brotli") from e

    def start() -> Callable:
        stream = brotli.Decompressor()
        return lambda piece: (stream.process(piece), stream.is_finished(), b"")

    try:
        return in_pieces(payload, start)
    except brotli.error as e:
        raise ValueError(str(e)) from e


def decoded(payload: bytes, encodings: str) -> bytes:
    """The payload without its content encodings; ValueError for one that isn't known, is broken or cut, or gives more than MOST_DECODED bytes.

    Streams that follow each other are all read.  An empty payload stays empty, and one that is
    said to be gzip but isn't stays as it is.
    """
    for name in reversed([x.strip().lower() for x in encodings.split(",")]):
        try:
            if not payload or name in ("", "identity"):
                continue
            if name in ("gzip", "x-gzip"):
                payload = inflated(payload, 31) if payload[:2] == b"\x1f\x8b" else payload
            elif name == "deflate":
                wrapped = len(payload) > 1 and payload[0] & 15 == 8 and int.from_bytes(payload[:2], "big") % 31 == 0
                payload = inflated(payload, 15 if wrapped else -15)
            elif name == "zstd":
                payload = unzstd(payload)
            elif name == "br":
                payload = unbrotli(payload)
            else:
                raise LookupError("isn't supported")
        except LookupError as e:
            raise ValueError(f"the content encoding {name} {e.args[0]}") from e
        except (ValueError, zlib.error) as e:
            raise ValueError(f"the content encoding {name} is broken: {e}") from e
    return payload


def field_of(head: bytes, name: str) -> str:
    """An HTTP header's value; empty without it."""
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.encode():
            return value.strip().decode("latin-1")
    return ""


def text_of(payload: bytes, kind: str) -> str:
    """The payload in its own character set: the header's, else the page's, else UTF-8."""
    said = CHARSET.search(kind.encode()) or CHARSET.search(payload, 0, 1024)
    try:
        return payload.decode(said[1].decode() if said else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def response(url: str, html: str, key: str, date: str) -> bytes:
    payload = html.encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", identifier(b"response", key.encode(), url.encode("utf-8", "replace"), payload)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Identified-Payload-Type", "text/html"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(headers, block)


def derivatives(data: bytes) -> dict[str, str | bytes | int | None]:
    """The metadata and conversion records of a response record, and what they state; without text no conversion."""
    headers, block = read_record(data)
    if (value_of(headers, "WARC-Type") or "").lower() != "response":
        raise ValueError("not a response")
    source, target, date = (value_of(headers, k) or "" for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        head, payload = b"", block
    found_block, found_payload = digest(block), digest(payload)
    stated = value_of(headers, "WARC-Payload-Digest"), value_of(headers, "WARC-Block-Digest")
    intact = stated[0] in (None, found_payload) and stated[1] in (None, found_block)
    kind = field_of(head, "content-type") or value_of(headers, "WARC-Identified-Payload-Type") or ("" if b"\0" in payload[:1024] else "text/html")
    body = payload if not head or "chunked" not in field_of(head, "transfer-encoding").lower() else unchunked(payload)
    intact = intact or stated[0] == digest(body) and stated[1] in (None, found_block)
    text, title, links = None, "", []
    if TEXTUAL.match(kind):
        content = text_of(decoded(body, field_of(head, "content-encoding")), kind)
        page = Page(content) if MARKUP.search(kind) else None
        text = page.text() if page else tidy(content)
        title, links = (one_line(page.title or ""), page.links) if page else ("", [])
    carried = [(f"WARC-Source-{k.removeprefix('WARC-')}", v) for k, v in headers if k.lower() not in OWN]
    carried += [("WARC-Source-Block-Digest", stated[1] or found_block), ("WARC-Source-Payload-Digest", stated[0] or found_payload)]
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source), *carried]

    conversion_id = conversion = found_words = None
    if text is not None:
        words = text.encode("utf-8", "replace")
        conversion_id, found_words = identifier(b"conversion", source.encode(), words), digest(words)
        conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *common, ("WARC-Block-Digest", found_words), ("WARC-Payload-Digest", found_words), ("Content-Type", "text/plain; charset=utf-8")], words)
    http = [x.decode("latin-1") for x in head.split(b"\r\n") if x]
    fields = [("title", title), ("digest-check", "pass" if intact else "fail")]
    fields += [("text-length", str(len(text))), ("conversion", conversion_id)] if text is not None else [("no-text", kind or "unknown type")]
    fields += [("http-status", http[0])] if http else []
    fields += [("http-header", one_line(x)) for x in http[1:]] + [("outlink", one_line(x)) for x in links]
    said = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    metadata_id = identifier(b"metadata", source.encode(), said)
    linked = [("WARC-Concurrent-To", conversion_id)] if conversion_id else []
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), *common, *linked, ("WARC-Block-Digest", digest(said)), ("Content-Type", "application/warc-fields")], said)
    return {
        "response_id": source, "target_uri": target, "warc_date": date, "source_payload_digest": stated[0] or found_payload, "source_block_digest": stated[1] or found_block,
        "intact": intact, "metadata_id": metadata_id, "conversion_id": conversion_id, "conversion_digest": found_words, "title": title, "n_links": len(links), "text": text,
        "metadata_record": metadata, "conversion_record": conversion, "error": None,
    }


DERIVED = "response_id string, target_uri string, warc_date string, source_payload_digest string, source_block_digest string, intact boolean, metadata_id string, conversion_id string, conversion_digest string, title string, n_links long, text string, metadata_record binary, conversion_record binary, error string"
KINDS = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", date_col: str | None = None) -> DataFrame:
    """One row per page: ``id_col`` and record, a WARC response.

    The record's date is ``date_col``'s (a timestamp), or ``date`` where there is none.  A null
    url or html counts as empty; ids may be null or repeated; other columns aren't read; an
    empty table gives an empty result; a page of any length is one record.
    """
    when = F.lit(date) if date_col is None else F.coalesce(F.date_format(F.to_utc_timestamp(F.col(date_col).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(date))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            made = [response(u, h, str(k), d) for k, u, h, d in zip(b.column(0).to_pylist(), strings(b.column(1)), strings(b.column(2)), b.column(3).to_pylist())]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["id", "record"])

        yield from map_slices(batches, "html", work)

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"), when.alias("date"))
    return rows.mapInArrow(run, f"id {kind}, record binary").withColumnRenamed("id", id_col)


def derive(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """One row per record: ``id_col`` and the columns of DERIVED.

    What can't be read as a response (null, empty or foreign bytes, a cut block) has null
    columns and says why in ``error``; no row is dropped.  ``intact`` tells whether the
    digests that the source states hold.  A payload that isn't text has no conversion: its
    columns and text are null, and error too.  Repeated rows give equal rows; an empty table
    gives an empty result; a long page takes time in proportion to its length.
    """
    fields = [f.split() for f in DERIVED.split(", ")]

    def row(data: bytes | None) -> dict:
        try:
            return derivatives(data or b"")
        except ValueError as e:
            return {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            made = [row(x) for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m.get(k) for m in made], KINDS[t]) for k, t in fields)], ["id", *(k for k, _ in fields)])

        yield from map_slices(batches, "record", work)

    kind = records.schema[id_col].dataType.simpleString()
    rows = records.select(records[id_col].alias("id"), records[record_col].alias("record"))
    return rows.mapInArrow(run, f"id {kind}, {DERIVED}").withColumnRenamed("id", id_col)
