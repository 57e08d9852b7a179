"""WARC derivatives: each response becomes a metadata and a plain-text conversion record that refer to it.

Records are rows (headers as an ordered array of name and value, the block as bytes), and `serialized` makes the WARC/1.1 bytes
of one, so that a partition's records joined are a WARC file. Identifiers are made from the content, so a repeated run gives the
same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs
DATE = "1970-01-01T00:00:00Z"  # of responses whose time isn't known
_TEXTS = ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type")
_DIGESTS = ("block_digest", "payload_digest", "refers_to_payload_digest")
_HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in _TEXTS),
        T.StructField("content_length", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in _DIGESTS),
        T.StructField("headers", T.ArrayType(_HEADER)),
        T.StructField("block", T.BinaryType()),
    ]
)
MEMBERS = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("member", T.BinaryType())])
HIDDEN = ("script", "style", "noscript", "template", "svg")
# Each pattern is tried on a page up to its last `>` only, so that `[^>]*>` always finds its end and no place is looked at again.
HIDE = re.compile(rf"<!--|<({'|'.join(HIDDEN)})\b[^>]*>", re.I)
CLOSE = {"!": re.compile("-->")} | {x: re.compile(rf"</{x}\s*>", re.I) for x in HIDDEN}
BREAKS = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|title|head|body|html|blockquote|pre|form|option|dt|dd)\b[^>]*>", re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
HTML, ANCHOR, TITLE, TITLE_END = (re.compile(x, re.I) for x in (r"<html\b[^>]*>", r"<a\b[^>]*>", r"<title\b[^>]*>", r"</title\s*>"))
VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
LANG, LINK = re.compile(r"\blang" + VALUE, re.I), re.compile(r"\bhref" + VALUE, re.I)
UNSAFE = re.compile("[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key: str, data: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {key} {hashlib.sha256(data).hexdigest()}')}>"


class Page:
    """A page's text, title, language and links, in time in proportion to its length, however broken it is.

    Comments and hidden elements (scripts, styles and the like) are left out with their content, and one without an end is a mere tag. A tag
    ends at the next `>`; a `<` without one, or before other than a letter, `/`, `!` or `?`, is text.
    """

    def __init__(self, page: str):
        shown = self._shown(page)
        end = shown.rfind(">") + 1
        tags, rest = shown[:end], shown[end:]
        lines = (" ".join(x.split()) for x in unescaped(TAG.sub(" ", BREAKS.sub("\n", tags)) + rest).split("\n"))
        self.text = "\n".join(x for x in lines if x)
        first = TITLE.search(tags)
        last = TITLE_END.search(tags, first.end()) if first else None
        self.title = " ".join(unescaped(TAG.sub(" ", tags[first.end() : last.start()])).split()) if last else None
        html_tag = HTML.search(tags)
        lang = LANG.search(html_tag[0]) if html_tag else None
        self.lang = lang[1] or lang[2] or lang[3] if lang else None
        links = (LINK.search(m[0]) for m in ANCHOR.finditer(tags))
        self.links = [unescaped(m[1] or m[2] or m[3] or "") for m in links if m]

    @staticmethod
    def _shown(page: str) -> str:
        """The page with a blank for each comment and hidden element. Where the next end of a kind is, or that there is none, is found once."""
        parts, kept, at, limit = [], 0, 0, page.rfind(">") + 1
        ends: dict[str, re.Match | None] = {}
        while begin := HIDE.search(page, at, limit):
            at, name = begin.end(), (begin[1] or "!").lower()
            if name != "!" and begin[0].endswith("/>"):
                continue
            if name not in ends or ends[name] is not None and ends[name].start() < at:
                ends[name] = CLOSE[name].search(page, at)
            if ends[name] is not None:
                parts.append(page[kept : begin.start()])
                kept = at = ends[name].end()
        parts.append(page[kept:])
        return " ".join(parts)


def unescaped(text: str) -> str:
    """Character references decoded; numbers too long for any character are cut first, since they would take long to read."""
    return html.unescape(re.sub("&#[0-9]{9,}", "&#999999999", text))


def plain_text(page: str) -> str:
    """The text of a page: no scripts, styles and comments, a line for each block element, a blank for other tags, entities decoded, blanks of a line joined."""
    return Page(page).text


def header_safe(value: str) -> str:
    """A value without blanks and control characters, which would end or forge header lines: each becomes %XX."""
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def headers_of(row: dict) -> list[dict]:
    named = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Block-Digest", row["block_digest"]), ("WARC-Payload-Digest", row["payload_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"])),
    ]
    return [{"name": n, "value": v} for n, v in named if v is not None]


def response(page_id: int | None, url: str | None, page: str, date: str) -> dict:
    payload = page.encode("utf-8", "surrogatepass")
    url = None if url is None else header_safe(url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    row = {"page_id": page_id, "record_type": "response", "refers_to": None, "target_uri": url, "date": date, "content_type": "application/http; msgtype=response", "refers_to_payload_digest": None}
    row |= {"record_id": record_id("response", f"{page_id} {url} {date}", payload), "content_length": len(head) + len(payload), "block_digest": digest(head + payload), "payload_digest": digest(payload), "block": head + payload}
    return row | {"headers": headers_of(row)}


def derived(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response: they keep its identifier, address, date, HTTP headers and payload digest."""
    head, _, payload = source["block"].partition(b"\r\n\r\n")
    page = payload.decode("utf-8", "replace")
    http = [x.partition(":")[::2] for x in head.decode("latin-1").split("\r\n")[1:]]
    seen = Page(page)
    fields = {
        "title": seen.title,
        "languages": seen.lang,
        "outlinks": seen.links,
        "source-http-headers": {k.strip(): v.strip() for k, v in http},
        "source-content-length": len(payload),
        "source-payload-digest": source["payload_digest"],
        "source-block-digest": source["block_digest"],
    }
    blocks = {"metadata": ("application/json", json.dumps(fields, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")), "conversion": ("text/plain", seen.text.encode("utf-8", "surrogatepass"))}
    out = []
    for kind, (content_type, block) in blocks.items():
        row = {"page_id": source["page_id"], "record_type": kind, "refers_to": source["record_id"], "target_uri": source["target_uri"], "date": source["date"], "content_type": content_type, "block": block}
        row |= {"record_id": record_id(kind, source["record_id"], block), "content_length": len(block), "block_digest": digest(block), "payload_digest": digest(block), "refers_to_payload_digest": source["payload_digest"]}
        out.append(row | {"headers": headers_of(row)})
    return out


def serialized(row: dict) -> bytes:
    """One record as WARC/1.1 bytes."""
    return b"WARC/1.1\r\n" + "".join(f"{h['name']}: {h['value']}\r\n" for h in row["headers"]).encode() + b"\r\n" + row["block"] + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[dict]:
    """The records of some WARC bytes: headers (in order) and block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = [{"name": n, "value": v.strip(" \t")} for n, v in (x.split(":", 1) for x in lines[1:])]
        size = int(next(h["value"] for h in headers if h["name"].lower() == "content-length"))
        yield {"version": lines[0], "headers": headers, "block": data[end + 4 : end + 4 + size]}
        at = end + 4 + size + 4


def _rows(pages: DataFrame, make, columns: tuple[str, ...], most: int = 256) -> DataFrame:
    arrow = to_arrow_schema(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                out = [r for row in batch.slice(low, most).to_pylist() for r in make(row)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pages.select(*columns).mapInArrow(run, RECORDS)


def responses(pages: DataFrame, url: str = "url", page: str = "html", id_column: str = "page_id", date: str = DATE) -> DataFrame:
    """One response record for every page. A null page is an empty one; a null address leaves its header out; blanks and control characters in one become %XX."""
    named = pages.select(F.col(id_column).cast("long").alias("i"), F.col(url).cast("string").alias("u"), F.col(page).cast("string").alias("h"))
    return _rows(named, lambda r: [response(r["i"], r["u"], r["h"] or "", date)], ("i", "u", "h"))


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of every response among some records; other records give none.

    A response without a block is an empty page. Repeated responses give repeated records with the same identifiers. Each row is
    made from one row, whatever its length; nothing is shuffled.
    """
    needed = ("page_id", "record_id", "target_uri", "date", "payload_digest", "block_digest", "block")
    return _rows(records.where("record_type = 'response'"), lambda r: derived(r | {"block": r["block"] or b""}), needed)


def built(pages: DataFrame, url: str = "url", page: str = "html", id_column: str = "page_id", date: str = DATE) -> DataFrame:
    """The metadata and conversion records of every page, by way of its response, in one pass."""
    named = pages.select(F.col(id_column).cast("long").alias("i"), F.col(url).cast("string").alias("u"), F.col(page).cast("string").alias("h"))
    return _rows(named, lambda r: derived(response(r["i"], r["u"], r["h"] or "", date)), ("i", "u", "h"))


def members(records: DataFrame) -> DataFrame:
    """record_id and each record as its own gzip member, as .warc.gz files hold them (join a partition's members for a file)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"record_id": r["record_id"], "member": gzip.compress(serialized(r), 6, mtime=0)} for r in rows], schema=to_arrow_schema(MEMBERS))

    return records.select("record_id", "headers", "block").mapInArrow(run, MEMBERS)
