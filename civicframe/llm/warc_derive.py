"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response record is parsed, its digests are checked, and two records are made from it.
Both carry ``WARC-Refers-To`` with the response's identifier, its target address and date; the
metadata record keeps the response's HTTP headers, title and outgoing links, the conversion
record the page's text, and it names the metadata record in turn (``WARC-Concurrent-To``).
Identifiers come from the response's own identifier, so a task that runs again makes the same records.

Spark deals out the records; each is converted by itself.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_blocks
from .common import arrow_text, freed, small_batches

VERSION = "WARC/1.1"
_END = b"\r\n\r\n"
_LINK = re.compile(r"""<a\s(?:[^>"']++|"[^"]*"|'[^']*')*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _one_line(value: str) -> str:
    """Header values hold no line breaks."""
    return " ".join(value.split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record; block digest and length are added to the headers."""
    lines = [VERSION, *(f"{k}: {_one_line(v)}" for k, v in headers), f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, plain or gzipped; raises ``ValueError`` if it is not whole."""
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError("broken gzip member") from e
    head, found, rest = raw.partition(_END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        raise ValueError("record cut short")
    block = rest[: int(length)]
    said = headers.get("warc-block-digest")
    if said and said.startswith("sha1:") and said != digest(block):
        raise ValueError("block digest differs")
    return headers, block


def response(url: str, payload: bytes, date: str, name: str) -> bytes:
    """A response record of a page; ``name`` makes its identifier."""
    http = "\r\n".join([
        "HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}",
    ]).encode() + _END + payload
    identifier = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {name} {digest(payload)}").urn
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<{identifier}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)),
    ], http)


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    head, found, payload = block.partition(_END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("HTTP/"):
        raise ValueError("no HTTP response")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def _text_of(payload: bytes, headers: list[tuple[str, str]]) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = _CHARSET.search(kind)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def links(html: str, base: str) -> list[str]:
    """Targets of the page's links in page order, resolved against its address; unusable ones are kept as they stand."""
    out = []
    for m in _LINK.finditer(html):
        target = unescape(m[1] or m[2] or m[3] or "").strip()
        try:
            out.append(urljoin(base, target))
        except ValueError:
            out.append(target)
    return out


def derive(raw: bytes) -> dict:
    """The two records of a response record and what they say; ``problem`` names why there are none."""
    out = dict.fromkeys(FIELDS)
    try:
        headers, block = parse(raw)
        if headers.get("warc-type") != "response" or not headers.get("warc-record-id"):
            raise ValueError("not a response record")
        status, http_headers, payload = _http(block)
        said = headers.get("warc-payload-digest")
        if said and said.startswith("sha1:") and said != digest(payload):
            raise ValueError("payload digest differs")
    except ValueError as e:
        return out | {"problem": str(e)}
    source, url = headers["warc-record-id"], headers.get("warc-target-uri", "")
    payload_digest = said or digest(payload)
    html = _text_of(payload, http_headers)
    text = "\n".join(b.text for b in html_blocks.cut(html))
    title = _TITLE.search(html)
    found = links(html, url)
    metadata_id, conversion_id = (f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}').urn}>" for kind in ("metadata", "conversion"))
    refers = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", headers.get("warc-date", ""))]
    fields = [
        ("source-status", status), *((f"source-header-{k}", v) for k, v in http_headers), ("source-payload-digest", payload_digest),
        ("source-block-digest", headers.get("warc-block-digest", digest(block))),
        ("title", unescape(title[1]) if title else ""), *(("outlink", f"{x} L a/@href") for x in found),
    ]
    about = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    common = [("WARC-Date", headers.get("warc-date", "")), ("WARC-Target-URI", url), *refers]
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), *common, ("Content-Type", "application/warc-fields")], about)
    body = text.encode("utf-8", "replace")
    conversion = record([
        ("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), ("WARC-Concurrent-To", metadata_id), *common,
        ("WARC-Source-Payload-Digest", payload_digest), ("Content-Type", "text/plain; charset=utf-8"),
    ], body)
    return out | {
        "response_id": source, "metadata_id": metadata_id, "conversion_id": conversion_id, "target_uri": url,
        "payload_digest": payload_digest, "text_digest": digest(body), "n_links": len(found), "text_chars": len(text),
        "metadata": metadata, "conversion": conversion,
    }


#: Columns of the result after the id.
FIELDS = {
    "response_id": "string", "metadata_id": "string", "conversion_id": "string", "target_uri": "string", "payload_digest": "string",
    "text_digest": "string", "n_links": "int", "text_chars": "long", "metadata": "binary", "conversion": "binary", "problem": "string",
}


def responses(
    pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Pages as response records: id, record.  A null page has an empty payload, a null address is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(arrow_text(batch.column(c)).to_pylist() for c in ("name", "url", "html")))
            found = [response(_one_line(u), h.encode("utf-8", "replace"), date, n) for n, u, h in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], [id_col, "record"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = small_batches(pages).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.col(url_col).alias("url"), F.col(html_col).alias("html"),
    )
    return rows.mapInArrow(freed(run), f"`{id_col}` {kind}, record binary")


def apply(records: DataFrame, *, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """One row per record: id, identifiers, digests, counts, the two records' bytes, and problem (null if converted).

    A null record, another type of record, or one that is cut short or does not match its digests has a problem and no
    derivatives.  Ids may be null or repeat; each record is converted by itself.  Other columns are not read.  An empty table
    gives an empty result.
    """

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [derive(r or b"") for r in batch.column("record").to_pylist()]
            columns = [pa.array([x.get(name) for x in found], kinds[kind]) for name, kind in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], [id_col, *FIELDS])

    kind = records.schema[id_col].dataType.simpleString()
    rows = small_batches(records).select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))
    return rows.mapInArrow(freed(run), f"`{id_col}` {kind}, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()))
