"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record.

Both refer to their response by its record id, keep its address and date, and carry its payload digest; the metadata
record also keeps all headers of the response, of the record and of the HTTP message, and what links the page has.
Ids of derivatives follow from the id of the response, so that a repeated run gives the same records.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.frames import slices

EPOCH = "1970-01-01T00:00:00Z"
_SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, block_digest string, content_length long, headers map<string,string>, block string"
)
_NAMES = [x.split(" ")[0] for x in _SCHEMA.split(", ")]

# A tag ends at the next > or, if that is missing, where another one begins: so a page of unclosed tags is read once.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|td|th|thead|tbody|section|article|header|footer|nav|main|aside|pre|blockquote|form|title|body|html)\b[^<>]*>",
    re.I,
)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>|<![^<>]*>|<\?[^<>]*>")
_LINK = re.compile(r"<(a|link|img|script|iframe|area|form)\b([^<>]*)>", re.I)
_ATTRIBUTE = re.compile(r"(?<![\w:-])([A-Za-z][\w:-]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title\s*>", re.I)
_META = re.compile(r"<meta\b([^<>]*)>", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_TARGETS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}


def responses(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str | Column = EPOCH) -> DataFrame:
    """``page_id`` and ``record``, the bytes of a WARC response record, of each page.

    A null address or page is empty. The record id follows from key, address and page, so repeated rows have equal records.
    """
    page = df.select(F.col(f"`{key}`").alias("page_id"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((url, "_url"), (body, "_body"))], (date if isinstance(date, Column) else F.lit(date)).alias("_date"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("_body").cast("string"),
        F.lit("\r\n\r\n"),
        F.col("_body"),
    )
    page = page.withColumn("_http", http)
    digest = F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), "_url", "_body"))
    made = F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")
    # an address stays on its line
    where = F.regexp_replace("_url", r"[\r\n]+", " ")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), made),
        F.concat(F.lit("WARC-Date: "), "_date"),
        F.concat(F.lit("WARC-Target-URI: "), where),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(F.col("_body").cast("binary"), 256)),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(F.col("_http").cast("binary"), 256)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("_http").cast("string")),
        F.lit(""),
        F.col("_http"),
    )
    return page.select("page_id", F.concat(head, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``record`` of every record in WARC files, plain or gzipped record by record; a task reads whole files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for record in split_records(unzipped(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([record], pa.binary())], ["path", "record"])

    return files.mapInArrow(run, "path string, record binary")


def unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def split_records(data: bytes) -> Iterator[bytes]:
    """Records of a file one after another, by their content lengths; stops where no further record begins."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        split = data.find(b"\r\n\r\n", start)
        if split < 0:
            return
        length = headers_of(data[start:split])[1].get("content-length", "0")
        at = split + 4 + (int(length) if length.isdigit() else 0)
        yield data[start:at] + b"\r\n\r\n"


def headers_of(block: bytes) -> tuple[str, dict[str, str], dict[str, str]]:
    """First line, headers by lower-cased name, and headers as written; folded lines are joined, of repeated ones the last counts."""
    lines = re.sub(r"\r?\n[ \t]+", " ", block.decode("utf-8", "replace")).split("\n")
    shown: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            shown[name.strip()] = value.strip()
    return lines[0].strip(), {k.lower(): v for k, v in shown.items()}, shown


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data
        if not size:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def payload_of(http: dict[str, str], body: bytes) -> bytes:
    """The body of an HTTP message without transfer and content coding; one that can't be undone stays."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    try:
        match http.get("content-encoding", "").lower():
            case "gzip" | "x-gzip":
                return gzip.decompress(body)
            case "deflate":
                return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def decoded(http: dict[str, str], payload: bytes) -> str:
    """A payload as text, by the character set of its header or of its first kilobyte, else UTF-8."""
    found = _CHARSET.search(http.get("content-type", "").encode()) or _CHARSET.search(payload[:1024])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """The visible text of a page: a line for each block, white space inside a line as one space, no empty lines."""
    page = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", page)))
    lines = (" ".join(line.split()) for line in html.unescape(page).split("\n"))
    return "\n".join(line for line in lines if line)


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(tag)}


def _joined(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def page_metadata(page: str, base: str) -> dict:
    """Title, meta tags and links (with absolute addresses) of a page."""
    visible = re.sub(r"<!--.*?(?:-->|\Z)", "", page, flags=re.S)
    title, end = _TITLE.search(visible), None
    if title:
        end = _TITLE_END.search(visible, title.end())
    outside = _HIDDEN.sub(lambda m: re.match(r"<[^<>]*>|", m[0])[0] if m[1] else "", visible)
    links = []
    for m in _LINK.finditer(outside):
        name = m[1].lower()
        at = _attributes(m[2])
        if link := at.get(_TARGETS[name]):
            links.append({"path": f"{name.upper()}@/{_TARGETS[name]}", "url": _joined(base, link)})
    metas = [a for m in _META.finditer(outside) if (a := _attributes(m[1]))]
    return {"Title": " ".join(html.unescape(visible[title.end() : end.start()]).split()) if end else None, "Metas": metas, "Links": links}


def derivatives(record: bytes) -> list[tuple]:
    """The metadata and the conversion record of a response; none of another record or of bytes that are no record."""
    head, _, block = record.partition(b"\r\n\r\n")
    first, lower, shown = headers_of(head)
    if not first.startswith("WARC/") or lower.get("warc-type") != "response":
        return []
    length = lower.get("content-length", "")
    block = block[: int(length)] if length.isdigit() else block
    http_head, _, body = block.partition(b"\r\n\r\n")
    status, http, http_shown = headers_of(http_head)
    payload = payload_of(http, body)
    uri, source, date = lower.get("warc-target-uri", ""), lower.get("warc-record-id", ""), lower.get("warc-date", EPOCH)
    page = decoded(http, payload)
    told = lower.get("warc-payload-digest") or "sha256:" + hashlib.sha256(payload).hexdigest()
    meta = {
        "Source-Headers": shown,
        "HTTP-Status": status,
        "HTTP-Headers": http_shown,
        "Payload-Length": len(payload),
        "HTML": page_metadata(page, uri),
    }
    out = []
    for kind, form, content in (
        ("metadata", "application/json", json.dumps(meta, ensure_ascii=False)),
        ("conversion", "text/plain; charset=utf-8", plain_text(page)),
    ):
        raw = content.encode("utf-8", "replace")
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"
        digest = "sha256:" + hashlib.sha256(raw).hexdigest()
        out.append((kind, own, source, uri, date, form, told, digest, len(raw), shown, raw.decode()))
    return out


def derive(df: DataFrame, record: str = "record", key: str = "page_id") -> DataFrame:
    """Two rows, a metadata and a conversion record, for each row with a response record.

    Columns: the key, record_type, record_id, refers_to, target_uri, date, content_type, payload_digest (of the response),
    block_digest, content_length, headers (of the response record) and block. Other records, null and malformed
    ones give no rows; an empty page gives an empty block. Pages of any length are read whole. Other columns are not read.
    """
    rows = df.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{record}`").cast("binary").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "record"):
                row, made = [], []
                for i, raw in enumerate(part.column("record").to_pylist()):
                    for x in derivatives(raw or b""):
                        row.append(i)
                        made.append(x)
                columns = list(zip(*made, strict=True)) or [()] * len(_NAMES)
                arrays = [part.column("page_id").take(pa.array(row, pa.int32()))]
                for name, values in zip(_NAMES, columns, strict=True):
                    kind = pa.map_(pa.string(), pa.string()) if name == "headers" else pa.int64() if name == "content_length" else pa.string()
                    arrays.append(pa.array([[*v.items()] for v in values] if name == "headers" else values, kind))
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", *_NAMES])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, {_SCHEMA}")


def serialised(df: DataFrame) -> DataFrame:
    """Add ``record``, the bytes of each derivative as a WARC record."""
    lines = [
        F.lit("WARC/1.1"),
        *[
            F.concat(F.lit(f"{name}: "), F.col(column).cast("string"))
            for name, column in (
                ("WARC-Type", "record_type"),
                ("WARC-Record-ID", "record_id"),
                ("WARC-Refers-To", "refers_to"),
                ("WARC-Target-URI", "target_uri"),
                ("WARC-Date", "date"),
                ("WARC-Payload-Digest", "payload_digest"),
                ("WARC-Block-Digest", "block_digest"),
                ("Content-Type", "content_type"),
                ("Content-Length", "content_length"),
            )
        ],
        F.lit(""),
        F.col("block"),
    ]
    return df.withColumn("record", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary"))
