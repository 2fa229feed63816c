"""Operator 7, WARC: a derivative builder.

Every response record gets a metadata record (title, links, status and HTTP headers as JSON) and, if its payload is text, a
conversion record of plain text. Both refer to the response by its record id and carry its own URI, date and payload digest.
Responses come from WARC files (``read_warc``) or are made of a table of pages (``responses``); derivatives are built from
the parsed records either way.

Cases: a null page body is an empty payload; a null url is an empty target URI, left out of the record; blanks and control
characters of a URL are percent-encoded, line ends in other header values are blanks; a page repeated with equal id, url and
body gets equal records; records other than responses have no derivatives; a response whose payload is no text gets no
conversion record; an empty table gives an empty table; a record is held whole in memory, a file isn't, and a very long page
is read in time linear in its length; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import markup
from weftgraph.llm.common import SLICE_ROWS, emit, flat_map_rows, map_rows, small_batches

CRLF = "\r\n"
#: The date of responses that are made of pages, which carry none.
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:weftgraph:warc")
CONTROL = re.compile(r"[\x00-\x20\x7f]")
LINE_END = re.compile(r"[\r\n]+")
TEXTS = ("text/html", "application/xhtml+xml", "text/plain")
#: Between the block of a record and the version of the next.
BETWEEN = b"\r\n\r\nWARC/"


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(*parts: str) -> str:
    """A stable id: equal inputs get equal ids, so rebuilt tasks write the same records."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the blank lines that close it; headers without a value are left out."""
    head = "".join(f"{k}: {LINE_END.sub(' ', v)}{CRLF}" for k, v in headers if v)
    return f"WARC/1.1{CRLF}{head}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; what follows the block is not read."""
    end = data.index(b"\r\n\r\n")
    headers: dict[str, str] = {}
    for line in data[:end].decode(errors="replace").split(CRLF)[1:]:
        name, _, value = line.partition(":")
        headers[name.strip()] = value.strip()
    size = int(headers["Content-Length"])
    return headers, data[end + 4 : end + 4 + size]


def response(page_id, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """The response record that a page would have come as."""
    url, payload = CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", (url or "").strip()), (html or "").encode()
    block = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode() + payload
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url, html or "")), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
    ], block)


def http_message(headers: dict[str, str], block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, HTTP headers, payload) of a response's block; a block without HTTP is the payload itself."""
    if not headers.get("Content-Type", "").startswith("application/http"):
        return "", [("Content-Type", headers.get("Content-Type", ""))], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split(CRLF)
    pairs = [(n.strip(), v.strip()) for n, sep, v in (x.partition(":") for x in lines) if sep]
    return status, pairs, payload


def body(http: list[tuple[str, str]], payload: bytes) -> tuple[str, str]:
    """(media type, text) of a payload; text is empty unless the type is one of TEXTS. Damaged encodings are read as far as they go."""
    have = {n.lower(): v for n, v in http}
    kind, _, rest = have.get("content-type", "").partition(";")
    kind = kind.strip().lower()
    if kind not in TEXTS:
        return kind, ""
    if "chunked" in have.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    coding = have.get("content-encoding", "").strip().lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(31 if "gzip" in coding else 15).decompress(payload)
        except zlib.error:
            return kind, ""
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", rest, re.I)
    try:
        return kind, payload.decode(charset[1] if charset else "utf-8", errors="replace")
    except LookupError:
        return kind, payload.decode(errors="replace")


def unchunked(payload: bytes) -> bytes:
    out, at = [], 0
    while (line := payload.find(b"\r\n", at)) >= 0:
        try:
            size = int(payload[at:line].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(payload[line + 2 : line + 2 + size])
        at = line + 4 + size
    return b"".join(out)


def derive(headers: dict[str, str], block: bytes) -> Iterator[tuple[str, bytes]]:
    """(type, record) of a response's metadata and conversion records."""
    if headers.get("WARC-Type") != "response":
        return
    rid, url, date = (headers.get(x, "") for x in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    status, http, payload = http_message(headers, block)
    hashed = headers.get("WARC-Payload-Digest") or digest(payload)
    kind, content = body(http, payload)
    title, text, links = ("", content, []) if kind == "text/plain" else markup.read(content, url)
    about = {
        "Title": title, "Links": links, "Status": status, "Response-Headers": http,
        "Source": {"WARC-Record-ID": rid, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": hashed},
    }
    made = [("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode(errors="replace"))]
    if kind in TEXTS:
        made.append(("conversion", "text/plain", text.encode(errors="replace")))
    for name, mime, out in made:
        yield name, record([
            ("WARC-Type", name), ("WARC-Record-ID", record_id(name, rid)), ("WARC-Refers-To", rid), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("WARC-Source-Payload-Digest", hashed), ("WARC-Block-Digest", digest(out)), ("Content-Type", mime),
        ], out)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and the response record of every page."""
    return map_rows(pages.select("page_id", "url", "html"), lambda: lambda i, url, html: (i, response(i, url, html, date)), "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """(source, type, record) of the derivatives of all responses among parsed records (headers as JSON, block)."""

    def make():
        def both(headers, block):
            own = json.loads(headers)
            return ((own.get("WARC-Record-ID"), kind, out) for kind, out in derive(own, bytes(block)))

        return both

    return flat_map_rows(records.select("headers", "block"), make, "source string, type string, record binary")


def digests(pages: DataFrame) -> DataFrame:
    """One row a page: what its derivatives, built from its parsed response record and parsed again, say and hash to."""

    def make():
        def one(page_id, url, html):
            source, block = parse(response(page_id, url, html))
            (_, about), (_, converted) = derive(source, block)
            (meta, told), (text, plain) = parse(about), parse(converted)
            fields = json.loads(told)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return (
                page_id, url, source["WARC-Record-ID"], meta["WARC-Record-ID"], text["WARC-Record-ID"], text["WARC-Refers-To"], text["WARC-Source-Payload-Digest"],
                fields["Title"], len(fields["Links"]), len(plain.decode()), sha(plain), sha(told), sha(about), sha(converted),
            )

        return one

    schema = "page_id long, url string, response_id string, metadata_id string, conversion_id string, refers_to string, payload_digest string, title string, n_links long, text_chars long, text_sha256 string, metadata_sha256 string, metadata_record_sha256 string, conversion_record_sha256 string"
    return map_rows(pages.select("page_id", "url", "html"), make, schema)


def member(data: bytes) -> bytes:
    """A gzip member of its own, without its last byte, which is zero: the high byte of a size below 16 MB."""
    out = gzip.compress(data + b"\r\n\r\n", mtime=0)
    return (out if out[-1] == 0 else out + gzip.compress(b"", mtime=0))[:-1]


def write_warc(records: DataFrame, path: str, compressed: bool = True) -> None:
    """Write a ``record`` column as WARC files, each record a gzip member.

    Spark's text writer puts the bytes; what it adds to a row is the last byte of the member, or the two line ends of a plain record.
    """
    rows = records.select("record")
    if compressed:
        rows = map_rows(rows, lambda: lambda data: (member(bytes(data)),), "record binary")
    rows.select(F.col("record").cast("string")).write.option("lineSep", "\x00" if compressed else CRLF * 2).text(path)
    spark = records.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for x in files.listStatus(at):
        name = x.getPath().getName()
        if name.endswith(".txt"):
            files.rename(x.getPath(), at.suffix(f"/{name[:-4]}.warc" + ".gz" * compressed))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers (map as JSON) and block of every record of the WARC files below ``path``, read record by record.

    Rows are what lies between starts of records. Where a block itself holds such a start, the rows are joined again by its
    Content-Length. A plain file can be split there; such a record, cut between two tasks, is an error, not a loss.
    """
    rows = spark.read.option("lineSep", BETWEEN.decode()).text(path)
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    rows = rows.select(F.col("value").cast("binary").alias("value"), place.alias("place"))
    arrow = pa.schema([("headers", pa.string()), ("block", pa.binary())])

    def complete(data: bytes) -> bool:
        end = data.find(b"\r\n\r\n")
        size = re.search(rb"\r\ncontent-length:\s*(\d+)", data[:end] if end >= 0 else b"", re.I)
        return bool(size) and len(data) - end - 4 >= int(size[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = b"", None
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                out = []
                for value, place in zip(*(c.to_pylist() for c in batch.slice(begin, SLICE_ROWS).columns), strict=True):
                    if held and place != at:
                        raise ValueError(f"a record of {at} isn't whole")
                    held, at = held + BETWEEN + value if held else value, place
                    if complete(held):
                        headers, block = parse(held)
                        out.append((json.dumps(headers), block))
                        held = b""
                    elif not held.strip():
                        held = b""
                if out:
                    yield emit(out, arrow)
        if held:
            raise ValueError(f"a record of {at} isn't whole")

    return small_batches(rows).mapInArrow(run, "headers string, block binary")
