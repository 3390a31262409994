"""WARC archives through a chunked record table.

Writing: each partition of pages becomes WARC/1.1 files, records streamed out
in pieces; a payload that occurs again is written as a revisit record of the
one response that holds it.  Reading: a file is streamed in buffers of
``CHUNK`` bytes and every payload becomes rows (record, chunk number, bytes)
with a running SHA-1 of the payload up to that chunk, so neither the reader
nor a row ever holds a whole oversized record.

Files go to the shared folder under names of their own for each task attempt;
only files that a finished task reports are read, so a lost executor leaves
nothing behind that counts.  Files are opened through ``pyarrow.fs``, which
knows the shared folder's scheme.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import column, same, tmp

CHUNK = 1 << 20
#: Bytes after which a task begins another file.
FILE_BYTES = 256 << 20
_CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
CHUNKS = ("path string, offset long, page_id string, record_type string, refers_to string, digest string, "
          "chunk int, chunk_bytes long, total_bytes long, data binary, running_digest string, is_last boolean")


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)


def base32_sha1(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def plan_records(pages: DataFrame, key: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """``pages`` plus ``record_type`` and ``refers_to``.

    Of the rows whose payloads (html in UTF-8, null: empty) are equal and at
    least ``min_bytes`` long, the one with the largest key is the response and
    the others revisit it; rows that repeat the largest key are all responses,
    and null keys rank below all others (several null keys only: all
    responses).  Copies meet as digests in an aggregate, never as payloads.
    """
    digest, size = tmp("digest"), tmp("size")
    payload = F.coalesce(column(pages, html), F.lit("")).cast("binary")
    d = pages.select(*[column(pages, c) for c in pages.columns if c not in ("record_type", "refers_to")],
                     F.sha1(payload).alias(digest), F.octet_length(payload).alias(size))
    often = d.where(F.col(size) >= min_bytes).groupBy(F.col(digest).alias("again")).agg(
        F.max(column(d, key)).alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null")
    often = materialize(often.select("again", "response"), "warc-copies")
    revisit = F.col("response").isNotNull() & ~same(column(d, key), F.col("response"))
    return d.join(often, d[digest] == often["again"], "left").select(
        *[column(d, c) for c in d.columns if c not in (digest, size)],
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response")).alias("refers_to"))


def _record_id(key) -> str:
    """The record of a page; rows that repeat a key repeat it."""
    return "<urn:uuid:%s>" % uuid.uuid5(uuid.NAMESPACE_URL, f"page:{key}")


def write_archives(records: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                   chunk: int = CHUNK, file_bytes: int = FILE_BYTES, folder: str | None = None) -> DataFrame:
    """Write rows of ``plan_records`` as WARC files; the table of files (path, records, bytes).

    A response's block is an HTTP response with the html as its payload; a
    revisit (identical payload digest) has an empty block, the payload's
    digest and the response's record.  Null keys have no ``Page-ID`` header.
    """
    folder = folder or scratch_path(records.sparkSession, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for pdf in batches:
            for page, link, text, kind, refers in zip(*(pdf[c] for c in pdf.columns), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc"
                    out, n, size = fs.open_output_stream(_fs(path)[1]), 0, 0
                text = text if isinstance(text, str) else ""
                sha, total = hashlib.sha1(), 0
                for k in range(0, len(text), chunk):
                    piece = text[k:k + chunk].encode("utf-8", "surrogatepass")
                    sha.update(piece)
                    total += len(piece)
                http = b"" if kind == "revisit" else _HTTP % total
                block = 0 if kind == "revisit" else len(http) + total
                page = int(page) if isinstance(page, str) else None
                head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page)}",
                        "WARC-Date: 1970-01-01T00:00:00Z",
                        f"WARC-Payload-Digest: sha1:{base32_sha1(sha)}", f"Content-Length: {block}"]
                if isinstance(link, str):
                    head.append("WARC-Target-URI: " + link.replace("\r", "%0D").replace("\n", "%0A"))
                if page is not None:
                    head.append(f"Page-ID: {page}")
                if kind == "revisit":
                    head += [f"WARC-Refers-To: {_record_id(int(refers))}", f"Refers-To-Page-ID: {int(refers)}",
                             "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                else:
                    head.append("Content-Type: application/http; msgtype=response")
                head = "\r\n".join(head).encode("utf-8", "surrogatepass") + _CRLF * 2 + http
                out.write(head)
                for k in range(0, len(text) if block else 0, chunk):
                    out.write(text[k:k + chunk].encode("utf-8", "surrogatepass"))
                out.write(_CRLF * 2)
                n, size = n + 1, size + len(head) + (total if block else 0) + 4
                if size >= file_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    # numbers as text: pandas would turn a batch of longs with nulls into floats
    cols = records.select(column(records, key).cast("string").alias("a"), column(records, url).cast("string").alias("b"),
                          column(records, html).alias("c"), F.col("record_type").alias("d"),
                          F.col("refers_to").cast("string").alias("e"))
    return materialize(cols.mapInPandas(write, "path string, records long, bytes long"), "warc-files")


class _Stream:
    """Sequential reads with a one-buffer look-ahead."""

    def __init__(self, file, size: int):
        self.file, self.size, self.buf, self.at = file, size, b"", 0

    def line(self) -> bytes:
        while (k := self.buf.find(b"\n")) < 0:
            more = self.file.read(self.size)
            if not more:
                line, self.buf = self.buf, b""
                self.at += len(line)
                return line
            self.buf += more
        line, self.buf = self.buf[:k + 1], self.buf[k + 1:]
        self.at += len(line)
        return line

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces of at most the buffer's size."""
        while n:
            if not self.buf:
                self.buf = self.file.read(min(self.size, max(n, 1)))
                if not self.buf:
                    raise EOFError("archive ends inside a record")
            k = min(n, len(self.buf), self.size)
            piece, self.buf = self.buf[:k], self.buf[k:]
            self.at += k
            n -= k
            yield piece


def _headers(s: _Stream) -> dict[str, str]:
    found: dict[str, str] = {}
    while (line := s.line().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_file(path: str, chunk: int = CHUNK, with_data: bool = True) -> Iterator[tuple]:
    """The chunk rows of one archive, in order; a record without payload has one empty chunk."""
    fs, at = _fs(path)
    with fs.open_input_stream(at) as file:
        s = _Stream(file, chunk)
        while True:
            start = s.at
            first = s.line()
            if not first:
                return
            if not first.strip():
                continue  # between records
            if not first.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at byte {start}")
            h = _headers(s)
            left = int(h["content-length"])
            if h.get("content-type", "").startswith("application/http") and left:
                begin = s.at
                s.line()
                _headers(s)
                left -= s.at - begin
            page, refers = h.get("page-id"), h.get("refers-to-page-id")
            row = (path, start, page, h["warc-type"], refers,
                   h.get("warc-payload-digest", "").removeprefix("sha1:"))
            sha, n, total = hashlib.sha1(), 0, 0
            for piece in s.pieces(left):
                sha.update(piece)
                total += len(piece)
                yield (*row, n, len(piece), total, piece if with_data else None, base32_sha1(sha), total == left)
                n += 1
            if not n:
                yield (*row, 0, 0, 0, b"" if with_data else None, base32_sha1(sha), True)


def read_chunks(files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives named in ``files.path``.

    ``data`` is null without ``with_data``; ``running_digest`` is the SHA-1 of
    the payload up to the chunk's end, so the row with ``is_last`` has the
    payload's own digest and size.
    """
    columns = [c.split()[0] for c in CHUNKS.split(", ")]
    rows_of = max(1, (32 << 20) // chunk) if with_data else 10_000

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows, held = [], 0
                for r in read_file(path, chunk, with_data):
                    rows.append(r)
                    held += r[7] if with_data else 0
                    if len(rows) >= rows_of * 64 or held >= 32 << 20 or (not with_data and len(rows) >= rows_of):
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    # a file is a task's share: names are dealt out one by one, not by the size of their table
    n = max(1, files.count())
    spread = files.select("path").repartition(min(n, 10_000), "path")
    # numbers came as text: pandas would turn longs with nulls into floats
    return spread.mapInPandas(read, CHUNKS).withColumns(
        {c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def page_records(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are those of the bytes read, and must agree
    with its header; a revisit takes both from the response it refers to,
    which must hold the payload that the revisit's digest names.
    """
    last = read_chunks(files, chunk, with_data=False).where("is_last").select(
        "page_id", "record_type", "refers_to", "digest", "total_bytes", "running_digest")
    last = materialize(last, "warc-records")
    ok = F.col("running_digest") == F.col("digest")
    own = last.where("record_type <> 'revisit'").select(
        "page_id", F.col("total_bytes").alias("payload_bytes"),
        F.when(ok, F.col("running_digest")).otherwise(F.raise_error("payload differs from its digest"))
        .alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    held = last.where("record_type <> 'revisit' and page_id is not null").groupBy(
        F.col("page_id").alias("held_by"), F.col("running_digest").alias("held")).agg(
        F.max("total_bytes").alias("held_bytes"))
    again = last.where("record_type = 'revisit'").join(
        held, (F.col("refers_to") == F.col("held_by")) & (F.col("digest") == F.col("held")), "left")
    again = again.select(
        "page_id", F.coalesce("held_bytes", F.raise_error("a revisit without its response").cast("long"))
        .alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return own.unionAll(again)
