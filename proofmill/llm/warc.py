"""WARC archives: written by tasks, read back sequentially.

One gzip member holds one record. A reader goes through an archive once: it inflates a bounded piece at a time, cuts the
record's header at the first blank line, takes as many bytes of block as Content-Length says, updates the digests as
they pass, and expects the member to end after two line breaks. Neither an archive nor a member is ever held whole; only a payload that is asked for is.

Payloads that repeat are written once, with the largest page id of those that hold them; the others are `revisit` records, whose HTTP header
still states the full length, and whose record header states the full digest and the record that they refer to.

Archives go to the shared folder by names of the attempt that wrote them; the tasks' own rows list what was written, so what a lost
or repeated task left behind is never read.

Defined results: a null or empty html is an empty payload. Rows that repeat a page id and a payload are all responses if theirs is the largest
id, and a null id is below all others. A null url leaves the record without a target; blanks and control characters in one
are percent-coded, so it stays one header line. Payloads of any length are written whole. Damage (a bad digest, a short block, bytes between
records, an archive cut off) is a row with `error`, and the reader goes on at the next member where there is one. An empty table gives no archive and no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, join_unique, with_hot

#: Bytes after which a writer begins the next archive; bytes read and inflated at once; the longest header.
ROLL, PIECE, HEADER = 64 << 20, 1 << 16, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD = "archive string, offset long, record_type string, record_id string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


# ---------------------------------------------------------------- writing
def _field(name: str, value: object) -> bytes:
    return b"" if value is None else f"{name}: {value}\r\n".encode()


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()  # noqa: S324


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name the response."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}').urn}>"


def member(head: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    top = b"WARC/1.1\r\n" + b"".join(_field(k, v) for k, v in [*head, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", len(block))]) + b"\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(top) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def info_record(name: str) -> bytes:
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def page_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    digest = _sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, block = ("revisit", http) if revisit else ("response", http + payload)
    target = None if url is None else re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: quote(m[0]), url)
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest), ("Page-Id", page_id)]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-Id", refers_to)]
    return member(head, block)


def write_warc(pages: DataFrame, path: str, roll: int = ROLL) -> DataFrame:
    """Write the records of pages (page_id, url, html, revisit, refers_to) to archives in the folder path; rows (archive, bytes) of what was written.

    The rows must be written to a table before use: each run of a task writes archives of its own.
    """
    bounded_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task, names, sizes, out = pyspark.TaskContext.get(), [], [], None
        for b in batches:
            for page_id, url, html, revisit, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "html", "revisit", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    names.append(name), sizes.append(0)
                    sizes[-1] += out.write(info_record(name))
                sizes[-1] += out.write(page_record(page_id.as_py(), url.as_py(), html.as_py() or b"", revisit.as_py(), refers_to.as_py()))
                if sizes[-1] >= roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array([f"{path}/{n}" for n in names], pa.string()), pa.array(sizes, pa.int64())], ["archive", "bytes"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"), "revisit", F.col("refers_to").cast("long")).mapInArrow(write, "archive string, bytes long")


# ---------------------------------------------------------------- reading
class Damage(ValueError):
    """What an archive holds is no record."""


class Member:
    """One gzip member, inflated a piece at a time from a stream that members share."""

    def __init__(self, source: Source):
        self.source, self.z, self.buffer = source, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        """Inflate a piece into the buffer; False at the member's end."""
        while not self.z.eof:
            raw = self.z.unconsumed_tail or self.source.take()
            if not raw:
                raise Damage("cut off within a member")
            try:
                piece = self.z.decompress(raw, PIECE)
            except zlib.error as e:
                raise Damage(f"not gzip: {e}") from e
            if self.z.eof:
                self.source.give_back(self.z.unused_data)
            if piece:
                self.buffer += piece
                return True
        return False

    def line_block(self) -> bytes:
        """Up to and with the first blank line."""
        start = 0
        while (at := self.buffer.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(self.buffer) - 3)
            if len(self.buffer) > HEADER or not self._more():
                raise Damage("no end of header")
        out = bytes(self.buffer[: at + 4])
        del self.buffer[: at + 4]
        return out

    def pieces(self, length: int) -> Iterator[bytes]:
        """Exactly so many bytes."""
        while length:
            if not self.buffer and not self._more():
                raise Damage(f"{length} bytes short of Content-Length")
            piece = bytes(self.buffer[:length])
            del self.buffer[: len(piece)]
            length -= len(piece)
            yield piece

    def rest(self) -> int:
        """Inflate to the end and count what is left, without holding it."""
        left = len(self.buffer)
        self.buffer.clear()
        while self._more():
            left += len(self.buffer)
            self.buffer.clear()
        return left


class Source:
    """Bytes of an archive in order, and how many were taken."""

    def __init__(self, stream):
        self.stream, self.kept, self.offset = stream, b"", 0

    def take(self) -> bytes:
        raw, self.kept = (self.kept, b"") if self.kept else (self.stream.read(PIECE), b"")
        self.offset += len(raw)
        return raw

    def give_back(self, raw: bytes) -> None:
        self.kept = raw + self.kept
        self.offset -= len(raw)

    def more(self) -> bool:
        if not self.kept:
            self.kept = self.stream.read(PIECE)
        return bool(self.kept)


def fields_of(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on the one before."""
    out, name = {}, None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip(" \t")
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip(" \t").lower()
            out[name] = value.strip(" \t")
    return out


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name)
    if value is not None and not re.fullmatch(r"-?[0-9]+", value):
        raise Damage(f"{name} is no number")
    return None if value is None else int(value)


def _hex(digest: str | None) -> str | None:
    """Lower-case hex of a labelled SHA-1, in base 32 or hex."""
    if not digest or not digest.lower().startswith("sha1:"):
        return None
    value = digest[5:]
    try:
        return value.lower() if re.fullmatch(r"[0-9a-fA-F]{40}", value) else base64.b32decode(value.upper()).hex()
    except ValueError as e:
        raise Damage("digest is not base 32") from e


def read_record(m: Member, with_payload: bool) -> dict:
    """The record of one member; its block digest and payload digest are verified where stated."""
    top = m.line_block()
    if not top.startswith(b"WARC/"):
        raise Damage("no WARC version")
    head = fields_of(top)
    length = _number(head, "content-length")
    if length is None or length < 0:
        raise Damage("no Content-Length")
    out = {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "page_id": _number(head, "page-id"), "refers_to": _number(head, "refers-to-page-id")}
    block, payload, kept, size, http = hashlib.sha1(), hashlib.sha1(), [], 0, b""  # noqa: S324
    framed = head.get("content-type", "").startswith("application/http")
    for piece in m.pieces(length):
        block.update(piece)
        if framed:  # the HTTP header goes before the payload
            http += piece
            at = http.find(b"\r\n\r\n")
            if at < 0:
                if len(http) > HEADER:
                    raise Damage("no end of HTTP header")
                continue
            piece, http, framed = http[at + 4 :], http[:at], False
        payload.update(piece)
        size += len(piece)
        if with_payload:
            kept.append(piece)
    if left := m.rest() - 4:
        raise Damage(f"{left} bytes besides Content-Length")
    if "warc-block-digest" in head and _hex(head["warc-block-digest"]) not in (None, block.hexdigest()):
        raise Damage("block digest differs")
    stated = _hex(head.get("warc-payload-digest"))
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": _number(fields_of(http), "content-length"), "payload_digest": stated, "payload": None}
    if stated not in (None, payload.hexdigest()):
        raise Damage("payload digest differs")
    return out | {"payload_bytes": size, "payload_digest": payload.hexdigest(), "payload": b"".join(kept) if with_payload else None}


def read_archive(stream, with_payload: bool = False) -> Iterator[dict]:
    """Every record of an archive in order, each with its offset; damage is a record with `error`, after which the next member is read."""
    source = Source(stream)
    while source.more():
        offset, m = source.offset, Member(source)
        try:
            yield {"offset": offset, "error": None} | read_record(m, with_payload)
        except Damage as e:
            yield {"offset": offset, "error": str(e)}
            try:
                m.rest()
            except Damage:
                return  # the rest of the archive has no member's beginning that could be trusted


def read_warc(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows (RECORD) of the archives listed in the column `archive`: each archive is read by one task, one record at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))]

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r.get(n) for r in rows], k) for n, k in kinds], [n for n, _ in kinds])

        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(name)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream, with_payload):
                        rows.append({"archive": name} | r)
                        size += len(r.get("payload") or b"")
                        if len(rows) == 1000 or size > PIECE << 6:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    return archives.select("archive").mapInArrow(read, RECORD)


def list_warc(spark: SparkSession, path: str) -> DataFrame:
    """Archives in a folder, as rows that read_warc takes; the listing is Spark's, contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"))


# ---------------------------------------------------------------- pages
def mark_revisits(pages: DataFrame, scratch: Scratch, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html as binary) with revisit and refers_to: of equal payloads of at least `least` bytes the one with the largest page_id is the response.

    Only ids and digests are grouped; payloads that may repeat are shuffled once, frequent ones not at all (join_unique).
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    key = F.when(F.octet_length("html") >= least, F.sha2("html", 256))
    keyed = rows.withColumn("key", key)
    groups = keyed.where("key is not null").groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("size")).where("size > 1")
    held = with_hot(scratch.write(groups, "repeated"), "size").drop("size")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    marked = join_unique(keyed.where("key is not null"), held, "key", "left").select("page_id", "url", "html", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))
    return marked.unionByName(rows.where(F.octet_length("html") < least).select("*", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to")))


def archive_pages(pages: DataFrame, least: int = 1000, roll: int = ROLL) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: RECORD's columns, one row for each page; damage raises an error."""
    scratch = Scratch(pages.sparkSession, "warc")
    written = scratch.write(write_warc(mark_revisits(pages, scratch, least), f"{scratch.root}/archives", roll), "written")
    found = written.count()
    # Each archive is a task of its own.
    records = read_warc(written.repartition(max(1, min(found, 10_000))).select("archive")).where("record_type is null or record_type <> 'warcinfo'")
    return records.withColumn("page_id", F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat_ws(" ", "archive", F.col("offset").cast("string"), "error")).cast("long")))
