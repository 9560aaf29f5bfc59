"""WARC archives: writing pages as records, and a sequential reader.

Each record is a gzip member of its own.  The reader takes an archive's bytes piece by piece, inflates member by member,
frames each record by its Content-Length and verifies the block digest and the payload digest on the way; it holds a
piece and a record's headers, and the payload only if that is asked for.

Archives are written by Spark's text writer, so that task retries and lost executors leave no half archives behind: a row
is some megabytes of records, and what the writer puts after a row, where a text has its line end, is an empty gzip member,
which the format allows anywhere and readers pass over.  An archive has as many rows as make about a gigabyte.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcohort.llm.common import open_file, passing, slices, small_batches, staged, within

#: Bytes of a row of records, and of an archive.
ROW_BYTES, ARCHIVE_BYTES = 4 << 20, 1 << 30
#: Payloads from this size on are written once, others of the same digest revisit them.
REVISIT_BYTES = 1000
#: Groups of equal payloads up to which the table of groups is broadcast; a row of it has about 60 bytes.
BROADCAST_GROUPS = 100_000
PIECE = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member of no bytes.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300") + bytes(8)


class WarcError(ValueError):
    """An archive that breaks the format, or a digest that does not match."""


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member: a response with its payload, or, with ``refers_to``, a revisit with headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Target-URI", None if url is None else "".join(c if c > " " else "%%%02X" % ord(c) for c in url)),
        ("WARC-Date", DATE),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())),
        ("WARC-Payload-Digest", _base32(hashlib.sha1(payload).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class _Members:
    """The inflated bytes of an archive, one gzip member after the other."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.raw = iter(pieces), b""
        self.out, self.inflate = bytearray(), None

    def more(self) -> bool:
        """Inflate one piece of the member; False at its end."""
        if self.inflate is None or self.inflate.eof:
            return False
        if not self.raw and not (raw := next(self.pieces, b"")):
            raise WarcError("an archive ends inside a gzip member")
        elif not self.raw:
            self.raw = raw
        self.out += self.inflate.decompress(self.raw, PIECE)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def next_member(self) -> bool:
        """Go to the next member that has bytes."""
        while True:
            while not self.raw:
                if not (raw := next(self.pieces, b"")):
                    return False
                self.raw = raw
            self.out.clear()
            self.inflate = zlib.decompressobj(31)
            while not self.out and self.more():
                pass
            if self.out:
                return True

    def line_block(self, what: str) -> bytes:
        """The bytes up to an empty line."""
        while (k := self.out.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise WarcError(f"no end of the {what} headers")
        got = bytes(self.out[:k])
        del self.out[: k + 4]
        return got

    def take(self, most: int) -> bytes:
        """At least one and at most ``most`` bytes of the member; none at its end."""
        while not self.out and self.more():
            pass
        got = bytes(self.out[:most])
        del self.out[:most]
        return got


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_archive(pieces: Iterable[bytes], payloads: bool = False) -> Iterator[dict]:
    """The records of an archive, in order, from its bytes in pieces of any size.

    Yields id, type, refers_to, payload_bytes, payload_digest (hex) and, with ``payloads``, payload (None for revisits).
    Raises WarcError on a broken frame, a digest that does not match, or a member with more or less than one record.
    """
    source = _Members(pieces)
    while source.next_member():
        version, head = _fields(source.line_block("record's"))
        if not version.startswith("WARC/"):
            raise WarcError(f"a record begins with {version[:20]!r}")
        left = int(head["content-length"])
        block, payload, kept = hashlib.sha1(), hashlib.sha1(), bytearray()
        declared, size, http = None, 0, None
        buffered = bytearray()
        while left:
            piece = source.take(min(left, PIECE))
            if not piece:
                raise WarcError("a block is shorter than its Content-Length")
            left -= len(piece)
            block.update(piece)
            if http is None:
                buffered += piece
                if (k := buffered.find(b"\r\n\r\n")) < 0:
                    continue
                http = _fields(bytes(buffered[:k]))[1]
                declared = int(http["content-length"]) if "content-length" in http else None
                piece = bytes(buffered[k + 4 :])
            payload.update(piece)
            size += len(piece)
            if payloads:
                kept += piece
        if source.take(4) + source.take(4) + source.take(1) != b"\r\n\r\n":
            raise WarcError("a record is not alone in its gzip member")
        if "warc-block-digest" in head and head["warc-block-digest"] != _base32(block.digest()):
            raise WarcError("a block digest does not match")
        revisit = head["warc-type"] == "revisit"
        digest = head.get("warc-payload-digest")
        if not revisit and digest is not None and digest != _base32(payload.digest()):
            raise WarcError("a payload digest does not match")
        if not revisit and declared is not None and declared != size:
            raise WarcError("a payload differs from its Content-Length")
        yield {
            "id": head["warc-record-id"],
            "type": head["warc-type"],
            "refers_to": head.get("warc-refers-to"),
            "payload_bytes": declared if revisit else size,
            "payload_digest": base64.b32decode(digest.partition(":")[2]).hex() if revisit else payload.hexdigest(),
        } | ({"payload": None if revisit else bytes(kept)} if payloads else {})


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name not in ("", "null") else None


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Add ``refers_to`` to (page_id, url, html): null for a response, for a revisit the largest page_id of its payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    groups = base.where(F.col("size") >= least).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where((F.col("n") > 1) & F.col("top").isNotNull()).drop("n")
    groups = staged(groups, "warc-groups")
    # few groups: the pages stay where they are; many: both sides are shuffled, and Spark splits hot digests
    groups = F.broadcast(groups) if within(groups, BROADCAST_GROUPS) else groups
    joined = base.join(groups, ["digest", "size"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("top")), None).otherwise(F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES, most: int = ARCHIVE_BYTES, row: int = ROW_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) into archives of about ``most`` bytes, at most one a task
    if its records make less, below ``path``; a task holds ``row`` bytes and a record.

    Null html is an empty payload.  Of equal payloads of ``least`` bytes and more, the row with the largest page_id is the
    response (all rows, where that id repeats), others revisit it, those without an id too; if none has an id, all are
    responses.  Null urls are left out of the record; other columns are not read; an empty table gives no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size = [], 0
        for batch in slices(batches, "html"):
            for page in batch.to_pylist():
                archive.append(one := member(page["page_id"], page["url"], (page["html"] or "").encode(), page["refers_to"]))
                size += len(one)
                if size >= min(row, most):
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(archive)], pa.binary())})
                    archive, size = [], 0
        if archive:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(archive)], pa.binary())})

    with passing(pages.sparkSession), small_batches(pages.sparkSession):
        rows = plan_records(pages, least).mapInArrow(run, "archive binary")
        text = rows.select(F.col("archive").cast("string").alias("value"))
        # latin-1 gives the separator's characters as the bytes of the same numbers
        text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", max(1, most // row)).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Read all archives below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Spark lists the files; a task opens its archives itself and reads them in pieces, whatever their size.  Archives from
    elsewhere may be of one gzip member a record, with or without empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                with open_file(uri) as file:
                    got = []
                    for r in read_archive(iter(lambda file=file: file.read(PIECE), b"")):
                        got.append((_page(r["id"]), r["payload_bytes"], r["payload_digest"], r["type"], _page(r["refers_to"])))
                        if len(got) == RECORDS:
                            yield _records(got)
                            got = []
                    yield _records(got)

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "length")
    # as many tasks as files: names are so short that Spark would join them
    count = max(1, files.count())
    return files.repartitionByRange(count, "path").select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: Records that a reader hands on at once.
RECORDS = 4096


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
