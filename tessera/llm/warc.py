"""WARC archives: one gzip member for each record, read back by byte ranges.

The reader is splittable without an index. A task gets a byte range of a file, looks for gzip magic,
takes a candidate for a member only if its first bytes decode to a WARC header, and owns the records
whose members start inside its range; the last one is read on past the end. Bytes that merely look
like a member fail to decode and are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, scratch, slices, stored

MAGIC = b"\x1f\x8b\x08"
#: Revisits that are broadcast, at most (36 bytes each).
BROADCAST_ROWS = 500_000
#: Bytes of a range; of one read; that are unpacked at once at the beginning of a record.
RANGE, READ, HEADER = 4 << 20, 1 << 20, 2 << 10


def payload_digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {"version": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields.get("content-length", "0") or 0)]


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pa.fs.FileSystem.from_uri(path)
        name, out, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in slices(batches):
            for page, url, payload, digest, original in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                common = [("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8")]
                if original is None or original == page:
                    raw = record("response", common, payload)
                else:  # the payload is in the response
                    raw = record("revisit", [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{original}>"), ("X-Payload-Length", str(len(payload)))], b"")
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{path}/{name}"]), pa.array([size]), pa.array([n])], ["path", "size", "records"])

    return run


def write_archives(pages: DataFrame, path: str, min_dup_bytes: int = 0) -> list[tuple[str, int, int]]:
    """Write ``pages(page_id, url, html)`` as archives under ``path``; gives (file, bytes, records) of each.

    Null html is an empty payload, null url an empty one. Of pages with equal payloads of at least
    ``min_dup_bytes`` that with the largest id is the response, the others revisit it; of repeated
    rows of that id each is a response; pages with a null id are responses. A page's record is in one
    task's memory. Other columns are not read; an empty table writes no file. A file belongs to one
    task attempt, and only the files of attempts that succeeded are returned.

    Payloads stay where they are read: digests are grouped by (payload, id) pairs alone, and what a
    page revisits comes to it by its id, broadcast if these are few.
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    pairs = rows.where((F.octet_length("payload") >= min_dup_bytes) & F.col("page_id").isNotNull()).select("sha", "page_id")
    most = pairs.groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "original")
    again = stored(pairs.join(most, "sha").where("page_id <> original").distinct(), "revisits")
    few = again.count() <= BROADCAST_ROWS
    named = rows.where("page_id is not null").join(F.broadcast(again) if few else again, ["page_id", "sha"], "left")
    rows = named.unionByName(rows.where("page_id is null").withColumn("original", F.lit(None).cast("long")))
    written = map_arrow(rows.select("page_id", "url", "payload", base32(F.col("sha")).alias("digest"), "original"), _write(path), "path string, size long, records long")
    return [(r.path, r.size, r.records) for r in written.collect()]  # one row a file


def base32(sha: Column) -> Column:
    """Bare upper-case base32 of 20 bytes, in groups of five bits."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for g in range(4):  # five bytes are eight digits
        number = F.conv(F.hex(F.substring(sha, 5 * g + 1, 5)), 16, 10).cast("long")
        parts += [F.substring(F.lit(digits), F.shiftright(number, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(7, -1, -1)]
    return F.concat(*parts)


class _Reader:
    """Bytes of a file from a place on, a portion at a time."""

    def __init__(self, file: pa.NativeFile, at: int, size: int):
        self.file, self.size = file, size
        self.base, self.have, self.off = at, b"", 0

    @property
    def at(self) -> int:
        return self.base + self.off

    def left(self) -> int:
        return len(self.have) - self.off

    def more(self) -> bool:
        """Read another portion behind what is held; what lies before the place is let go."""
        want = min(READ, self.size - self.base - len(self.have))
        if want <= 0:
            return False
        self.file.seek(self.base + len(self.have))
        self.base, self.have, self.off = self.at, self.have[self.off :] + self.file.read(want), 0
        return True

    def find(self, what: bytes) -> int | None:
        """Move on to where these bytes come next, if they do."""
        while (found := self.have.find(what, self.off)) < 0:
            self.off = max(self.off, len(self.have) - len(what) + 1)
            if not self.more():
                return None
        self.off = found
        return self.at

    def move(self, to: int) -> None:
        """Go on from a place further on."""
        if self.base <= to <= self.base + len(self.have):
            self.off = to - self.base
        else:
            self.base, self.have, self.off = to, b"", 0


def _member(reader: _Reader) -> tuple[bytes | None, str | None]:
    """(record, what is wrong with it) of the member that begins at the reader's place, behind which that moves.

    No record: the place is not a member's. A record that is cut off or damaged after its header
    comes as far as it goes, and leaves the reader one byte on.
    """
    start, unpack, out = reader.at, zlib.decompressobj(31), []
    at, data, got, wrong = reader.at, reader.have[reader.off :], 0, None
    while not unpack.eof:
        if not data and at < reader.size:
            reader.file.seek(at)
            data = reader.file.read(min(READ, reader.size - at))
        try:
            part = unpack.decompress(data, 16 if got < 7 else HEADER if got < HEADER else READ)
        except zlib.error:
            wrong = "damaged"
            break
        rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        at, data = at + len(data) - len(rest), rest
        out.append(part)
        got += len(part)
        if (got >= 7 or unpack.eof) and not (out[0] if len(out[0]) >= 7 else b"".join(out)).startswith(b"WARC/1."):
            got = 0
            break
        if not part and not data and at >= reader.size and not unpack.eof:
            wrong = "cut off"
            break
    if unpack.eof and got:
        reader.move(at)
        return b"".join(out), None
    reader.move(start + 1)
    return (b"".join(out), wrong or "damaged") if got >= 7 else (None, None)


def records_in(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, bytes, str | None]]:
    """(place, record, what is wrong) of the members that begin in [start, end).

    Behind a member another must begin, or the file end: where none does, an empty record tells of it.
    """
    reader, expected = _Reader(file, start, size), None
    while True:
        at = reader.find(MAGIC) if expected is None else expected
        if at is None or at >= size:
            return
        if at >= end:
            if expected is not None and not _begins(reader):
                yield at, b"", "no record"
            return
        raw, wrong = _member(reader)
        if raw is not None:
            yield at, raw, wrong
        elif expected is not None:
            yield at, b"", "no record"
        expected = reader.at if raw is not None and wrong is None else None


def _begins(reader: _Reader) -> bool:
    """Whether a record's header decodes at the reader's place."""
    while reader.left() < 4096 and reader.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(reader.have[reader.off :], 7).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "at", "kind", "id", "uri", "digest", "refers_to", "payload_bytes", "payload", "error"]
    for b in batches:
        for path, size, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fs, name = pa.fs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as file:
                out: list[tuple] = []
                held = 0
                for at, raw, wrong in records_in(file, size, start, end):
                    h, block = parse(raw)
                    kind = h.get("warc-type", "")
                    revisit = kind == "revisit"
                    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    digest = said if revisit or wrong else payload_digest(block)
                    if wrong is None and len(block) != int(h.get("content-length", "-1")):
                        wrong = "length"
                    elif wrong is None and said and digest != said:
                        wrong = "digest"
                    out.append((path, at, kind, h.get("warc-record-id"), h.get("warc-target-uri"), digest, h.get("warc-refers-to"), int(h.get("x-payload-length", 0)) if revisit else len(block), None if revisit else block, wrong))
                    held += len(block)
                    if held > 8 << 20 or len(out) >= 1024:
                        yield _batch(out, names)
                        out, held = [], 0
                if out:
                    yield _batch(out, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE) -> DataFrame:
    """Records of archives given as (URI, bytes): ``path, at, kind, id, uri, digest, refers_to, payload_bytes, payload, error``.

    ``error`` is null for a whole record; else ``cut off`` or ``damaged`` (what decodes is there),
    ``length`` or ``digest`` (the block is not as its header says), or ``no record`` where one must
    begin and none does. Ranges are dealt out whatever file they are in. A response's digest is taken from its payload; a
    revisit, which has none, tells its payload's digest and length in its header. Without files, or with
    empty ones alone, there are no rows. A record is in one task's memory.
    """
    files_ = spark.createDataFrame([(p, s) for p, s in files], "path string, size long")
    starts = F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {range_bytes}L)")).alias("start")
    ranges = files_.where("size > 0").select("path", "size", starts).withColumn("end", F.least(F.col("start") + range_bytes, F.col("size")))
    n = sum(-(-s // range_bytes) for _, s in files)
    ranges = ranges.repartition(max(1, n), F.xxhash64("path", "start")) if n > 1 else ranges
    schema = "path string, at long, kind string, id string, uri string, digest string, refers_to string, payload_bytes long, payload binary, error string"
    return map_arrow(ranges, _read, schema)


def round_trip(pages: DataFrame, min_dup_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as archives in the shared folder and read them back; an empty table gives no rows."""
    spark = pages.sparkSession
    files = write_archives(pages, path or scratch(spark, "warc"), min_dup_bytes)
    return read_archives(spark, [(p, s) for p, s, _ in files])
