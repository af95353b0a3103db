"""Files read by byte ranges: no task and no row holds a large file, and its lines are those of the whole.

A range owns the lines that begin in it. Where its first line begins and where the next range's does are
found by the same rule from either side, so nothing is read twice or left out. The file's byte order mark
tells the encoding of all its ranges; cuts fall on whole characters, since they fall behind line ends. Line
numbers come from a first pass over files of several ranges, which counts line ends and keeps no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.sources import tree

#: Bytes of a range, and of a part's text at least, unless a range ends there.
RANGE, CHUNK = 32 << 20, 512 << 10
#: Numbers of parts of a range: a part's number is that of its range, times this, and its place there. Decoding makes three bytes of one at most.
PARTS = 256
#: Bytes read at once in search of a line end; ranges that a task reads, about; bytes that opening a file counts for.
STEP, EACH, OPEN = 1 << 20, 4, 64 << 10
#: Bytes and rows that a task hands on at once, about.
HELD, ROWS = 4 << 20, 1000

# Byte order marks, with their encodings and the bytes of a unit.
MARKS = ((b"\xff\xfe\0\0", "utf-32-le", 4), (b"\0\0\xfe\xff", "utf-32-be", 4), (b"\xff\xfe", "utf-16-le", 2), (b"\xfe\xff", "utf-16-be", 2), (b"\xef\xbb\xbf", "utf-8", 1))


@dataclass
class Lines:
    """An open file and where its lines begin."""

    file: object

    def __post_init__(self):
        head = self.file.read(4)
        self.mark, self.code, self.unit = next((m for m in MARKS if head.startswith(m[0])), (b"", "utf-8", 1))
        self.cr, self.lf = ("\r".encode(self.code), "\n".encode(self.code)) if self.unit > 1 else (b"\r", b"\n")
        self.ends = re.compile(re.escape(self.cr) + b"(?:" + re.escape(self.lf) + b")?|" + re.escape(self.lf))
        self.first = len(self.mark)
        self.size = self.file.seek(0, 2)

    def begin(self, at: int) -> int:
        """The first line begin at ``at`` or after it; the file's size if there is none. Both are whole units."""
        if at <= self.first:
            return self.first
        at = self.first + (at - self.first + self.unit - 1) // self.unit * self.unit - self.unit  # a line end just before counts
        while at < self.size:
            self.file.seek(at)
            block = self.file.read(STEP + 2 * self.unit)
            for found in self.ends.finditer(block):
                if found.start() % self.unit:
                    if self.unit > 1 and (other := self._aligned(block, found.start() + 1)) is not None:
                        return at + other
                    break
                if found.start() < STEP:  # a CR there is followed by what tells whether an LF belongs to it
                    return at + found.end()
                break
            at += STEP
        return self.size

    def _aligned(self, block: bytes, start: int) -> int | None:
        """End of the first line end from ``start`` that is made of whole units, if it begins within a step."""
        while found := self.ends.search(block, start):
            if found.start() % self.unit == 0:
                return found.end() if found.start() < STEP else None
            start = found.start() + 1
        return None

    def text(self, begin: int, end: int) -> bytes:
        """The bytes between two places as UTF-8."""
        self.file.seek(begin)
        raw = self.file.read(end - begin)
        return tree.to_utf8(self.mark + raw) if self.unit > 1 else raw

    def count(self, begin: int, end: int) -> int:
        """Line ends between two line begins."""
        n, at, carried = 0, begin, False
        while at < end:
            upto = min(end, at + STEP)
            text = self.text(at, upto)
            n += line_ends(text) - (carried and text.startswith(b"\n"))
            carried, at = text.endswith(b"\r"), upto
        return n


def line_ends(text: bytes) -> int:
    return text.count(b"\n") + text.count(b"\r") - text.count(b"\r\n")


def parts_of(path: str, begin: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Lines before, within the range, and UTF-8 text of each of a range's parts."""
    with open(path, "rb") as file:
        own = Lines(file)
        at, stop, before = own.begin(begin), own.begin(end), 0
        if not begin and at >= stop:
            yield 0, b""  # an empty file has one part
        while at < stop:
            upto = min(stop, own.begin(at + chunk))
            text = own.text(at, upto)
            yield before, text
            before += line_ends(text)
            at = upto


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """``files(path, mtime, size)`` with a row for each of their ranges: ``stripe``, ``begin``, ``end`` and ``share``, its bytes."""
    last = F.greatest(F.lit(0), F.ceil(F.coalesce("size", F.lit(0)) / size) - 1)
    rows = files.withColumn("stripe", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    begin = F.col("stripe").cast("long") * size
    rows = rows.withColumn("begin", begin).withColumn("end", F.when(F.col("stripe") == last, F.greatest("size", F.lit(0))).otherwise(begin + size))
    return rows.withColumn("share", F.col("end") - F.col("begin"))


def read(files: DataFrame, size: int = RANGE, chunk: int = CHUNK) -> DataFrame:
    """``(path, part_no, start_line, content, mtime, size)`` of files: parts in the order of the file, a range's in one task.

    Files that are gone have no rows; an empty one has one part. A line longer than a part stays whole.
    """
    if size < chunk or 3 * size // chunk >= PARTS:
        raise ValueError(f"a range holds {PARTS - 1} parts at most")
    own = ranges(files.select("path", "mtime", "size"), size)
    total = own.agg(F.coalesce(F.sum("share"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, min(total[1], max(files.sparkSession.sparkContext.defaultParallelism, -(-(total[0] + OPEN * total[1]) // (EACH * size)))))
    own = own.repartition(int(tasks), "path", "stripe")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                if Path(r.path).is_file():
                    with open(r.path, "rb") as file:
                        lines = Lines(file)
                        n = lines.count(lines.begin(r.begin), lines.begin(r.end))
                    yield pd.DataFrame([(r.path, r.stripe, n)], columns=["path", "stripe", "n"])

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        table = lambda: pd.DataFrame(rows, columns=["path", "part_no", "start_line", "raw", "mtime", "size"])
        for b in batches:
            for r in b.itertuples():
                if Path(r.path).is_file():
                    for i, (before, raw) in enumerate(parts_of(r.path, r.begin, r.end, chunk)):
                        rows.append((r.path, r.stripe * PARTS + i, r.first + before, raw, r.mtime, r.size))
                        held += len(raw)
                        if held >= HELD or len(rows) >= ROWS:
                            yield table()
                            rows, held = [], 0
        if rows:
            yield table()

    counted = own.where(F.col("size") > size).select("path", "stripe", "begin", "end").mapInPandas(count, "path string, stripe int, n long")
    before = W.partitionBy("path").orderBy("stripe").rowsBetween(W.unboundedPreceding, -1)  # a row a range of one file
    firsts = counted.select("path", "stripe", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    large = own.where(F.col("size") > size).join(firsts, ["path", "stripe"]).repartition(int(tasks), "path", "stripe")
    every = own.where(F.coalesce(F.col("size") <= size, F.lit(True))).withColumn("first", F.lit(0).cast("long")).unionByName(large)
    raw = every.select("path", "stripe", "begin", "end", "first", "mtime", "size").mapInPandas(texts, "path string, part_no int, start_line int, raw binary, mtime long, size long")
    return raw.select("path", "part_no", "start_line", tree.text_of(F.col("raw")).alias("content"), "mtime", "size")
