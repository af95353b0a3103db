"""Input that never ends, or is larger than memory, as a stream: blocks of whole lines in a folder that Spark reads.

A thread copies the input into blocks of about a megabyte, cut at line ends, and waits while many of them
are still unread; a micro-batch takes some blocks, hands on the lines that match in the order of the input,
and the blocks go. So memory and disk hold a bounded piece of the input, and the first answers come before
its end. Only a fuzzy query, whose order is over all lines, waits for the end.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import files
from tessera.plans.options import Options
from tessera.sources.store import Folder
from tessera.streaming.watch import filter_stream

#: Bytes of a block, blocks of a micro-batch, unread blocks at which copying waits, and seconds between looks.
BLOCK, BATCH, AHEAD, LOOK = 1 << 20, 16, 64, 0.05
#: Seconds after which a block goes though it isn't full: lines that come slowly are answered as well.
PATIENCE = 1.0


def blocks(source: BinaryIO, size: int = BLOCK, patience: float = PATIENCE, clock: Callable[[], float] = time.monotonic) -> Iterator[bytes]:
    """Whole lines of the input, about ``size`` bytes at once, fewer if it comes slowly; a longer line stays whole."""
    read = getattr(source, "read1", source.read)
    held: list[bytes] = []
    n, began = 0, clock()
    while piece := read(size):
        cut = piece.rfind(b"\n") + 1
        n += len(piece)
        held.append(piece[:cut] if cut else piece)
        if cut and (n >= size or clock() - began >= patience or len(piece) < size):
            yield b"".join(held)
            held, n, began = [piece[cut:]] if cut < len(piece) else [], len(piece) - cut, clock()
        elif cut and cut < len(piece):
            held.append(piece[cut:])
    if held:
        yield b"".join(held)


class Spool:
    """Numbered blocks in a folder. A block is there whole or not at all."""

    def __init__(self, spark: SparkSession, top: str | None = None):
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if top is None and not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if top is None and not shared:
            import tempfile

            shared = tempfile.mkdtemp(prefix="tessera-input-")
        self.folder = Folder(spark, top or f"{shared}/input-{uuid.uuid4().hex}")
        self.blocks = Folder(spark, f"{self.folder.top}/blocks")
        self.blocks.fs.mkdirs(self.blocks.at())
        self.stopped, self.error, self.written = threading.Event(), None, 0

    def put(self, raw: bytes) -> None:
        name = f"b{self.written:012}"
        out = self.blocks.fs.create(self.folder.at(f".{name}"), True)
        out.write(bytearray(raw))
        out.close()
        self.blocks.fs.rename(self.folder.at(f".{name}"), self.blocks.at(name))
        self.written += 1

    def unread(self) -> int:
        return sum(n.startswith("b") for n in self.blocks.names())

    def copy(self, source: BinaryIO, wait: bool = True) -> None:
        """All of the input; with ``wait`` never more than some blocks ahead of the reader."""
        try:
            for raw in blocks(source):
                while wait and self.unread() >= AHEAD and not self.stopped.is_set():
                    time.sleep(LOOK)
                if self.stopped.is_set():
                    return
                self.put(raw)
        except Exception as e:
            self.error = e

    def rows(self, reader) -> DataFrame:
        """``(block, value)``: a row a block."""
        return reader.format("text").option("wholetext", True).schema("value string").load(self.blocks.top).select(F.col("_metadata.file_name").alias("block"), "value")

    def forget(self, batch: DataFrame) -> None:
        for r in batch.select("block").distinct().collect():  # some blocks
            self.blocks.delete(r.block)

    def delete(self) -> None:
        self.folder.delete("")


def numbered(blocks: DataFrame) -> DataFrame:
    """``(ord, path, name)`` of each line that isn't blank, in the order of the input: by block, then by place in it."""
    lines = blocks.select("block", F.posexplode(F.split("value", "\n", -1)).alias("at", "path"))
    lines = lines.select(F.struct("block", "at").alias("ord"), F.regexp_replace("path", "\r$", "").alias("path")).where("path <> ''")
    return lines.withColumn("name", files.name_of(F.col("path")))


def filter_input(spark: SparkSession, source: BinaryIO, query: str, options: Options, say: Callable[[str], None]) -> int:
    """Hand on the lines of the input that match, as it comes; how many there were. A limit ends the reading."""
    spool = Spool(spark)
    if query and options.style == "fuzzy":
        try:
            spool.copy(source, wait=False)
            if spool.error:
                raise spool.error
            found = files.fuzzy(numbered(spool.rows(spark.read)), query, options.limit)
            return sum(1 for r in found.select("path").toLocalIterator() if say(r.path) or True)
        finally:
            spool.delete()
    told = 0

    def answer(batch: DataFrame, number: int) -> None:
        nonlocal told
        if options.limit is not None and told >= options.limit:
            spool.stopped.set()
        else:
            found = filter_stream(numbered(batch), query, options).orderBy("ord")
            if options.limit is not None:
                found = found.limit(options.limit - told)
            for r in found.select("path").toLocalIterator():
                say(r.path)
                told += 1
        spool.forget(batch)

    stream = spool.rows(spark.readStream.option("maxFilesPerTrigger", BATCH))
    running = stream.writeStream.foreachBatch(answer).option("checkpointLocation", f"{spool.folder.top}/checkpoint").start()
    copier = threading.Thread(target=spool.copy, args=(source,), daemon=True)
    try:
        copier.start()
        while copier.is_alive() and not spool.stopped.is_set():
            copier.join(LOOK)
            if not running.isActive:
                break
        while running.isActive and not spool.stopped.is_set() and spool.unread():
            time.sleep(LOOK)
        if running.exception():
            raise running.exception()
        if spool.error:
            raise spool.error
        return told
    finally:
        spool.stopped.set()
        running.stop()
        spool.delete()
