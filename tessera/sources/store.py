"""A project's index on disk: buckets of Parquet, and numbered manifests that tell which folder holds each bucket.

A version writes only the buckets that change, beside the old ones; its manifest names the others where
they are. Readers take the manifest with the highest number: there is no moment without an index, and a
crash leaves the old one. The manifest before the newest and its folders stay for readers that have begun.

Writers see each other. One that begins notes the newest number and leases its folder; it may publish only
the very next number, and fails with ``Conflict`` if another was faster, in which case nothing of the
other is lost. Folders with a lease are nobody else's to delete until the lease ends.

Buckets are those of extendible hashing: a bucket of depth d holds the rows whose hash ends in its d bits,
and one that has grown splits by further bits. Its number is those bits behind a one.
"""

from __future__ import annotations

import contextlib
import json
import math
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.sources.ranges import CHUNK, PARTS

FORMAT = 4
#: Bytes of contents that a bucket is meant to hold.
BUCKET_BYTES = 128 << 20
#: A bucket over so many times the target is split; depth at most; seconds that a lease lasts; slots of a directory in an expression.
SPLIT, DEEPEST, LEASE, SLOTS = 1.5, 30, 24 * 3600, 256


class Conflict(OSError):
    """Another writer has published meanwhile."""


class FormatError(ValueError):
    """An index of another version of this library, which an update builds anew."""


class Folder:
    """A folder of Spark's file system, whichever that is."""

    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.top = spark, top.rstrip("/")

    def at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    @property
    def fs(self):
        return self.at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(below))] if self.fs.exists(self.at(below)) else []

    def read(self, name: str) -> str:
        file = self.fs.open(self.at(name))
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that is there whole or not at all. One that is there already is a ``Conflict``.

        A rename onto a file fails in one step on HDFS; on a local disk a link does, where Hadoop's rename does not.
        """
        new = f".{uuid.uuid4().hex}"
        self.write(new, text)
        try:
            if self.fs.getUri().getScheme() == "file":
                path = self.at(new).toUri().getPath()
                os.link(path, os.path.join(os.path.dirname(path), name))
            elif self.fs.exists(self.at(name)) or not self.fs.rename(self.at(new), self.at(name)):
                raise FileExistsError
        except FileExistsError:
            raise Conflict(f"{self.top}/{name} is there already: another writer was faster") from None
        finally:
            self.delete(new)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def bytes_in(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength() if self.fs.exists(self.at(name)) else 0

    def numbers(self, head: str) -> list[int]:
        """Numbers of the names that begin so, highest last."""
        return sorted(int(n[len(head) :]) for n in self.names() if n.startswith(head) and n[len(head) :].isdigit())


@dataclass
class Manifest:
    """A version: its number, and for each bucket the folder that holds it (none if it is empty)."""

    number: int = 0
    buckets: dict[int, str | None] = field(default_factory=lambda: {1: None})

    def text(self) -> str:
        return json.dumps({"format": FORMAT, "buckets": {str(b): v for b, v in self.buckets.items()}})

    def slots(self) -> list[int]:
        """The bucket of each value of the last bits, as many as the deepest bucket has."""
        depth = max(b.bit_length() for b in self.buckets) - 1
        out = [0] * (1 << depth)
        for b in self.buckets:
            own = b.bit_length() - 1
            for i in range(b & ((1 << own) - 1), 1 << depth, 1 << own):
                out[i] = b
        return out

    def split(self, sizes: dict[int, int], target: int) -> "Manifest":
        """These buckets with those that have grown in pieces near the target; the pieces are empty yet."""
        out: dict[int, str | None] = {}
        for b, folder in self.buckets.items():
            more = min(DEEPEST - b.bit_length() + 1, math.ceil(math.log2(max(1, sizes.get(b, 0) / target)))) if sizes.get(b, 0) > SPLIT * target else 0
            own = b.bit_length() - 1
            out |= {(1 << (own + more)) | (k << own) | (b & ((1 << own) - 1)): None for k in range(1 << more)} if more else {b: folder}
        return Manifest(self.number, out)


def placed(rows: DataFrame, manifest: Manifest) -> DataFrame:
    """Adds each row's ``bucket`` by its ``path`` and ``stripe``, the range of a large file: such a file lies in several buckets."""
    slots = manifest.slots()
    slot = F.xxhash64("path", F.col("stripe").cast("int")).bitwiseAND(F.lit(len(slots) - 1))
    if len(slots) <= SLOTS:
        return rows.withColumn("bucket", F.element_at(F.array(*map(F.lit, slots)), (slot + 1).cast("int")))
    listed = rows.sparkSession.createDataFrame(list(enumerate(slots)), "slot long, bucket int")  # Spark broadcasts it if it is small
    return rows.withColumn("slot", slot).join(listed, "slot").drop("slot")


@dataclass
class Store:
    """``<top>/MANIFEST-<n>``, ``<top>/<version>/data/bucket=<b>/``, ``<top>/<version>/index/bucket=<b>/`` and ``<top>/LEASE-<version>``."""

    spark: SparkSession
    top: str
    target: int = BUCKET_BYTES

    def __post_init__(self):
        self.folder = Folder(self.spark, self.top)

    def manifest(self, number: int | None = None) -> Manifest | None:
        """The current version or another; None if there is none."""
        numbers = self.folder.numbers("MANIFEST-")
        if not numbers:
            return None
        number = numbers[-1] if number is None else number
        found = json.loads(self.folder.read(f"MANIFEST-{number}"))
        if found["format"] != FORMAT:
            raise FormatError(f"{self.top} has format {found['format']}, not {FORMAT}; run update")
        return Manifest(number, {int(b): v for b, v in found["buckets"].items()})

    def read(self, only: set[int] | None = None, what: str = "data", manifest: Manifest | None = None) -> DataFrame | None:
        """Rows of the current version (or a given one), or of some of its buckets. Columns not selected are not read."""
        found = manifest or self.manifest()
        if found is None:
            return None
        folders = [f"{self.top}/{v}/{what}/bucket={b}" for b, v in found.buckets.items() if v and (only is None or b in only)]
        return self.spark.read.parquet(*folders) if folders else None

    def stored_bytes(self, what: str = "data") -> int:
        found = self.manifest() or Manifest()
        return sum(self.folder.bytes_in(f"{v}/{what}/bucket={b}") for b, v in found.buckets.items() if v)  # a look a bucket

    def sized(self, total: int) -> Manifest:
        """A manifest of empty buckets for so many bytes, to follow the current one."""
        return Manifest(max(self.folder.numbers("MANIFEST-"), default=0)).split({1: total}, self.target)

    def write(self, version: str, rows: DataFrame, base: Manifest) -> Manifest:
        """Write ``rows(path, part_no, content, ...)`` of ``base``'s empty buckets, and publish them with its others as the next version.

        Rows are sorted by path and cut into chunks, and chunks are indexed. Rows that belong to a bucket
        which has a folder already, and rows that are missing after the write, are an error; so is a
        version after ``base`` (``Conflict``), and then what was written goes.
        """
        self.folder.write(f"LEASE-{version}", str(time.time() + LEASE))
        try:
            out = self._written(version, rows, base)
            self.folder.publish(f"MANIFEST-{base.number + 1}", out.text())
        except BaseException:
            self.folder.delete(version)
            raise
        finally:
            self.folder.delete(f"LEASE-{version}")
        self.clean()
        return out

    def _written(self, version: str, rows: DataFrame, base: Manifest) -> Manifest:
        from tessera.operators.slices import GROUP, PAGE_ROWS, sliced

        seen = Observation()
        own = W.partitionBy("bucket").orderBy("path", "part_no")
        before = F.coalesce(F.sum(F.octet_length(F.coalesce("content", F.lit("")))).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        empty = sum(v is None for v in base.buckets.values())
        rows = placed(rows.withColumn("stripe", F.floor(F.col("part_no") / PARTS)), base).drop("stripe").repartition(max(1, empty), "bucket")
        rows = rows.withColumn("chunk_id", F.shiftleft(F.col("bucket").cast("long"), 32) + F.floor(before / CHUNK).cast("long"))
        rows = rows.sortWithinPartitions("bucket", "path", "part_no").observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.option("compression", "lz4_raw").partitionBy("bucket").parquet(f"{self.top}/{version}/data")
        got = {int(n.partition("=")[2]) for n in self.folder.names(f"{version}/data") if n.startswith("bucket=")}
        there = self.spark.read.parquet(f"{self.top}/{version}/data").count() if got else 0  # from footers
        if there != seen.get["n"]:
            raise OSError(f"{seen.get['n']} rows were written to {self.top}/{version} and {there} are there")
        if taken := {b for b in got if base.buckets.get(b, "") is not None}:
            raise ValueError(f"rows of buckets that are not to be written: {sorted(taken)[:5]}")
        if got:
            built = sliced(self.spark.read.parquet(f"{self.top}/{version}/data")).withColumn("bucket", F.shiftright(F.col("grp") * GROUP, 32).cast("int"))
            built = built.repartition(len(got), "bucket").sortWithinPartitions("bucket", "slice", "grp")
            built.write.option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("bucket").parquet(f"{self.top}/{version}/index")
        return Manifest(base.number + 1, {b: version if b in got else v for b, v in base.buckets.items()})

    def leased(self) -> set[str]:
        """Versions that a writer is still at."""
        out = set()
        for name in self.folder.names():
            if name.startswith("LEASE-"):
                try:
                    until = float(self.folder.read(name))
                except Exception:  # it goes, or comes, just now
                    until = math.inf
                if until > time.time():
                    out.add(name[6:])
        return out

    def clean(self) -> None:
        """Delete what neither the newest manifest nor the one before it names and no writer is at."""
        leased = self.leased()  # before the manifests: a version that is published meanwhile is in one of the two
        numbers = self.folder.numbers("MANIFEST-")
        keep = numbers[-2:]
        used = set()
        for n in keep:
            with contextlib.suppress(FormatError):  # nobody reads that
                used |= set(self.manifest(n).buckets.values())
        for name in self.folder.names():
            if (name.startswith("MANIFEST-") and int(name[9:]) < keep[0]) or (name.startswith("v") and name not in used | leased):
                self.folder.delete(name)
            elif name.startswith("LEASE-") and name[6:] not in leased:
                self.folder.delete(name)


class ChangeList:
    """Paths that differ from the index, as a table with numbered versions, of which readers take the highest that is whole."""

    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.folder = spark, Folder(spark, f"{top}/changes")

    def number(self) -> int:
        """Of the newest whole version; 0 if there is none."""
        return next((n for n in reversed(self.folder.numbers("c")) if "_SUCCESS" in self.folder.names(f"c{n}")), 0)

    def read(self, number: int | None = None) -> DataFrame:
        n = self.number() if number is None else number
        return self.spark.read.schema("path string").parquet(f"{self.folder.top}/c{n}") if n else self.spark.createDataFrame([], "path string")

    def write(self, paths: DataFrame) -> int:
        """Write a new version, sorted and unique, and delete those before the last."""
        numbers = self.folder.numbers("c")
        n = numbers[-1] + 1 if numbers else 1
        paths.select("path").where("path <> ''").distinct().sort("path").write.parquet(f"{self.folder.top}/c{n}")
        for old in numbers[:-1]:
            self.folder.delete(f"c{old}")
        return n

    def written(self) -> float:
        """When the newest whole version was, in seconds; 0 if there is none."""
        n = self.number()
        return self.folder.fs.getFileStatus(self.folder.at(f"c{n}/_SUCCESS")).getModificationTime() / 1000 if n else 0.0

    def forget(self, number: int) -> None:
        """Drop the changes of a version, once they are in the index; later ones stay."""
        now = self.number()
        if number and now > number:
            self.write(self.read(now).join(self.read(number), "path", "left_anti"))
        elif number and now == number:
            self.write(self.spark.createDataFrame([], "path string"))
