"""Trees that are known already: a look at one opens only the folders that have changed.

What is known is a table in the store, a row for each folder with a stamp (its inode and its times to the
nanosecond) and one for each file with time and size. A look asks the file system for these again, row by
row in tasks, and hands on only rows that differ: over a tree at rest nothing is shuffled, listed or
written. Folders with another stamp are listed, one level of new folders below them at a time, each level
in tasks of its own; so a deep branch, or the first look at a tree, isn't one task's work.

A folder whose time is as new as its listing gets no stamp, since it may change within the same tick of
the clock: the next look lists it again. Links are left out wherever they are, also above a known folder.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import Folder
from tessera.sources.tree import SCHEMA, SKIPPED, skipper

#: A row of what is known; a file's has no stamp, a folder's no name. A look adds whether it is gone, a listing whether it is a folder to list.
KNOWN = "root string, folder string, name string, mtime long, size long, stamp string"
COLUMNS = ["root", "folder", "name", "mtime", "size", "stamp"]
#: Seconds within which a folder's time says nothing, rows handed on at once, and tasks of a listing per core.
TICK, ROWS, TASKS = 2.0, 10_000, 4


def stamp_of(folder: str, root: str, tick: float | None = None) -> str | None:
    """What a folder changes with; '' if it changed within the last ``tick`` seconds, None if it is no folder. A root may be a link."""
    try:
        s = os.stat(folder, follow_symlinks=folder == root)
    except OSError:
        return None
    if not stat.S_ISDIR(s.st_mode):
        return None
    return "" if tick is not None and time.time() - max(s.st_mtime, s.st_ctime) < tick else f"{s.st_ino}:{s.st_mtime_ns}:{s.st_ctime_ns}"


def _file(path: str) -> tuple[int, int] | None:
    try:
        s = os.lstat(path)
    except OSError:
        return None
    return (int(s.st_mtime), s.st_size) if stat.S_ISREG(s.st_mode) else None


class _Links:
    """Whether some folder between a root and a path is a link now; each is asked once."""

    def __init__(self):
        self.asked: dict[tuple[str, str], bool] = {}

    def above(self, root: str, folder: str) -> bool:
        up = os.path.dirname(folder)
        if len(up) <= len(root):
            return False
        if (root, up) not in self.asked:
            self.asked[root, up] = os.path.islink(up) or self.above(root, up)
        return self.asked[root, up]


def _table(rows: list[tuple], last: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*COLUMNS, last]).astype({"mtime": "Int64", "size": "Int64", last: "bool"})


def differing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Known rows that the file system has otherwise now, with its values, and whether they are gone."""
    for b in batches:
        links, out = _Links(), []
        for root, folder, name, mtime, size, stamp in zip(*(b[c].tolist() for c in COLUMNS), strict=True):
            if name is None:
                now = None if links.above(root, folder) else stamp_of(folder, root)
                if now != stamp and (now is not None or folder != root or stamp != ""):  # a root that isn't there stays as it is
                    out.append((root, folder, None, None, None, now, now is None))
            else:
                own = _file(f"{folder}/{name}")
                if own != (mtime, size):
                    out.append((root, folder, name, *(own or (None, None)), None, own is None))
        yield _table(out, "gone")


def _level(excludes: dict[str, list[list[str]]], tick: float = TICK):
    """A function that lists folders: a row of each, of its files, and of the folders right below it."""

    def list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skips = {}
        for b in batches:
            out: list[tuple] = []
            for root, folder in zip(b["root"].tolist(), b["folder"].tolist(), strict=True):
                skip = skips.setdefault(root, skipper(root, excludes[root]))
                stamp = stamp_of(folder, root, tick)  # before it is listed: what comes meanwhile changes it
                if stamp is None:
                    if folder == root:
                        out.append((root, folder, None, None, None, "", False))
                    continue
                out.append((root, folder, None, None, None, stamp, False))
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            if e.is_symlink() or e.name in SKIPPED:
                                continue
                            if e.is_dir():
                                if not skip(e.path):
                                    out.append((root, e.path, None, None, None, None, True))
                            elif (own := _file(e.path)) is not None:
                                out.append((root, folder, e.name, *own, None, False))
                            if len(out) >= ROWS:
                                yield _table(out, "below")
                                out = []
                except OSError:
                    continue
            yield _table(out, "below")

    return list_folders


class KnownTree:
    """What is known of some roots, each with its ``excludes``, as numbered tables of which readers take the newest whole one."""

    def __init__(self, spark: SparkSession, top: str, roots: dict[str, list[list[str]]], tick: float = TICK):
        self.spark, self.tick, self.roots = spark, tick, {r.rstrip("/") or "/": own for r, own in roots.items()}
        name = hashlib.sha256(json.dumps(sorted(self.roots.items())).encode()).hexdigest()[:16]
        self.folder = Folder(spark, f"{top}/tree-{name}")

    def number(self) -> int:
        return next((n for n in reversed(self.folder.numbers("t")) if "_SUCCESS" in self.folder.names(f"t{n}")), 0)

    def known(self, number: int | None = None) -> DataFrame | None:
        n = self.number() if number is None else number
        return self.spark.read.schema(KNOWN).parquet(f"{self.folder.top}/t{n}") if n else None

    def files(self) -> DataFrame:
        """``(path, mtime, size)`` as of the last look."""
        rows = self.known()
        if rows is None:
            return self.spark.createDataFrame([], SCHEMA)
        return rows.where("name IS NOT NULL").select(F.concat_ws("/", F.when(F.col("folder") != "/", F.col("folder")).otherwise(""), "name").alias("path"), "mtime", "size")

    def look(self) -> bool:
        """Whether the tree differs from what was known, which is then written anew."""
        number = self.number()
        known = self.known(number)
        work = f".work-{uuid.uuid4().hex}"
        try:
            if known is None:
                rows = self._listed(self.spark.createDataFrame([(r, r) for r in self.roots], "root string, folder string"), None, work)
            else:
                diff = self._kept(known.mapInPandas(differing, KNOWN + ", gone boolean"), f"{work}/diff")
                if diff.isEmpty():
                    return False
                rows = self._joined(known, diff, work)
            rows.write.parquet(f"{self.folder.top}/t{max(self.folder.numbers('t'), default=0) + 1}")
        finally:
            self.folder.delete(work)
        for old in self.folder.numbers("t"):
            if old < number:
                self.folder.delete(f"t{old}")
        return True

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.folder.top}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder.top}/{name}")

    def _joined(self, known: DataFrame, diff: DataFrame, work: str) -> DataFrame:
        """The known rows that still hold, those of files that changed, and the listings of folders that did."""
        key = ["root", "folder"]
        other = diff.where("name IS NULL").select(*key)
        files = diff.where("name IS NOT NULL")
        still = known.where("name IS NULL").select(*key).join(diff.where("name IS NULL AND gone").select(*key), key, "left_anti")
        listed = self._listed(diff.where("name IS NULL AND NOT gone OR folder = root AND name IS NULL").select(*key), still, work)
        kept = known.join(other, key, "left_anti")
        folders, named = kept.where("name IS NULL"), kept.where("name IS NOT NULL").join(files.select(*key, "name"), [*key, "name"], "left_anti")
        changed = files.where("NOT gone").join(other, key, "left_anti")
        return folders.unionByName(named).unionByName(changed.select(*COLUMNS)).unionByName(listed)

    def _listed(self, folders: DataFrame, known: DataFrame | None, work: str) -> DataFrame:
        """Rows of folders and of all those below them that aren't known, a level a round."""
        tasks = TASKS * self.spark.sparkContext.defaultParallelism
        out, level = None, 0
        while level == 0 or not folders.isEmpty():
            found = self._kept(folders.repartition(tasks, "root", "folder").mapInPandas(_level(self.roots, self.tick), KNOWN + ", below boolean"), f"{work}/{level}")
            rows = found.where("NOT below").select(*COLUMNS)
            out = rows if out is None else out.unionByName(rows)
            folders = found.where("below").select("root", "folder")
            if known is not None:
                folders = folders.join(known, ["root", "folder"], "left_anti")
            level += 1
        return out
