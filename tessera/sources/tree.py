"""Directory trees as DataFrames, with contents as UTF-8 text."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.text import normal_line_ends
from tessera.plans.pattern import compile_pattern, in_python

# Folders of version control.
SKIPPED = ("CVS", ".bzr", ".git", ".hg", ".svn")
SCHEMA = "path string, mtime long, size long"
#: Folders that the driver lists for tasks to walk, about; levels that it opens, at most.
BRANCHES, LEVELS = 256, 4


def not_versioned(path: Column) -> Column:
    """False for paths through a version control folder."""
    names = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    return ~path.rlike(rf"(^|/)({names})(/|$)")


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        return sorted((e for e in os.scandir(folder) if not e.is_symlink() and e.name not in SKIPPED), key=lambda e: os.fsencode(e.name))
    except OSError:
        return []


def scan(root: str, skip: Callable[[str], bool] = lambda folder: False) -> Iterator[tuple[str, int, int]]:
    """(path, mtime in seconds, size) of regular files below a folder, links left out, in byte order of names. Folders to ``skip`` are not entered."""
    for e in _entries(root):
        if e.is_dir():
            if not skip(e.path):
                yield from scan(e.path, skip)
        elif e.is_file():
            s = e.stat()
            yield e.path.replace(os.sep, "/"), int(s.st_mtime), s.st_size


def skipper(root: str, excludes: list[list[str]]) -> Callable[[str], bool]:
    """Whether a folder is excluded by each of some groups' patterns; they see what follows the root."""
    plans = [[in_python(compile_pattern(p, ignore_case=True)) for p in own] for own in excludes]
    cut = len(root.rstrip("/")) + 1

    def skip(folder: str) -> bool:
        path = folder.replace(os.sep, "/")[cut:]
        return bool(plans) and all(any(p(path) for p in own) for own in plans)

    return skip


class _Branches(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class TreeReader(DataSourceReader):
    """Tasks of folders: the upper levels are opened until there are some hundred. Of many roots a task has several."""

    def __init__(self, roots: list[tuple[str, list[list[str]]]]):
        self.roots = roots

    def partitions(self) -> list[_Branches]:
        skips = [skipper(*r) for r in self.roots]
        files, level, depth = [], [(r[0], i) for i, r in enumerate(self.roots)], 0
        while level and len(level) < BRANCHES and depth < LEVELS:
            found = [(e, i) for folder, i in level for e in _entries(folder)]
            files += [(e.path, i) for e, i in found if not e.is_dir() and e.is_file()]
            level, depth = [(e.path, i) for e, i in found if e.is_dir() and not skips[i](e.path)], depth + 1
        each = -(-len(level) // (4 * BRANCHES))
        every = [_Branches(level[i : i + each]) for i in range(0, len(level), max(1, each))] + [_Branches(files[i : i + 1000]) for i in range(0, len(files), 1000)]
        return every or [_Branches([])]

    def read(self, partition: _Branches) -> Iterator[tuple]:
        skips: dict[int, Callable[[str], bool]] = {}
        for path, i in partition.paths:
            skip = skips.setdefault(i, skipper(*self.roots[i]))
            if os.path.isdir(path):
                yield from scan(path, skip)
            else:
                s = os.stat(path)
                yield path.replace(os.sep, "/"), int(s.st_mtime), s.st_size


class TreeSource(DataSource):
    """``spark.read.format("tessera_tree").option("roots", ...)``: metadata only, contents are not opened. ``roots``: JSON of folders, each with lists of patterns."""

    @classmethod
    def name(cls) -> str:
        return "tessera_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader([(root, excludes) for root, excludes in json.loads(self.options["roots"])])


def listing(spark: SparkSession, root: str, excludes: list[list[str]] | None = None) -> DataFrame:
    """Files below a folder; folders that each of the ``excludes`` lists rules out are not walked."""
    return listings(spark, {root: excludes or []})


def listings(spark: SparkSession, roots: dict[str, list[list[str]]]) -> DataFrame:
    """Files below any number of folders, in one scan; each has its ``excludes``."""
    spark.dataSource.register(TreeSource)
    return spark.read.format(TreeSource.name()).option("roots", json.dumps(sorted(roots.items()))).load()


def stats(paths: DataFrame) -> DataFrame:
    """``(path, mtime, size)`` of those of the paths that are regular files now."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(p, os.stat(p)) for p in b["path"] if os.path.isfile(p)]
            yield pd.DataFrame([(p, int(s.st_mtime), s.st_size) for p, s in found], columns=["path", "mtime", "size"])

    return paths.select("path").mapInPandas(look, SCHEMA)


def to_utf8(raw: bytes) -> bytes:
    """UTF-8 of text with a byte order mark of UTF-8, 16 or 32; other bytes as they are. Lone surrogates go."""
    for mark, code in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            text = raw[len(mark) :]
            text = text[: len(text) - len(text) % (4 if "32" in code else 2)].decode(code, "surrogatepass" if "16" in code else "ignore")
            return "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000).encode()
    return raw.removeprefix(b"\xef\xbb\xbf")


@F.pandas_udf(BinaryType())
def to_utf8_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: to_utf8(x) if x is not None else None)


def decoded(raw: Column) -> Column:
    """Text of raw bytes: transcoded, invalid bytes replaced, line ends normalised, in that order. Only bytes with a mark of another encoding go to Python."""
    two, three, four = (F.substring(raw, 1, n) for n in (2, 3, 4))
    wide = two.isin(b"\xff\xfe", b"\xfe\xff") | (four == F.lit(b"\0\0\xfe\xff"))
    plain = F.when(three == F.lit(b"\xef\xbb\xbf"), F.substring(raw, 4, 1 << 30)).otherwise(raw)
    return text_of(F.when(wide, to_utf8_udf(F.when(wide, raw))).otherwise(plain))


def text_of(raw: Column) -> Column:
    """Text of bytes that should be UTF-8: invalid ones replaced, line ends normalised."""
    return normal_line_ends(F.make_valid_utf8(raw.cast("string")))


def contents(spark: SparkSession, paths: list[str], root: str | None = None) -> DataFrame:
    """``(path, mtime, size, content)`` of folders or files. With ``root`` paths are given from it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    path = F.regexp_replace("path", "^file:/+", "/")
    if root:
        path = path.substr(F.lit(len(root.rstrip("/")) + 2), F.length(path))
    rows = rows.withColumn("path", path).where(not_versioned(F.col("path")))
    return rows.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), decoded(F.col("content")).alias("content"))
