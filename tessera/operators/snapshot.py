"""Incremental upkeep: what changed between snapshots, and search over an index with changes laid on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lines import search
from tessera.plans.options import Options

STATUSES = ("added", "changed", "removed", "reused")


def differences(old: DataFrame, new: DataFrame, by_content: bool = False) -> DataFrame:
    """``(path, status)`` over both of ``(path, mtime, size[, digest])``: a file is reused if time and size, or its digest too, are equal."""
    same = (F.col("o.mtime") == F.col("n.mtime")) & (F.col("o.size") == F.col("n.size"))
    if by_content:
        same = same & (F.col("o.digest") == F.col("n.digest"))
    status = F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed").when(same, "reused").otherwise("changed")
    joined = old.alias("o").join(new.alias("n"), F.col("o.path") == F.col("n.path"), "full_outer")
    return joined.select(F.coalesce("o.path", "n.path").alias("path"), status.alias("status"))


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that are added, changed or gone."""
    return differences(old, new).where("status <> 'reused'").select("path")


def difference_counts(diff: DataFrame) -> DataFrame:
    """``(status, n)``."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def current_chunks(parts: DataFrame, files: DataFrame) -> DataFrame:
    """``(chunk_id, current)``: whether all parts of a chunk still have their file's time and size."""
    now = files.select("path", F.col("mtime").alias("now_mtime"), F.col("size").alias("now_size"))
    ok = F.coalesce((F.col("mtime") == F.col("now_mtime")) & (F.col("size") == F.col("now_size")), F.lit(False))
    return parts.join(now, "path", "left").groupBy("chunk_id").agg(F.bool_and(ok).alias("current"))


def overlaid(indexed: DataFrame, changes: DataFrame, now: DataFrame) -> DataFrame:
    """Indexed rows of unchanged paths, and the present rows of changed ones; a changed path without a present row is gone."""
    changed = changes.select("path").distinct()
    return indexed.join(changed, "path", "left_anti").unionByName(now.join(changed, "path", "left_semi").select(*indexed.columns))


def search_overlaid(indexed: DataFrame, changes: DataFrame, now: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    return search(overlaid(indexed, changes, now), query, options)


def merged_changes(*sets: DataFrame) -> DataFrame:
    """Union of change lists, each path once."""
    out = sets[0].select("path")
    for s in sets[1:]:
        out = out.unionByName(s.select("path"))
    return out.where("path <> ''").distinct()
