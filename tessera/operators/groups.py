"""Which files a project's groups accept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.pattern import compile_pattern
from tessera.sources.config import Group


def accepted(group: Group, path: Column) -> Column:
    """Every group from this one up that has includes has one that matches; no exclude of any matches the path or a folder above it."""
    out, at = F.lit(True), group
    while at is not None:
        if at.include:
            out = out & reduce(Column.__or__, [compile_pattern(p, ignore_case=True).matches(path) for p in at.include])
        if at.exclude:
            plans = [compile_pattern(p, ignore_case=True) for p in at.exclude]
            out = out & ~reduce(Column.__or__, [p.matches(path) for p in plans])
            steps = F.split(path, "/")
            folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
            in_folder = F.exists(folders, lambda f: reduce(Column.__or__, [p.matches(f) for p in plans]))
            out = out & ~(F.contains(path, F.lit("/")) & in_folder)
        at = at.parent
    return out


def under_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files(path, ...)`` with the columns of ``roots(root, ...)`` of each root that holds them, and ``rest``, what follows it.

    A root is a folder, with or without a slash at its end. Of a path only the prefixes that are as deep as
    some root are looked up, in one join whatever the number of roots: Spark broadcasts them if they are
    few, and else shuffles by prefix. A file in several roots comes once for each; one in none not at all.
    """
    roots = roots.withColumn("root", F.rtrim(F.col("root"), F.lit("/")))
    deep = F.length("root") - F.length(F.replace("root", F.lit("/"), F.lit(""))) + 1
    depths = sorted(r[0] for r in roots.where("root is not null").select(deep).distinct().collect())  # a row a depth
    steps = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))) + 1
    prefixes = F.array(*(F.when(steps > n, F.substring_index("path", "/", n)) for n in depths)) if depths else F.array().cast("array<string>")
    rows = files.withColumn("root", F.explode(F.array_compact(prefixes)))
    return rows.join(roots, "root").withColumn("rest", F.col("path").substr(F.length("root") + 2, F.length("path")))


def project_files(group: Group, scanned: DataFrame) -> DataFrame:
    """Files of a group and its children, each path once: those accepted under its folders, and those named one by one.

    ``scanned(path, ...)`` has full paths and is read once; patterns see what follows the folder. Groups with
    the same patterns are one condition.
    """
    spark, chains = scanned.sparkSession, {}
    roots, named = set(), set()
    for g in group.walk():
        chain, at = [], g
        while at is not None:
            chain, at = [*chain, (tuple(at.include), tuple(at.exclude))], at.parent
        number, _ = chains.setdefault(tuple(chain), (len(chains), g))
        roots |= {(root.rstrip("/"), number) for root in g.paths}
        named |= set(g.files)
    held = under_roots(scanned, spark.createDataFrame(sorted(roots), "root string, chain int"))
    taken = F.lit(False)
    for number, g in chains.values():
        taken = F.when(F.col("chain") == number, accepted(g, F.col("rest"))).otherwise(taken)
    found = held.where(taken).select(*scanned.columns)
    if named:
        found = found.unionByName(scanned.join(spark.createDataFrame([(f,) for f in sorted(named)], "path string"), "path", "left_semi"))
    return found.dropDuplicates(["path"])
