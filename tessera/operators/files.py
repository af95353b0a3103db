"""Search over paths: by regex on path or name, by tokens, and fuzzy with a rank."""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fuzzy import FAR, ranks
from tessera.functions.text import fold_ascii, name_of
from tessera.operators.lines import folded_contains
from tessera.plans.options import Options
from tessera.plans.pattern import compile_pattern



def entries(paths: DataFrame, order: Column | None = None) -> DataFrame:
    """``(ord, path, name)`` of a one-column table of paths; blank lines are dropped.

    ``order`` gives the input order that ties keep; without it paths are their own order.
    """
    path = F.col(paths.columns[0])
    rows = paths.select((order if order is not None else path).alias("ord"), path.alias("path")).where("path <> ''")
    return rows.withColumn("name", name_of(F.col("path")))


def by_tokens(query: str, ignore_case: bool) -> Column:
    """All tokens, literally: one with a slash in the path, another in the name."""
    each = [folded_contains(F.col("path" if set(t) & set("/\\") else "name"), t, ignore_case) for t in query.split()]
    return reduce(Column.__and__, each) if each else F.lit(True)


def subsequence(query: str) -> Column:
    """The query's characters in this order in the path, without case."""
    quoted = [f"\\x{{{ord(c):x}}}" for c in query.lower()]
    return fold_ascii(F.col("path")).rlike("(?s)" + ".*?".join(quoted))


def rank(query: str, path: str) -> int | None:
    """The rank of one path; None without one."""
    cost = int(ranks(query, [path])[0])
    return None if cost >= FAR else cost


@lru_cache(maxsize=64)
def rank_udf(query: str):
    @F.arrow_udf("int")
    def ranked(path: pa.Array) -> pa.Array:
        cost = ranks(query, [p or "" for p in path.to_pylist()])
        return pa.array(cost, pa.int32(), mask=cost >= FAR)

    return ranked


def fuzzy(rows: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Fuzzy matches with their ``score``, least first, ties in input order. Only rows that the native subsequence test passes reach Python.

    Without a limit, what is found is shuffled once before the sort, whose sample would else rank it all once more.
    """
    found = rows.where(subsequence(query)).withColumn("score", rank_udf(query)(F.col("path")))
    return found.repartition("ord").orderBy("score", "ord") if limit is None else found.orderBy("score", "ord").limit(limit)


def matches(query: str, options: Options) -> Column:
    """Whether a row matches in the options' style, but for fuzzy."""
    if options.style == "tokens":
        return by_tokens(query, options.ignore_case)
    return compile_pattern(query, options.ignore_case, options.literal).matches(F.col(options.style))


def find(rows: DataFrame, query: str, options: Options = Options(), path_filters: bool = False) -> DataFrame:
    """Entries that match in the options' style; an empty query matches all. Include and exclude count only with ``path_filters``."""
    from tessera.operators.lines import accepts

    if path_filters:
        rows = rows.where(accepts(F.col("path"), options.include, options.exclude))
    if query and options.style == "fuzzy":
        return fuzzy(rows, query, options.limit)
    rows = (rows.where(matches(query, options)) if query else rows).orderBy("ord")
    return rows if options.limit is None else rows.limit(options.limit)
