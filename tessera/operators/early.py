"""A limit that ends a search early: path ranges are searched in order, each four times the one before, until enough lines are there.

The ranges follow each other and don't overlap, so no row is searched twice, and the lines are those of
the whole search. On a table sorted by path a range reaches the Parquet scan as a filter that skips row
groups and pages, so what is read grows with the lines asked for. Where the ranges are cut changes only
how soon a search ends, so cuts may come from a sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.operators.lines import ordered, search
from tessera.plans.options import Options

#: Pieces that a corpus is cut into, about, and how many more of them each range has than the one before.
PIECES, GROWTH = 256, 4


def cuts(corpus: DataFrame, pieces: int = PIECES) -> list[str]:
    """At most so many paths that part a corpus evenly: of each class of path hashes, the path with the least other hash. Null paths cut nothing."""
    one = corpus.where("path IS NOT NULL").groupBy(F.pmod(F.xxhash64("path"), F.lit(pieces)).alias("cell")).agg(F.min_by("path", F.xxhash64(F.lit(1), "path")).alias("path"))
    return thinned([r.path for r in one.select("path").collect()], pieces)  # a path a class


def thinned(paths: list[str], pieces: int = PIECES) -> list[str]:
    """Paths once each, in Spark's order, and of these evenly so many."""
    every = sorted(set(paths), key=str.encode)
    step = max(1, -(-len(every) // pieces))
    return every[::step]


def ranges(at: list[str]) -> Iterator[tuple[str | None, str | None]]:
    """Ranges (from, to) of all paths, open at both ends, that have 1, 4, 16, ... of the pieces between cuts."""
    begin, i, n = None, 0, 1
    while i + n <= len(at):
        end = at[i + n - 1]
        yield begin, end
        begin, i, n = end, i + n, n * GROWTH
    yield begin, None


def within(corpus: DataFrame, begin: str | None, end: str | None) -> DataFrame:
    """Rows with paths from ``begin`` to before ``end``; null paths, which sort first, are in the range that has no begin."""
    if begin is not None:
        corpus = corpus.where(F.col("path") >= begin)
    if end is not None:
        corpus = corpus.where((F.col("path") < end) if begin is not None else (F.col("path").isNull() | (F.col("path") < end)))
    return corpus


def first_rows(part: Callable[[str | None, str | None], DataFrame], at: list[str], limit: int, found: Callable[[DataFrame, int], DataFrame]) -> Iterator[Row]:
    """The first rows of ``found(rows of a range, rows at most)``, which gives rows in path order; ``part`` gives the rows of a range."""
    left = limit
    for begin, end in ranges(at):
        if not left:
            return
        for r in found(part(begin, end), left).toLocalIterator():
            left -= 1
            yield r


def reach(corpus: DataFrame, query: str, options: Options, limit: int, at: list[str]) -> str | None:
    """The first cut before which there are ``limit`` matching lines; None if only the whole has them."""
    n = 0
    for begin, end in ranges(at):
        if end is not None:
            n += search(within(corpus, begin, end), query, options).limit(limit).count()
            if n >= limit:
                return end


def search_first(corpus: DataFrame, query: str, options: Options, at: list[str] | None = None) -> DataFrame:
    """The ordered lines up to the limit, as one table: rows behind the cut where the limit is reached are left out of it.

    For tables sorted by path, of which the rows before the cut are read twice; in others each range reads all
    texts' paths, and ``lines.ordered`` with a limit does better.
    """
    end = reach(corpus, query, options, options.limit, cuts(corpus) if at is None else at)
    return ordered(search(within(corpus, None, end), query, options), options.limit)
