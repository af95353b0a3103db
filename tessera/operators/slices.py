"""The gram index by slices: a row for each bit of the filters, which tells which chunks have it set.

A filter of one round has as many bits as a fiftieth of a chunk has bytes, in bits; 64 chunks are a group,
and a row ``(grp, slice, word)`` holds one bit of each of their filters. A search needs the slices of its
literals' 4-grams alone: they are a filter that reaches the Parquet scan, whose pages are sorted by slice,
and the words of a group are joined by ``bit_and`` in the JVM. What is read grows with the grams asked for,
not with the filters' size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bloom import first_hashes, grams
from tessera.operators.index import kept
from tessera.plans.pattern import Needs
from tessera.sources.ranges import CHUNK

#: Bits of a chunk's filter, and chunks of a group.
SIZE, GROUP = CHUNK // 50 * 8, 64
#: Rows of a page of the index at most, so that few are read for a slice; slices that a scan filters by one by one.
PAGE_ROWS, ASKED = 2000, 2000


def places(text: bytes) -> np.ndarray:
    """The filter's bits of a text's 4-grams."""
    return np.unique(first_hashes(grams(text)) % np.uint32(SIZE)).astype(np.int64)


def sliced(parts: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """``(grp, slice, word)`` of ``parts(chunk_id, content)`` in which a group's rows follow each other, as a store writes them.

    Slice -1 tells which chunks are there at all. Nothing is shuffled. A group that two tasks read has two
    rows for a slice, which a search joins.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, words = None, np.zeros(SIZE + 1, np.uint64)  # the last is slice -1

        def rows() -> pd.DataFrame:
            some = np.flatnonzero(words)
            return pd.DataFrame({"grp": np.full(len(some), now, np.int64), "slice": np.where(some < SIZE, some, -1).astype(np.int32), "word": words[some].view(np.int64)})

        for b in batches:
            for own, text in zip(b["chunk_id"].tolist(), b["content"].tolist(), strict=True):
                if own // GROUP != now:
                    if now is not None:
                        yield rows()
                    now = own // GROUP
                    words[:] = 0
                bit = np.uint64(1) << np.uint64(own % GROUP)
                words[places((text or "").encode())] |= bit
                words[SIZE] |= bit
        if now is not None:
            yield rows()

    return parts.select(F.col(chunk).cast("long").alias("chunk_id"), "content").mapInPandas(build, "grp long, slice int, word long")


def useful(need: Needs | None) -> Needs | None:
    """What of it the index can tell; None if that is nothing."""
    if need is None or need.how == "text":
        return need if need and len(grams(need.text.encode())) else None
    parts = [useful(p) for p in need.parts]
    if need.how == "any" and None in parts:
        return None
    parts = [p for p in parts if p]
    return Needs(need.how, "", tuple(parts)) if parts else None


def _asked(need: Needs) -> dict[str, list[int]]:
    return {need.text: places(need.text.encode()).tolist()} if need.how == "text" else {t: s for p in need.parts for t, s in _asked(p).items()}


def possible(index: DataFrame, need: Needs) -> DataFrame:
    """``(chunk_id)`` of the chunks that the index does not rule out, by built-in functions alone. ``need`` is ``useful``."""
    asked = _asked(need)
    every = sorted({s for own in asked.values() for s in own})
    # Spark hands a longer list to the scan as its bounds only.
    index.sparkSession.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(max(ASKED, int(index.sparkSession.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")))))
    rows = index.where(F.col("slice").isin(every)).groupBy("grp", "slice").agg(F.bit_or("word").alias("word"))
    names = {t: f"t{i}" for i, t in enumerate(asked)}
    cells = []
    for text, own in asked.items():
        mine = F.when(F.col("slice").isin(own), F.col("word"))
        cells += [F.bit_and(mine).alias(names[text]), F.count(mine).alias(f"n_{names[text]}")]
    rows = rows.groupBy("grp").agg(*cells)

    def word(n: Needs) -> Column:
        if n.how == "text":
            return F.when(F.col(f"n_{names[n.text]}") == len(asked[n.text]), F.col(names[n.text])).otherwise(F.lit(0).cast("long"))
        return reduce(Column.bitwiseAND if n.how == "all" else Column.bitwiseOR, [word(p) for p in n.parts])

    chunk = F.explode(F.filter(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda j: F.call_function("shiftright", F.col("word"), j).bitwiseAND(F.lit(1)) == 1))
    return rows.select("grp", word(need).alias("word")).where("word <> 0").select("grp", chunk.alias("at")).select((F.col("grp") * GROUP + F.col("at")).alias("chunk_id"))


def pruned(corpus: DataFrame, index: DataFrame, need: Needs) -> DataFrame:
    """Rows of ``corpus(chunk_id, ...)`` in possible chunks."""
    asked = useful(need)
    return corpus if asked is None else kept(corpus, possible(index, asked))


def stats(index: DataFrame) -> DataFrame:
    """One row: indexed chunks, bytes of the words, and the share of bits that are set."""
    one = lambda n, taken: F.coalesce(F.sum(F.when(taken, n)), F.lit(0))
    rows = index.groupBy("grp", "slice").agg(F.bit_or("word").alias("word"), F.count(F.lit(1)).alias("n"))
    out = rows.agg(one(F.bit_count("word"), F.col("slice") < 0).alias("indexed"), one(F.col("n") * 8, F.lit(True)).alias("bytes"), one(F.bit_count("word"), F.col("slice") >= 0).alias("bits"))
    return out.select("indexed", "bytes", (F.col("bits") / F.greatest(F.lit(1), F.col("indexed") * SIZE)).alias("filled_avg"))
