"""An optional index of 4-grams: a Bloom filter for each chunk of the corpus.

A text without all 4-grams of a literal that a match needs can't match, nor can a chunk of texts whose
filter lacks one. Grams are of folded bytes within lines; literals under four bytes prune nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.bloom import bloom, filter_size, grams, grams_udf, might_hold
from tessera.operators.lines import search
from tessera.plans.options import Options
from tessera.plans.pattern import Needs, compile_pattern

#: Chunks that a search broadcasts, at most.
BROADCAST_CHUNKS = 100_000


def gram_sets(corpus: DataFrame) -> DataFrame:
    """``(path, grams)``: the distinct 4-grams of each content, sorted."""
    return corpus.select("path", grams_udf(F.col("content").cast("binary")).alias("grams"))


def _filter(chunk: int, texts: list[bytes]) -> tuple[int, int, bytes, int]:
    raw = b"\n".join(texts)
    own = grams(raw)
    size, rounds = filter_size(len(raw), len(own))
    return chunk, len(raw), bloom(own, size, rounds) if size else b"", rounds


def blooms(parts: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """``(chunk_id, bytes, bloom, rounds)`` of ``parts(chunk_id, content)`` in which a chunk's rows follow each other, as a store writes them.

    Nothing is shuffled: a chunk that two tasks read gets two filters, either of which may hold what a
    text of it needs. Small chunks have an empty filter, which rules nothing out.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, texts, out = None, [], []
        for b in batches:
            for own, text in zip(b["chunk_id"].tolist(), b["content"].tolist(), strict=True):
                if own != now and texts:
                    out.append(_filter(now, texts))
                    texts = []
                now = own
                texts.append((text or "").encode())
        if texts:
            out.append(_filter(now, texts))
        yield pd.DataFrame(out, columns=["chunk_id", "bytes", "bloom", "rounds"])

    return parts.select(F.col(chunk).cast("long").alias("chunk_id"), "content").mapInPandas(build, "chunk_id long, bytes long, bloom binary, rounds int")


def _may(need: Needs, raw: bytes, rounds: int, known: dict[str, np.ndarray]) -> bool:
    if need.how == "text":
        return might_hold(raw, known[need.text], rounds)
    return (all if need.how == "all" else any)(_may(p, raw, rounds, known) for p in need.parts)


def _texts(need: Needs) -> list[str]:
    return [need.text] if need.how == "text" else [t for p in need.parts for t in _texts(p)]


def possible_chunks(index: DataFrame, need: Needs) -> DataFrame:
    """Chunks whose filter does not rule out what a match needs."""
    known = {t: grams(t.encode()) for t in _texts(need)}

    @F.pandas_udf("boolean")
    def may(raw: pd.Series, rounds: pd.Series) -> pd.Series:
        return pd.Series([_may(need, b, r, known) for b, r in zip(raw, rounds, strict=True)], dtype=bool)

    return index.where(may("bloom", "rounds")).select("chunk_id").distinct()


def wanted(query: str, options: Options) -> Needs | None:
    """What the index can look for; None if the search goes without it."""
    if options.bruteforce:
        return None
    plan = compile_pattern(query, options.ignore_case, options.literal)
    return Needs("text", plan.literal) if plan.literal else plan.needs


def search_indexed(corpus: DataFrame, index: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    """As ``search`` over ``corpus(path, content, chunk_id)``, only in chunks that the index can't rule out; ``bruteforce`` turns it off."""
    need = wanted(query, options)
    return search(corpus if need is None else pruned(corpus, index, need), query, options)


def pruned(corpus: DataFrame, index: DataFrame, need: Needs) -> DataFrame:
    """Rows of possible chunks."""
    return kept(corpus, possible_chunks(index, need))


def kept(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the chunks found. A few chunks are a filter that reaches the scan; some more are broadcast."""
    few = sorted(r.chunk_id for r in found.limit(BROADCAST_CHUNKS + 1).collect())
    if len(few) > BROADCAST_CHUNKS:
        return corpus.join(found, "chunk_id", "left_semi")
    if len(few) <= 1000:
        return corpus.where(F.col("chunk_id").isin(few))
    return corpus.join(F.broadcast(corpus.sparkSession.createDataFrame([(c,) for c in few], "chunk_id long")), "chunk_id", "left_semi")
