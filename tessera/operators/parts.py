"""Large files cut into parts at line ends, so that no row and no task holds a whole one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.info import CHUNK

#: Characters of parts that a task holds before it hands them on.
HELD = 32 << 20


def cut(text: str, target: int) -> Iterator[tuple[int, str]]:
    """(lines before, text) of parts that end at a line end once ``target`` bytes are in them; a longer line stays whole."""
    raw, at, before = text.encode("utf-8", "surrogatepass"), 0, 0
    while True:
        end = raw.find(b"\n", at + target - 1) + 1 if at + target <= len(raw) else 0
        part = raw[at : end or len(raw)]
        if part or not at:
            yield before, part.decode("utf-8", "surrogatepass")
        if not end or end >= len(raw):
            return
        before += part.count(b"\n")
        at = end


def parts(corpus: DataFrame, target: int = CHUNK, *carry: str) -> DataFrame:
    """``(path, part_no, start_line, content, *carry)``: parts of each file in order, the lines of all parts being the file's.

    Only files over ``target`` bytes go through Python.
    """
    large = F.octet_length(F.coalesce("content", F.lit(""))) > target
    rows = corpus.select("path", F.lit(0).alias("part_no"), F.lit(0).alias("start_line"), "content", *carry)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for own in b.to_dict("records"):
                for i, (n, t) in enumerate(cut(own["content"], target)):
                    held.append(own | {"part_no": i, "start_line": n, "content": t})
                    size += len(t)
                    if size > HELD:
                        yield pd.DataFrame(held)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held)

    return rows.where(~large).unionByName(rows.where(large).mapInPandas(split, rows.schema))
