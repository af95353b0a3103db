"""Labelled rows to learn from: a bounded sample of the rows outside a held-out part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_of(id_col: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def training_rows(labels: DataFrame, docs: DataFrame, label: str, parts: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """``(y, text)`` of at most ``per_class`` rows of each label, and the share of label 1 among all.

    Rows of the held-out part, null ids and labels other than 0 and 1 are left out; an id with
    several labels counts with the largest, one with several texts with that of the least hash. Which
    rows are taken hangs on a hash of the id alone.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (part_of(id_col, parts) != held_out))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    order = F.xxhash64("id")
    sample = None
    for y in (0, 1):
        own = rows.where(F.col("y") == y).orderBy(order, "id").limit(per_class)
        sample = own if sample is None else sample.unionByName(own)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = text.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return own.select("y", "text"), share  # at most 2 * per_class rows, whatever repeats
