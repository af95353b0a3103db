"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is cut at its quantiles; the cell of a row has an index on the curve, on which
neighbours are neighbours in all dimensions; rows sorted by it are cut into runs. A shard then spans
few values of each dimension, so that a filter on any of them skips most files.
"""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import fresh, importable, stored


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n, dims), integers under 2**bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and mirrorings of each level
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def cuts_of(rows: DataFrame, name: str, cells: int) -> list:
    """The distinct values, in order, at the ``cells``-quantiles of a column over all rows, nulls first; at most ``cells`` - 1.

    Values are counted, the counts sorted by value and summed up by ranges: exact for any type that
    can be ordered, and the driver gets a row a range and the cuts.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = F.col(name)
    counts = rows.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.repartitionByRange(parts, F.col("v").asc_nulls_first()).sortWithinPartitions(F.col("v").asc_nulls_first())
    counts = stored(counts.withColumn("at", F.monotonically_increasing_id()), "values")
    run = F.shiftright("at", 33)
    sizes = sorted((r.run, r.n) for r in counts.groupBy(run.alias("run")).agg(F.sum("n").alias("n")).collect())  # a row a range
    before, starts = 0, []
    for r, n in sizes:
        starts.append((r, before))
        before += n
    if not before:
        return []
    wanted = sorted({-(-before * k // cells) for k in range(1, cells)})  # ranks from 1
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "run long, start long"))
    upto = F.sum("n").over(W.partitionBy("run").orderBy("at")) + F.col("start")
    summed = counts.withColumn("run", run).join(starts, "run").select("v", "n", upto.alias("upto"))
    hit = F.exists(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (F.col("upto") >= w) & (F.col("upto") - F.col("n") < w))
    return sorted(r.v for r in summed.where(hit & F.col("v").isNotNull()).select("v").collect())  # at most a row a cut


def sharded(rows: DataFrame, dims: list[str], shards: int, keep: list[str], tie: str, bits: int = 4) -> DataFrame:
    """``(*keep, curve, shard, slot)``: rows in curve order, cut into ``shards`` runs whose counts are at most one apart.

    ``slot`` is the place in the shard, from 0 without gaps; rows of one cell go by ``tie`` and then
    the other kept columns. Dimensions are cut at the quantiles of their values over all rows, nulls
    first. Repeated rows each get a place; an empty table gives no rows. Only the kept columns are
    shuffled: keep ids and sizes to place rows, or all columns, none of them called ``curve``,
    ``shard`` or ``slot``, to write them; other columns may have any names.
    """
    if len(dims) * bits > 63:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits are over 63")
    importable(rows.sparkSession)

    @F.pandas_udf("long")
    def along(cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack(cells.to_numpy()), bits)) if len(cells) else pd.Series([], dtype="int64")

    cells = []
    for d in dims:
        cuts = cuts_of(rows, d, 1 << bits)
        cells.append(sum((F.coalesce(F.col(d) > F.lit(c), F.lit(False)).cast("long") for c in cuts), F.lit(0).cast("long")))
    curve, at = fresh(keep, "curve", "at")
    rows = rows.select(*keep, along(F.array(*cells)).alias(curve))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = rows.repartitionByRange(parts, curve, tie).sortWithinPartitions(curve, tie, *[k for k in keep if k != tie])
    # Stored with each row's run and place in it: ranks must not be taken from a shuffle that may run again.
    runs = stored(runs.withColumn(at, F.monotonically_increasing_id()), "curve")
    run, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.run, r.n) for r in runs.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a run
    total = sum(n for _, n in counts)
    before, starts = 0, []
    for r, n in counts:
        starts.append((r, before))
        before += n
    spark = rows.sparkSession
    run_, start, rank = fresh([*keep, curve, at], "run", "start", "rank")
    starts = F.broadcast(spark.createDataFrame(starts, f"{run_} long, {start} long"))
    ranked = runs.withColumn(run_, run).join(starts, run_).withColumn(rank, F.col(start) + place)
    shard = F.floor(F.col(rank) * shards / F.lit(max(1, total))) if total * shards > 1 << 52 else F.expr(f"{rank} * {shards} div {max(1, total)}")
    out = ranked.select(*keep, F.col(curve).alias("curve"), shard.cast("int").alias("shard"), F.col(rank))
    return out.select(*keep, "curve", "shard", (F.col(rank) - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str, parts: int | None = None) -> None:
    """Write rows that ``sharded`` has placed as one folder for each shard, its files being runs along the curve.

    Tasks take ranges of shard and place, about ``parts`` of near equal rows (default: the session's shuffle
    partitions), so a shard is written by several tasks, and a task writes to a few shards. Null values of
    kept columns stay; an empty table writes no shard; columns other than ``slot`` and ``curve`` are written.
    """
    parts = parts or int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot", "curve").write.partitionBy("shard").parquet(path)
