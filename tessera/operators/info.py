"""Statistics of a corpus and of its chunks, and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.lines import lines

CHUNK = 512 * 1024


def line_counts(corpus: DataFrame) -> DataFrame:
    """``(path, bytes, n_lines, longest)`` of each row, lengths in bytes, no line behind a final LF."""
    content = F.coalesce(F.col("content"), F.lit(""))
    pieces = F.split(content, "\n", -1)
    n = F.when(content == "", 0).when(F.endswith(content, F.lit("\n")), F.size(pieces) - 1).otherwise(F.size(pieces))
    longest = F.coalesce(F.array_max(F.transform(pieces, lambda x: F.octet_length(x))), F.lit(0))
    return corpus.select(*[c for c in corpus.columns if c != "content"], F.octet_length(content).cast("long").alias("bytes"), n.cast("long").alias("n_lines"), longest.cast("long").alias("longest"))


def summary(corpus: DataFrame) -> DataFrame:
    """One row: files, parts, bytes, lines, longest line and, of the files that have one, the last by path."""
    own = F.struct("longest", "path")
    rows = line_counts(corpus).agg(
        F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"), F.max(own).alias("top")
    )
    return rows.select("files", "parts", "bytes", "lines", F.col("top.longest").alias("longest_line"), F.col("top.path").alias("longest_file"))


def line_lengths(corpus: DataFrame) -> DataFrame:
    """Lines by path: how many and the longest in bytes, from the lines themselves."""
    return lines(corpus).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.octet_length("line")).cast("long").alias("longest"))


def running(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one in ``order``: ranges summed apart, then each by what lies before it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = [c[0] for c in _cuts(rows, order, parts)]
    # Ranges by fixed bounds: a task that runs again makes the same ones.
    ranged = rows.withColumn("__range", sum((F.coalesce(F.col(order) > F.lit(b), F.lit(False)).cast("int") for b in bounds), F.lit(0)))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))  # one row a range
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    own = W.partitionBy("__range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(F.broadcast(before), "__range").withColumn(out, F.coalesce(F.sum(value).over(own), F.lit(0)) + F.col("__before")).drop("__range", "__before")


def _cuts(rows: DataFrame, order: str, parts: int) -> list[tuple]:
    """Bounds of near equal ranges: quantiles of the rows with the least hashes, the same for each run."""
    least = sorted(r[0] for r in rows.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(100 * parts).collect())  # a hundred a range
    return [(v,) for v in sorted({least[len(least) * k // parts] for k in range(1, parts)})] if least else []


def chunked(corpus: DataFrame, target: int = CHUNK) -> DataFrame:
    """Files with their ``chunk_id``: in path order, a chunk being the files that begin in the same ``target`` bytes."""
    sized = corpus.select("path", F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("size"))
    return running(sized, "path", "size", "before").select("path", "size", F.floor(F.col("before") / target).cast("long").alias("chunk_id"))


def chunk_stats(files: DataFrame) -> DataFrame:
    """One row over chunks: count, total, least size but for the last chunk, largest and mean size."""
    chunks = files.groupBy("chunk_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    last = chunks.agg(F.max("chunk_id").alias("last"))
    rows = chunks.join(F.broadcast(last))  # one row
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("total"), F.min(F.when(F.col("chunk_id") < F.col("last"), F.col("size"))).alias("least"), F.max("size").alias("most"), F.avg("size").alias("mean"))


def integrity(parts: DataFrame, bucketed: bool = False) -> DataFrame:
    """``(path, part_no, order_ok, metadata_ok, lines_ok)`` of ``parts(path, part_no, start_line, n_lines, size, mtime, chunk_id)``.

    Parts of a file lie in chunks in order, tell the same size and time, and each begins at the line at which the one before ends.
    ``bucketed``: chunks are numbered by bucket in their upper half, and a large file lies in several.
    """
    own = W.partitionBy("path").orderBy("part_no")
    before = lambda c: F.lag(c).over(own)
    first = before("part_no").isNull()
    apart = F.shiftright("chunk_id", 32) != F.shiftright(before("chunk_id"), 32) if bucketed else F.lit(False)
    return parts.select(
        "path",
        "part_no",
        (first | apart | (F.col("chunk_id") >= before("chunk_id"))).alias("order_ok"),
        (first | ((F.col("size") == before("size")) & (F.col("mtime") == before("mtime")))).alias("metadata_ok"),
        F.when(first, F.col("start_line") == 0).otherwise(F.col("start_line") == before("start_line") + before("n_lines")).alias("lines_ok"),
    )


def filled(raw: Column) -> Column:
    """Share of set bits of a filter, counted in words of up to eight bytes."""
    words = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(raw) - 1) / 8).cast("int")), lambda i: F.bit_count(F.conv(F.hex(F.substring(raw, i * 8 + 1, F.lit(8))), 16, -10).cast("long")))
    return F.aggregate(words, F.lit(0), lambda a, x: a + x) / (F.octet_length(raw) * 8)


def index_stats(index: DataFrame) -> DataFrame:
    """One row over ``index(bloom, rounds)``: indexed chunks, bytes, rounds and the share of set bits."""
    rows = index.where(F.octet_length("bloom") > 0).select(F.octet_length("bloom").alias("size"), "rounds", filled(F.col("bloom")).alias("filled"))
    return rows.agg(F.count(F.lit(1)).alias("indexed"), F.sum("size").alias("bytes"), *[f(c).alias(f"{c}_{n}") for c in ("rounds", "filled") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
