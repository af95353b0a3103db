"""What the operators of this subpackage share: the shared folder, written tables, Arrow stages."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop), where the driver's folders are the executors', is a
    temporary one set if none is named.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tessera-shared-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> int:
    """How many scratch folders this driver has named so far; for ``sweep``."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Delete the scratch folders named from ``since`` on, but for that of ``keep``: nothing else may still be read from them."""
    kept = getattr(keep, "_scratch", None)
    for path in _MADE[since:]:
        if path != kept:
            _delete(spark, path)
    _MADE[since:] = [kept] if kept in _MADE[since:] else []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    if path := getattr(df, "_scratch", None):
        _delete(df.sparkSession, path)
        if path in _MADE:
            _MADE.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def fresh(columns: list[str], *names: str) -> list[str]:
    """These names, with underscores where a table has such columns already (case does not count)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(quoted(c)) for c in docs.columns]


def carried(docs: DataFrame, carry: tuple[str, ...]) -> tuple[list[Column], str, list[Column]]:
    """Columns that pass through an Arrow stage, whatever their names: as they go in, their schema there, and as they come out."""
    inner = [f"carried_{i}" for i in range(len(carry))]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"{i} {kinds[c]}" for c, i in zip(carry, inner, strict=True))
    return [F.col(quoted(c)).alias(i) for c, i in zip(carry, inner, strict=True)], schema, [F.col(i).alias(c) for c, i in zip(carry, inner, strict=True)]


def schema_of(*parts: str) -> str:
    return ", ".join(p for p in parts if p)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand."""
    importable(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, byte_size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``rows`` rows and, unless it is one row, about ``byte_size``."""
    for batch in batches:
        at, mean = 0, max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, byte_size // mean))
        while at < batch.num_rows:
            yield batch.slice(at, step)
            at += step
