"""Quartile bucket digests of documents, compared with a bounded difference score.

Byte triplets are hashed to 256 buckets and counted; each bucket keeps only the quartile of its count
among all buckets (2 bits), and one byte keeps the logarithm of the length. Two digests differ by the
sum over buckets of the steps between quartiles, and of the steps in length, up to a bound.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried, importable, map_arrow, schema_of, slices

BUCKETS = 256
#: Difference at which two digests count as unlike altogether; steps of length that count, at most.
BOUND, LENGTH_STEPS = 256, 32


def digest(raw: bytes) -> np.ndarray:
    """Length byte, then the quartile (0 to 3) of each bucket. Under three bytes, zeros fill a triplet; no bytes, no triplet."""
    out = np.zeros(1 + BUCKETS, np.uint8)
    if raw:
        b = np.frombuffer(raw if len(raw) > 2 else raw.ljust(3, b"\0"), np.uint8)
        t = b[:-2].astype(np.uint32)
        t |= b[1:-1].astype(np.uint32) << np.uint32(8)
        t |= b[2:].astype(np.uint32) << np.uint32(16)
        t *= np.uint32(0x9E3779B1)
        counts = np.bincount(t >> np.uint32(24), minlength=BUCKETS)
        cuts = np.partition(counts, (63, 127, 191))[[63, 127, 191]]
        out[1:] = (counts > cuts[0]).view(np.uint8) + (counts > cuts[1]) + (counts > cuts[2])
        out[0] = min(255, int(np.log2(1 + len(raw)) * 8))
    return out


def encode(d: np.ndarray) -> str:
    """Hex: two digits of length, and two bits for each bucket."""
    codes = d[1:].reshape(-1, 4)
    return d[:1].tobytes().hex() + (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).astype(np.uint8).tobytes().hex()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    codes = np.stack([raw[1:] >> 6, raw[1:] >> 4 & 3, raw[1:] >> 2 & 3, raw[1:] & 3], 1)
    return np.concatenate([raw[:1], codes.reshape(-1)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 from the bound on."""
    steps = np.abs(a.astype(np.int16) - b)
    return max(0.0, 1.0 - (int(steps[1:].sum()) + min(LENGTH_STEPS, int(steps[0]))) / BOUND)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.record_batch([*b.columns[1:], pa.array([encode(digest(t)) for t in b.column(0).to_pylist()], pa.string())], [*b.schema.names[1:], "fingerprint"])


def fingerprints(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), new: str = "fingerprint") -> DataFrame:
    """``(*carry, fingerprint)`` of each whole text; null is as empty; repeated rows come back repeated; carried columns may have any names."""
    picks, schema, back = carried(docs, carry)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *picks)
    return map_arrow(rows, _fingerprints, schema_of(schema, "fingerprint string")).select(*back, F.col("fingerprint").alias(new))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, guest) in order, the guest of the following range last -> each row with its next."""
    held = None
    for b in slices(batches):
        out = []
        for doc, raw, guest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            mine = (doc, raw.decode("utf-8", "surrogateescape"), digest(raw))
            if held is not None:
                out.append(_compared(held, mine))
            held = mine
            if guest:
                held = None  # the row after a guest, if any, is another guest of the same id
                break
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        if held is None:
            break
    for _ in batches:  # what is left are further guests
        pass


def _compared(own: tuple, then: tuple) -> tuple:
    doc, text, print_ = own
    n = len(text) // 3
    raw = (text[: len(text) - n] + then[1][:n]).encode("utf-8", "surrogateescape")
    edited = digest(raw)
    return doc, len(text), hashlib.sha256(raw).hexdigest(), encode(print_), encode(edited), likeness(print_, edited), likeness(print_, then[2])


def key_of(id_col: str, text_col: str) -> Column:
    """A row's place in the order, as bytes that compare as it does: without an id last, then ids descending, then the text's hash."""
    sign = F.lit(-(1 << 63))
    ordered = lambda c: F.lpad(F.hex(c.bitwiseXOR(sign)), 16, "0")
    own = F.col(id_col).cast("long")
    head = F.when(own.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), ordered(F.bitwise_not(own))))
    return F.unhex(F.concat(head, ordered(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))).alias("key")


def ranges(keys: DataFrame, parts: int) -> list[bytes]:
    """Keys at which about ``parts`` ranges of near equal row counts begin, the first range's excepted.

    Quantiles are of ids; an id, or the lack of one, that holds several ranges' rows is cut by the hash.
    """
    unsigned = F.conv(F.hex(F.substring("key", 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    null = F.substring("key", 1, 1) == F.lit(b"\x01")
    got = keys.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(null, 1)).alias("nulls"), F.percentile_approx(F.when(~null, unsigned), [i / parts for i in range(1, parts)] or [0.5], 20000).alias("cuts")).first()
    heads: Counter = Counter(bytes(1) + ((c + (1 << 63)) % (1 << 64)).to_bytes(8, "big") for c in (got.cuts or []))
    if got.nulls:
        heads[b"\x01" + bytes(8)] = 1 + got.nulls * parts // max(1, got.n)
    out = {head + (j * ((1 << 64) // n)).to_bytes(8, "big") for head, n in heads.items() for j in range(n)}
    return sorted(out)


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    Documents go in descending id, rows of one id by their text's hash, null ids last; after the last
    comes the first. Ranges of near equal row counts are dealt out, an id of many rows in several; and
    each range also gets the first row of the one after it. Null text is as empty; repeated rows each
    come next to the other; a lone document is its own next; a text may be of any length, a task
    holding two; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    importable(spark)
    keys = docs.select(key_of(id_col, text_col))
    cuts = np.array(ranges(keys, int(spark.conf.get("spark.sql.shuffle.partitions"))), "S17")

    def range_of(key: pd.Series) -> np.ndarray:
        return np.searchsorted(cuts, np.array(key.tolist(), "S17"), side="right") if len(cuts) and len(key) else np.zeros(len(key), np.int64)

    @F.pandas_udf("int")
    def in_range(key: pd.Series) -> pd.Series:
        return pd.Series(range_of(key).astype(np.int32))

    heads = sorted((r.r, bytes(r.key)) for r in keys.select("key", in_range("key").alias("r")).groupBy("r").agg(F.min("key").alias("key")).collect())  # one row a range
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        return pd.Series([[int(r), before[x]] if x in before else [int(r)] for r, x in zip(range_of(key), map(bytes, key), strict=True)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), key_of(id_col, text_col))
    rows = rows.select("doc_id", "text", "key", F.posexplode(places("key")).alias("guest", "range"))
    rows = rows.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("guest", "key", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(rows.select("doc_id", "text", (F.col("guest") > 0).alias("guest")), _edited, schema)
