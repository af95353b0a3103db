"""Two integer hashes and a Bloom filter over 4-grams, in BIGINT arithmetic modulo 2**32."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# The constants of two public integer hashes.
ADD_1, XOR_2, ADD_3, ADD_4, ADD_5, XOR_6 = 0x7ED55D16, 0xC761C23C, 0x165667B1, 0xD3A2646C, 0xFD7046C5, 0xB55A4F09
STEP = 1193897147

MASK = 0xFFFFFFFF


def _low(col: Column) -> Column:
    return col.bitwiseAND(F.lit(MASK))


def hash_1(v: Column) -> Column:
    """Six rounds of adding or xoring a constant and a shifted copy."""
    v = _low(v.cast("long"))
    v = _low(v + ADD_1 + F.shiftleft(v, 12))
    v = v.bitwiseXOR(F.lit(XOR_2)).bitwiseXOR(F.shiftright(v, 19))
    v = _low(v + ADD_3 + F.shiftleft(v, 5))
    v = _low(v + ADD_4).bitwiseXOR(_low(F.shiftleft(v, 9)))
    v = _low(v + ADD_5 + F.shiftleft(v, 3))
    return v.bitwiseXOR(F.lit(XOR_6)).bitwiseXOR(F.shiftright(v, 16))


def hash_2(v: Column) -> Column:
    v = _low(_low(v.cast("long")) * F.lit(STEP))
    v = v.bitwiseXOR(F.shiftright(v, 16))
    v = v.bitwiseXOR(F.shiftright(v, 14))
    return _low(v + STEP)


def grams(raw: bytes) -> np.ndarray:
    """Distinct 4-grams of folded bytes that stay within a line, sorted."""
    b = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.int64)
    g = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    line_end = b == 10
    crosses = line_end[:-3] | line_end[1:-2] | line_end[2:-1] | line_end[3:]
    return np.unique(g[~crosses]).astype(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def grams_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: grams(x or b""))


def _hashes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = v.astype(np.uint32)
    a = v + np.uint32(ADD_1) + (v << np.uint32(12))
    a = a ^ np.uint32(XOR_2) ^ (a >> np.uint32(19))
    a = a + np.uint32(ADD_3) + (a << np.uint32(5))
    a = (a + np.uint32(ADD_4)) ^ (a << np.uint32(9))
    a = a + np.uint32(ADD_5) + (a << np.uint32(3))
    a = a ^ np.uint32(XOR_6) ^ (a >> np.uint32(16))
    b = v * np.uint32(STEP)
    b ^= b >> np.uint32(16)
    b ^= b >> np.uint32(14)
    return a, b + np.uint32(STEP)


def first_hashes(values: np.ndarray) -> np.ndarray:
    """What the first round of a filter goes by."""
    h, step = _hashes(values)
    return h + step


def filter_size(data_bytes: int, n_grams: int) -> tuple[int, int]:
    """Bytes and rounds of a filter: a fiftieth of the data, none below 1024 bytes."""
    size = data_bytes // 50
    if size < 1024 or not n_grams:
        return 0, 0
    return size, int(min(16, max(1, np.floor(0.693 * size * 8 / n_grams))))


def bloom(values: np.ndarray, size: int, rounds: int) -> bytes:
    bits = np.zeros(size * 8, bool)
    h, step = _hashes(values)
    for _ in range(rounds):
        h = h + step
        bits[h % np.uint32(size * 8)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def might_hold(raw: bytes, values: np.ndarray, rounds: int) -> bool:
    """Whether a filter may hold all values; an empty one may hold anything."""
    if not raw or not len(values):
        return True
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    h, step = _hashes(values)
    for _ in range(rounds):
        h = h + step
        if not bits[h % np.uint32(len(bits))].all():
            return False
    return True
