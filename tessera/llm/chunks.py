"""Texts cut into chunks that no token crosses, so that a tokenizer sees each distinct chunk once.

A chunk begins with its text and at each blank or line end that follows a character which is no white
space. Byte-level patterns, and models without a piece that goes on behind such a place, never put a
token across it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters at which chunks may begin.
CUTS = " \n"
#: Bytes of text that a worker takes at once, and bytes and rows of a block, whose texts share one list of keys.
PORTION, BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 32 << 20, 16384
_CUT = re.compile(r"(?<=[^\s▁])[ \n]")


def place(tokenizer: str) -> str:
    """A tokenizer file's path: given, or by the name of a public one."""
    import public_tokenizers

    return tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)


def _behind_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space, in UTF-8; U+2581 is one to some models."""
    one, two, three = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    out = (one == 32) | ((one >= 9) & (one <= 13))
    out |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    out |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    out |= (three == 0xE2) & (two == 0x80) & ((one >= 0x80) & (one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    out |= (three == 0xE2) & (two == 0x96) & (one == 0x81)
    out |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    return out | (three == 0xE3) & (two == 0x80) & (one == 0x80)


def values(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins and the last ends."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)), ends - ends[0]


def cut(texts: pa.StringArray, at: str = CUTS, stops: str = "") -> tuple[pa.StringArray, np.ndarray]:
    """The chunks of texts without nulls, and how many chunks lie before each text's begin and the last one's end.

    ``stops``: ASCII characters at which a chunk begins behind an ASCII letter as well.
    """
    data, ends = values(texts)
    starts = ends[:-1][np.diff(ends) > 0]
    if at and len(data):
        places = np.flatnonzero(np.isin(data, np.frombuffer(at.encode(), np.uint8)))
        places = places[~_behind_space(data, places)]
        inside = np.zeros(len(data), bool)
        inside[places] = True
        if stops:
            places = np.flatnonzero(np.isin(data, np.frombuffer(stops.encode(), np.uint8)))
            before = data[np.maximum(places - 1, 0)] | 32
            inside[places[(before >= 97) & (before <= 122)]] = True
        inside[starts] = True
        starts = np.flatnonzero(inside)
    bounds = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())), np.searchsorted(starts, ends)


def portions(texts: pa.StringArray, at: str = CUTS, size: int = PORTION) -> Iterator[tuple[np.ndarray, pa.StringArray]]:
    """All texts in portions of about ``size`` bytes, as numbers of rows and texts. One longer than that comes
    as several portions, cut where chunks begin, so that what a portion needs doesn't grow with a text."""
    sizes = np.diff(values(texts)[1])
    begin = 0
    while begin < len(texts):
        upto = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[begin:]), size, "right")) + begin)
        if upto > begin + 1 or sizes[begin] <= size or not at:
            yield np.arange(begin, upto), texts.slice(begin, upto - begin)
        else:
            text, start = texts[begin].as_py(), 0
            while start < len(text):
                found = next((m for m in _CUT.finditer(text, start + size // 2) if m.group() in at), None)
                end = found.start() if found else len(text)
                yield np.array([begin]), pa.array([text[start:end]])
                start = end
        begin = upto


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``begin[i] ... begin[i] + n[i] - 1`` of each i, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum over each."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def per_row(idx: np.ndarray, ends: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, chunk and how often, of each distinct chunk of each row. ``idx``: chunks, ``ends``: of rows."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    key, n = np.unique(row * max(1, kinds) + idx, return_counts=True)
    return key // max(1, kinds), key % max(1, kinds), n


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed bytes, all lowest bytes first: small ones take little room."""
    planes = numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


class Frequencies:
    """How often each of a block's keys occurs in each of its texts, as one compressed row."""

    schema = "cells long, n_keys array<int>, keys binary, freqs binary"

    @staticmethod
    def columns(row: np.ndarray, key: np.ndarray, freq: np.ndarray, rows: int) -> list[pa.Array]:
        """``row`` and, within it, ``key`` in order."""
        n = np.bincount(row, minlength=rows).astype(np.int32)
        return [pa.array([len(key)]), pa.array([n], pa.list_(pa.int32())), pa.array([packed(np.diff(key, prepend=0))], pa.binary()), pa.array([packed(freq)], pa.binary())]

    @staticmethod
    def of(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and frequencies of all texts one after the other, and where each text's begin and the last one's end."""
        n = block["cells"]
        return np.cumsum(unpacked(block["keys"], n)), unpacked(block["freqs"], n), np.concatenate([[0], np.cumsum(np.array(block["n_keys"], np.int64))])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each list's values."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
