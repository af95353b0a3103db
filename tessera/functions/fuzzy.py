"""The rank of a fuzzy match, for many texts of any lengths at once: all characters lie in one flat array."""

from __future__ import annotations

import string

import numpy as np

FAR = 1 << 30
#: More than any cost or place within a text.
APART = 1 << 32
ASCII_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Characters that are ranked at once; a longer text is ranked by itself.
AT_ONCE = 1 << 18


def _sides(codes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Cost of leaving a run at each character whose neighbour outside is ``other`` (0: none)."""
    letter = (codes >= ord("a")) & (codes <= ord("z")) | np.isin(codes, [ord("["), ord("{")])  # two signs count as letters
    near = np.select([other == 0, np.isin(other, [ord("/"), ord(".")]), np.isin(other, [ord("_"), ord("-")])], [0, 1, 2], 4)
    return np.where(other == 0, 0, np.where(letter, near, 4))


class Ragged:
    """Texts one after the other. What is shifted or accumulated stays within its text."""

    def __init__(self, texts: list[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = np.frombuffer("".join(texts).translate(ASCII_FOLD).encode("utf-32-le", "surrogatepass"), "<u4")
        self.begin = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(texts)), self.size)
        self.at = np.arange(len(self.codes)) - self.begin[self.of]
        self.last = self.at == self.size[self.of] - 1

    def before(self, values: np.ndarray, steps: int = 1) -> np.ndarray:
        """Each character's value of that so many places before it; ``FAR`` without one."""
        out = np.full(len(values), FAR, np.int64)
        out[steps:] = values[:-steps]
        out[self.at < steps] = FAR
        return out

    def least_so_far(self, values: np.ndarray) -> np.ndarray:
        """The least value from the text's begin on; what lies in texts before is made too large to count."""
        away = self.of * APART
        return np.minimum.accumulate(values - away) + away

    def least_from_here(self, values: np.ndarray) -> np.ndarray:
        away = self.of * APART
        return np.minimum.accumulate((values + away)[::-1])[::-1] - away

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value of each text; ``FAR`` of an empty one."""
        out = np.full(len(self.size), FAR, np.int64)
        if len(values):
            some = self.size > 0
            out[some] = np.minimum.reduceat(values, self.begin[some])
        return out


def _ranks(query: str, texts: list[str]) -> np.ndarray:
    q, own = query.lower(), Ragged(texts)
    codes, at = own.codes, own.at
    neighbour = np.zeros(len(codes), np.uint32)
    neighbour[1:] = codes[:-1]
    neighbour[at == 0] = 0
    left = _sides(codes, neighbour)
    neighbour = np.zeros(len(codes), np.uint32)
    neighbour[:-1] = codes[1:]
    neighbour[own.last] = 0
    right = _sides(codes, neighbour)
    now = np.where(codes == ord(q[0]), left, FAR)
    if len(q) == 1:
        first = own.least_from_here(np.where(codes == ord(q[0]), at, FAR))[own.begin[own.size > 0]]
        now = np.where(at == np.repeat(first, own.size[own.size > 0]), now, FAR)
    for k, c in enumerate(q[1:], 1):
        here = codes == ord(c)
        if k == len(q) - 1:
            place = own.least_from_here(np.where(here, at, FAR))
            ahead = np.full(len(codes), FAR, np.int64)
            ahead[:-1] = place[1:]
            ahead[own.last] = FAR  # first place after each
            there = own.begin[own.of] + np.minimum(ahead, own.size[own.of] - 1)
            cost = np.where(ahead == at + 1, 0, right + 8 + ahead - at + left[there]) + right[there]
            return own.least(np.where((now < FAR) & (ahead < FAR), now + cost, FAR))
        gap = own.before(own.least_so_far(np.where(now < FAR, now + right - at, FAR)), 2)  # by a gap, from places two or more before
        now = np.where(here, np.minimum(own.before(now), np.where(gap < FAR, gap + 8 + at + left, FAR)), FAR)
    return own.least(np.where(now < FAR, now + right, FAR))


def ranks(query: str, texts: list[str]) -> np.ndarray:
    """Least cost of the query's characters as a subsequence of each folded text; ``FAR`` without one.

    A run costs its open sides, a gap ten and its inner length. The last character takes its first
    place after the one before it. One array step a query character, over all texts at once; memory grows
    with the characters in hand, not with the longest text times their number.
    """
    out, held, n = [np.zeros(0, np.int64)], [], 0
    for text in [*texts, None]:
        if held and (text is None or n + len(text) > AT_ONCE):
            out.append(_ranks(query, held))
            held, n = [], 0
        if text is not None:
            held.append(text)
            n += len(text)
    return np.concatenate(out)
