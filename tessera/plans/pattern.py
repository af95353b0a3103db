"""Patterns: egrep syntax with perl classes and ``\\b``, parsed once and written for the JVM.

A plan holds the JVM pattern, in which letters stand for both cases if case is ignored, and the literals without
which a text can't match, as a tree that becomes a cheap condition on whole documents. Patterns on which the
JVM's engine would recurse once a repetition go to an automaton instead (``automaton``).
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Depth of the JVM engine's stack that a pattern may need at most; some thousands of repetitions overflow it.
FLAT = 500
MOST_REPEATS = 1000
WORD = "0-9A-Za-z_"
#: The members of named classes.
NAMED = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": "\x00-\x7f",
    "blank": "\t ",
    "cntrl": "\x00-\x1f\x7f",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": "!-/:-@[-`{-~",
    "space": "\t-\r ",
    "upper": "A-Z",
    "word": WORD,
    "xdigit": "0-9A-Fa-f",
}
PERL = {"d": "0-9", "s": "\t\n\f\r ", "w": WORD}
CONTROL = {"a": "\a", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


class PatternError(ValueError):
    """A pattern outside the dialect."""


def _ranges(text: str) -> list[tuple[int, int]]:
    """``"a-z_"`` as code point ranges."""
    out, i = [], 0
    while i < len(text):
        if i + 2 < len(text) and text[i + 1] == "-":
            out.append((ord(text[i]), ord(text[i + 2])))
            i += 3
        else:
            out.append((ord(text[i]), ord(text[i])))
            i += 1
    return out


def _outside(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, b in sorted(ranges):
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    return [*out, (at, 0x10FFFF)] if at <= 0x10FFFF else out


@dataclass(frozen=True)
class Node:
    """``kind``: char, set, any, begin, end, word, inside, seq, alt or repeat."""

    kind: str
    value: object = None
    parts: tuple["Node", ...] = ()


class _Parser:
    def __init__(self, text: str, folded: bool):
        self.text, self.at, self.folded, self.depth = text, 0, folded, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        self.at += 1
        return c

    def fold(self, c: str) -> str:
        return c.lower() if self.folded and c in string.ascii_uppercase else c

    def whole(self) -> Node:
        node = self.either()
        if self.peek():
            raise PatternError("unexpected )")
        return node

    def either(self) -> Node:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else Node("alt", None, tuple(options))

    def sequence(self) -> Node:
        parts: list[Node] = []
        while (c := self.peek()) and c not in "|)":
            parts.append(self.repeated(self.atom()))
        return parts[0] if len(parts) == 1 else Node("seq", None, tuple(parts))

    def bounds(self) -> tuple[int, int | None] | None:
        """A repeat operator at this place, taken; None if there is none."""
        c = self.peek()
        if c and c in "*+?":
            self.take()
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        close = self.text.find("}", self.at)
        if c != "{" or close < 0:
            return None
        low, comma, high = self.text[self.at + 1 : close].partition(",")
        if not low.isdigit() or (high and not high.isdigit()) or not (low + high).isascii():
            return None  # a literal brace
        self.at = close + 1
        span = (int(low), int(high) if high else None if comma else int(low))
        if max(span[0], span[1] or 0) > MOST_REPEATS or (span[1] is not None and span[1] < span[0]):
            raise PatternError("bad repeat count")
        return span

    def repeated(self, node: Node) -> Node:
        span = self.bounds()
        if span is None:
            return node
        if self.bounds() is not None:
            raise PatternError("repeat of a repeat")
        if node.kind == "alt" and all(p.kind in ("char", "set") for p in node.parts):
            node = Node("set", tuple(r for p in node.parts for r in (p.value if p.kind == "set" else ((ord(p.value),) * 2,))))
        return Node("repeat", span, (node,))

    def atom(self) -> Node:
        if self.bounds() is not None:
            raise PatternError("nothing to repeat")
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                raise PatternError("(? is not in this dialect")
            node = self.either()
            if self.take() != ")":
                raise PatternError("missing )")
            return node
        if c == "[":
            return self.bracket()
        if c == "\\":
            return self.escape()
        return Node({".": "any", "^": "begin", "$": "end"}.get(c, "char"), self.fold(c))

    def escape(self) -> Node:
        c = self.take()
        if c.lower() in PERL and c:
            own = _ranges(PERL[c.lower()])
            return Node("set", tuple(own if c.islower() else _outside(own)))
        if c in ("b", "B"):
            return Node("word" if c == "b" else "inside")
        return Node("char", self.fold(self.escaped(c)) if c == "x" else self.escaped(c))

    def escaped(self, c: str) -> str:
        if c in CONTROL and c:
            return CONTROL[c]
        if c == "x":
            digits = self.text[self.at : self.at + 2]
            if len(digits) == 2 and all(d in string.hexdigits for d in digits):
                self.at += 2
                return chr(int(digits, 16))
        if c and not c.isalnum():
            return c
        raise PatternError(f"bad escape \\{c}")

    def bracket(self) -> Node:
        negated = self.peek() == "^" and bool(self.take())
        ranges: list[tuple[int, int]] = []
        first = True
        while first or self.peek() != "]":
            first = False
            if not self.peek():
                raise PatternError("missing ]")
            if self.text.startswith("[:", self.at) and (stop := self.text.find(":]", self.at)) > 0:
                name = self.text[self.at + 2 : stop]
                if name.lstrip("^") not in NAMED:
                    raise PatternError(f"no class {name}")
                own = _ranges(NAMED[name.lstrip("^")])
                ranges += _outside(own) if name.startswith("^") else own
                self.at = stop + 2
                continue
            low = self.member()
            if isinstance(low, list):
                ranges += low
                continue
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                high = self.member()
                if isinstance(high, list) or ord(high) < ord(low):
                    raise PatternError("bad range")
            ranges.append((ord(low), ord(high)))
        self.take()
        return Node("set", tuple(_outside(ranges) if negated else ranges))

    def member(self) -> str | list[tuple[int, int]]:
        c = self.take()
        if c != "\\":
            return self.fold(c)
        c = self.take()
        if c and c.lower() in PERL:
            own = _ranges(PERL[c.lower()])
            return own if c.islower() else _outside(own)
        return self.escaped(c)


def _code(point: int) -> str:
    c = chr(point)
    return c if c.isascii() and c.isalnum() else f"\\x{{{point:x}}}"


def _either(ranges: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """The characters whose folded form is in the ranges: capital letters go by their small ones."""
    out = []
    for a, b in ranges:
        out += [(lo, hi) for lo, hi in ((a, min(b, 0x40)), (max(a, 0x5B), b)) if lo <= hi]
        lo, hi = max(a, 0x61), min(b, 0x7A)
        if lo <= hi:
            out.append((lo - 32, hi - 32))
    return out


_WORDY = _ranges(WORD)


def _is_word(node: Node, last: bool) -> bool:
    """Whether the node's first (or last) character is always one of a word."""
    if node.kind == "char":
        return any(a <= ord(node.value) <= b for a, b in _WORDY)
    if node.kind == "set":
        return bool(node.value) and all(any(a <= x and y <= b for a, b in _WORDY) for x, y in node.value)
    if node.kind == "repeat":
        return node.value[0] > 0 and _is_word(node.parts[0], last)
    if node.kind == "alt":
        return all(_is_word(p, last) for p in node.parts)
    return node.kind == "seq" and bool(node.parts) and _is_word(node.parts[-1 if last else 0], last)


def java(node: Node, both: bool = False) -> str:
    """The node as a JVM pattern, for one line without its end; with ``both`` letters match in either case."""
    kind = node.kind
    if kind == "char":
        c = node.value
        return f"[{c}{c.upper()}]" if both and c in string.ascii_lowercase else _code(ord(c))
    if kind == "set":
        ranges = _either(node.value) if both else node.value
        return "[" + "".join(_code(a) if a == b else f"{_code(a)}-{_code(b)}" for a, b in ranges) + "]" if ranges else "(?!)"
    before, after = f"(?<![{WORD}])", f"(?![{WORD}])"
    if kind == "seq":
        out = []
        for i, p in enumerate(node.parts):
            if p.kind == "word" and i + 1 < len(node.parts) and _is_word(node.parts[i + 1], False):
                out.append(before)  # half the test is enough beside a word's character
            elif p.kind == "word" and i and _is_word(node.parts[i - 1], True):
                out.append(after)
            else:
                out.append(f"(?:{java(p, both)})" if p.kind == "alt" else java(p, both))
        return "".join(out)
    if kind == "alt":
        return "|".join(java(p, both) for p in node.parts)
    if kind == "repeat":
        low, high = node.value
        inner = java(node.parts[0], both)
        if node.parts[0].kind not in ("char", "set", "any"):
            inner = f"(?:{inner})"
        elif high is None and low > 1:
            return f"{inner}{{{low}}}{inner}*"  # the engine's loop for * takes characters of any width, that for {n,} recurses where width changes
        return inner + {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high), f"{{{low}}}" if low == high else f"{{{low},{'' if high is None else high}}}")
    in_, out = f"(?<=[{WORD}])", f"(?=[{WORD}])"
    return {"any": ".", "begin": "^", "end": "$", "word": f"(?:{before}{out}|{in_}{after})", "inside": f"(?:{before}{after}|{in_}{out})"}[kind]


def _same_width(node: Node) -> bool:
    """Whether the JVM's engine steps through repetitions of the node in a loop: all matches have one length in UTF-16."""
    if node.kind == "char":
        return ord(node.value) < 0x10000
    if node.kind == "set":
        return all(b < 0x10000 for _, b in node.value)
    if node.kind == "repeat":
        return node.value[0] == node.value[1] and _same_width(node.parts[0])
    return node.kind == "seq" and all(_same_width(p) for p in node.parts)


def stack_depth(node: Node) -> float:
    """How deep the JVM's engine recurses on the node at most, in steps; infinite if that grows with the text."""
    if node.kind in ("seq", "alt"):
        return (sum if node.kind == "seq" else max)((stack_depth(p) for p in node.parts), **({} if node.kind == "seq" else {"default": 0})) + 1
    if node.kind != "repeat":
        return 1
    (low, high), inner = node.value, node.parts[0]
    if inner.kind in ("char", "set", "any"):
        return 1 if high is None or low == high or _same_width(inner) else high
    if _same_width(inner):
        return 1 + stack_depth(inner)
    return float("inf") if high is None else 1 + high * stack_depth(inner)


@dataclass(frozen=True)
class Needs:
    """A text without these literals can't match: ``all`` or ``any`` of the parts, or one ``text``."""

    how: str
    text: str = ""
    parts: tuple["Needs", ...] = ()

    def condition(self, col: Column) -> Column:
        if self.how == "text":
            return F.contains(col, F.lit(self.text))
        out = self.parts[0].condition(col)
        for p in self.parts[1:]:
            out = out & p.condition(col) if self.how == "all" else out | p.condition(col)
        return out


def _joined(how: str, parts: list[Needs]) -> Needs | None:
    parts = list(dict.fromkeys(parts))
    return None if not parts else parts[0] if len(parts) == 1 else Needs(how, "", tuple(parts))


def needs(node: Node) -> Needs | None:
    if node.kind == "char":
        return Needs("text", node.value)
    if node.kind == "alt":
        each = [needs(p) for p in node.parts]
        return None if None in each else _joined("any", each)
    if node.kind == "repeat":
        return needs(node.parts[0]) if node.value[0] else None
    if node.kind != "seq":
        return None
    out, run = [], ""
    for p in [*node.parts, Node("break")]:
        if p.kind == "char":
            run += p.value
        elif p.kind not in ("begin", "end", "word", "inside") or p.kind == "break":
            if run:
                out.append(Needs("text", run))
            run = ""
            if p.kind != "break" and (own := needs(p)):
                out.append(own)
    return _joined("all", out)


def at_least(need: Needs | None, length: int) -> Needs | None:
    """What remains of it with literals of some length only; None if that is nothing."""
    if need is None or need.how == "text":
        return need if need and len(need.text) >= length else None
    parts = [at_least(p, length) for p in need.parts]
    if need.how == "any":
        return None if None in parts else _joined("any", parts)
    return _joined("all", [p for p in parts if p])


def may_be_empty(node: Node) -> bool:
    """Whether the node can match nothing."""
    if node.kind in ("seq", "alt"):
        return (all if node.kind == "seq" else any)(map(may_be_empty, node.parts))
    if node.kind == "repeat":
        return node.value[0] == 0 or may_be_empty(node.parts[0])
    return node.kind not in ("char", "set", "any")


@dataclass(frozen=True)
class Plan:
    """How to match one query. ``folded``: ``needs`` are of the text in lower case; ``empty``: it can match nothing;
    ``deep``: the query and whether case is ignored, if the JVM's engine can't run it in bounded stack."""

    regex: str | None
    literal: str | None
    folded: bool
    needs: Needs | None
    empty: bool = False
    deep: tuple[str, bool] | None = None

    def matches(self, col: Column) -> Column:
        if self.deep:
            return found_udf(*self.deep)(col)
        return F.contains(col, F.lit(self.literal)) if self.literal is not None else col.rlike(self.regex)

    def matches_line(self, line: Column) -> Column:
        """The same for lines of texts that are possible: most lack one of the literals, which is cheaper to tell."""
        some = self.needs if self.literal is None and not self.folded else None
        return some.condition(line) & self.matches(line) if some else self.matches(line)

    def possible(self, text: Column) -> Column | None:
        """What any text with a matching line has; None if nothing can be said."""
        if self.literal is not None:
            return F.contains(text, F.lit(self.literal)) if self.literal else None
        if not self.folded:
            return self.needs.condition(text) if self.needs else None
        long = at_least(self.needs, 3)  # shorter ones are in nearly all texts, and lower case is not for free
        return long.condition(F.lower(text)) if long else None

    @property
    def pattern(self) -> str:
        return self.regex if self.literal is None else "(?d)" + "".join(_code(ord(c)) for c in self.literal)


@lru_cache(maxsize=1024)
def compile_pattern(query: str, ignore_case: bool = False, literal: bool = False) -> Plan:
    """Plan of a query. Ignoring case, A-Z and a-z are one; a pattern beyond ASCII takes the engine's Unicode folding instead."""
    folded = ignore_case and query.isascii()
    if "\n" in query:
        raise PatternError("a line has no line end")
    if literal and not ignore_case:
        return Plan(None, query, False, None, not query)
    tree = Node("seq", None, tuple(Node("char", c.lower() if folded else c) for c in query)) if literal else parsed(query, ignore_case)[0]
    deep = None if literal or stack_depth(tree) <= FLAT + len(query) else (query, ignore_case)
    if ignore_case and not folded:
        return Plan("(?diu)" + java(tree), None, False, None, may_be_empty(tree), deep)
    return Plan("(?d)" + java(tree, folded), None, folded, needs(tree), may_be_empty(tree), deep)


def parsed(query: str, ignore_case: bool = False) -> tuple[Node, bool]:
    """A query's tree, and whether it is folded."""
    folded = ignore_case and query.isascii()
    return _Parser(query, folded).whole(), folded


@lru_cache(maxsize=64)
def found_udf(query: str, ignore_case: bool) -> Callable[[Column], Column]:
    """Whether a text matches, by the automaton."""

    @F.pandas_udf("boolean")
    def found(text: pd.Series) -> pd.Series:
        from tessera.plans.automaton import automaton

        known = text.notna()
        out = pd.Series(pd.NA, index=text.index, dtype="boolean")
        out[known] = automaton(query, ignore_case).found(text[known].tolist())
        return out

    return found


@lru_cache(maxsize=64)
def spans_udf(query: str, ignore_case: bool, every: bool) -> Callable[[Column], Column]:
    """``array<struct<begin,end>>`` of a text's first match or all, in characters, by the automaton."""

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def spans(text: pd.Series) -> pd.Series:
        from tessera.plans.automaton import automaton

        own = automaton(query, ignore_case)
        of = own.every if every else lambda x: [m for m in (own.first(x),) if m]
        return text.map(lambda x: None if x is None else [{"begin": b, "end": e} for b, e in of(x)])

    return spans


def in_python(plan: Plan) -> Callable[[str], bool]:
    """The same test for single strings on the driver or in a directory walk."""
    if plan.literal is not None:
        return lambda text: plan.literal in text
    if plan.deep:
        from tessera.plans.automaton import automaton

        return lambda text: bool(automaton(*plan.deep).found([text])[0])
    flags, body = plan.regex[: plan.regex.index(")") + 1], plan.regex[plan.regex.index(")") + 1 :]
    body = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", body)
    found = re.compile(body, re.IGNORECASE if "i" in flags else 0)
    return lambda text: found.search(text) is not None
