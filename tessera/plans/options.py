"""Option strings: letters without a dash, blanks between them ignored."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, replace

#: Path match styles, the first given one of this order wins.
STYLES = {"n": "name", "p": "path", "s": "tokens", "f": "fuzzy"}
_LETTER = re.compile(r"CE|HM|HD|L\d*|f[ie][^ ]*|f[nps f]|[ilbVCHS ]")


class OptionError(ValueError):
    """A letter that means nothing."""


@dataclass(frozen=True)
class Options:
    ignore_case: bool = False
    literal: bool = False
    bruteforce: bool = False
    visual_studio: bool = False
    column: bool = False
    end_column: bool = False
    highlight: bool = False
    highlight_matches: bool = False
    summary: bool = False
    limit: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    styles: frozenset[str] = frozenset()

    @property
    def style(self) -> str:
        return next((s for k, s in STYLES.items() if k in self.styles), "path")


def parse_options(text: str, base: Options = Options()) -> Options:
    """``"i VC L100"`` on top of ``base``. ``L0`` and a bare ``L`` lift the limit."""
    out, at = base, 0
    while at < len(text):
        m = _LETTER.match(text, at)
        if not m:
            raise OptionError(f"unknown search option {text[at]!r}")
        word, at = m[0], m.end()
        if word.startswith("L"):
            out = replace(out, limit=int(word[1:] or 0) or None)
        elif word[:2] == "fi":
            out = replace(out, include=(*out.include, word[2:]))
        elif word[:2] == "fe":
            out = replace(out, exclude=(*out.exclude, word[2:]))
        elif word[0] == "f":
            out = replace(out, styles=out.styles | {word[1]})
        elif word == "CE":
            out = replace(out, column=True, end_column=True)
        elif word == "HD":
            out = replace(out, highlight=False, highlight_matches=False)
        elif word != " ":
            flags = {"i": "ignore_case", "l": "literal", "b": "bruteforce", "V": "visual_studio", "C": "column", "S": "summary", "HM": "highlight_matches", "H": "highlight"}
            out = replace(out, **{flags[word]: True} | ({"highlight_matches": True} if word == "H" else {}))
    return out


def from_arguments(words: list[str], env: dict[str, str] | None = None) -> tuple[Options, str]:
    """Options of all words but the last, after those of the environment; the last word is the query."""
    env = os.environ if env is None else env
    options = parse_options(env.get("TESSERA_OPTIONS", ""))
    for w in words[:-1]:
        options = parse_options(w, options)
    return options, words[-1] if words else ""
