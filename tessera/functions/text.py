"""Column functions over text: ASCII folding, byte lengths, names of paths."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else, so that byte lengths stay."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def name_of(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def normal_line_ends(text: Column) -> Column:
    """CRLF and lone CR to LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def grouped(number: Column) -> Column:
    """Integer with a blank between thousands."""
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit(" "))
